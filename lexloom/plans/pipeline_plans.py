"""Steps of the pipeline as queries: lanes of discovery, caches, provisions by drafting convention, guards, rankings, exports, stages."""

from __future__ import annotations

from lexloom.functions.text import NO_SPACE
from lexloom.plans.dialects import registry
from lexloom.plans.naming_plans import CONSOLIDATED, plain_words
from lexloom.plans.store_plans import INSTANT, page

QUERIES, ORACLE, query = registry()

# The terms of two pillars' indicators, in the languages of the corpus.
CONCEPTS = {"P6": ("transfer", "cross-border", "localis", "stor", "pemindahan", "penyimpanan", "передач", "хранени", "转移", "出境", "chuyển", "lưu"), "P7": ("consent", "personal", "privacy", "breach", "persetujuan", "pribadi", "согласи", "личн", "同意", "个人", "đồng ý", "cá nhân")}


def _hits(q, c: str, terms) -> str:
    return q.size(q.keep(q.array(*(f"'{t}'" for t in terms)), "t", f"contains({c}, t)"))


@query
def websearch_lane(q):
    """Documents as a search brings them: a bucket for each economy's query, titles from file names where a page has none, snippets put
    together, relevance at least 0.6, the buckets interleaved, each address where it comes first."""
    relevance = f"greatest(6e-1, least(1e0, {_hits(q, 'said', CONCEPTS['P6'] + CONCEPTS['P7'])} / 4e0))"
    title = f"coalesce(nullif(trim(max(title)), ''), {q.one('source_url', '/([^/?#]+)/?$')})"
    return f"""WITH d AS (SELECT economy, source_url, {title} AS title, substring(lower(coalesce(max(text), '')), 1, 200) AS said, count(*) AS seen FROM documents WHERE source_url IS NOT NULL AND economy IS NOT NULL GROUP BY economy, source_url),
      r AS (SELECT *, round({relevance}, 6) AS relevance FROM d), p AS (SELECT *, row_number() OVER (PARTITION BY economy ORDER BY relevance DESC, source_url) AS turn FROM r),
      f AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY turn, economy) AS k FROM p) SELECT economy, source_url, title, relevance, turn FROM f WHERE k = 1 AND turn <= 20"""


@query
def api_adapter(q):
    """Laws in force whose title holds a word of an asked name, by the share of the name's words that the title has; the best of each name."""
    return f"""WITH a AS (SELECT ref_id, economy, {plain_words(q, 'law_name')} AS words FROM ref_row WHERE law_name IS NOT NULL), aw AS (SELECT ref_id, economy, {q.size('words')} AS n, {q.rows('words')} AS w FROM a),
      l AS (SELECT law_id, economy, {q.rows(plain_words(q, 'title'))} AS w FROM corpus_law WHERE status = 'active'), s AS (SELECT ref_id, law_id, round(CAST(count(*) AS DOUBLE) / max(n), 6) AS score FROM aw JOIN l USING (economy, w) GROUP BY ref_id, law_id)
      SELECT ref_id, law_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, law_id) AS k FROM s) x WHERE k = 1"""


@query
def search_breaker(q):
    """A search engine's answers in order: after two empty ones running the next engine is asked too, after six none is; a found one closes it again."""
    return """WITH e AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
      r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS empties FROM e)
      SELECT CASE WHEN empties >= 6 THEN 'open' WHEN empties >= 2 THEN 'fallback' ELSE 'closed' END AS state, count(*) AS answers, count(DISTINCT user_id) AS engines FROM r GROUP BY 1"""


@query
def embedding_cache(q):
    """Texts to embed against a cache keyed by their hash: what came before the newest day is there, the rest is work, each text once."""
    return """WITH k AS (SELECT sha1(text) AS key_, min(fetched_at) AS first_ FROM documents WHERE text IS NOT NULL GROUP BY 1)
      SELECT cached, count(*) AS texts FROM (SELECT key_, coalesce(CAST(first_ AS DATE) < (SELECT max(CAST(fetched_at AS DATE)) FROM documents), false) AS cached FROM k) x GROUP BY cached"""


@query
def run_input_keys(q):
    """The key of each run's results: a hash of all that goes into it, its economy, its pillars and how it retrieves; equal inputs share one."""
    pillars = f"{'collect_set' if q.spark else 'list'}({'' if q.spark else 'DISTINCT '}{q.one('indicator_id', '^P([0-9]+)-')})"
    return f"""SELECT key_, count(*) AS runs FROM (SELECT substring(sha1(economies || '|' || pillars || '|hybrid|' || CAST(n AS {q.string})), 1, 16) AS key_ FROM
      (SELECT run_id, {q.join(q.sort(f"{'collect_set' if q.spark else 'list'}({'' if q.spark else 'DISTINCT '}coalesce(economy, '?'))"), ',')} AS economies, {q.join(q.sort(pillars), ',')} AS pillars, count(DISTINCT indicator_id) AS n FROM doc_rank WHERE run_id IS NOT NULL GROUP BY run_id) r) k GROUP BY key_"""


@query
def extraction_cache_keys(q):
    """The key of each body's extraction: the first twenty signs of its content's hash, its reader and the version of the format; what lacks one is work."""
    return """SELECT state, count(*) AS versions, count(DISTINCT key_) AS keys FROM (SELECT CASE WHEN content_sha256 IS NULL THEN 'no body' WHEN extraction_version IS NULL THEN 'work' ELSE 'cached' END AS state, substring(content_sha256, 1, 20) || '-' || coalesce(ocr_provider, 'text') || '-' || coalesce(extraction_version, '') AS key_ FROM corpus_version) k GROUP BY state"""


# ---- provisions by drafting convention ----------------------------------------------------------------------------

# How an economy's laws open a provision, first the usual way, then what is tried where that finds too few.
CONVENTIONS = {
    "CN": (r"^\s*第\s*[一二三四五六七八九十百千零〇两0-9]+\s*条", r"^\s*(?:第\s*[一二三四五六七八九十百千零〇两0-9]+\s*[章节条]|[一二三四五六七八九十]+、)", 2),
    "MN": (r"^\s*[0-9]{1,3}\s*(?:д[үу]г[эа]{0,2}р|дэх|дахь)\s+з[үу]йл", r"^\s*[0-9]{1,3}[.][0-9]{1,3}[.]?\s", 3),
    "SG": (r"^\s*[0-9]{1,3}[A-Z]{0,2}[. ]\s*(?:—|-)?\s*\S", r"^\s*(?:Section|Regulation|Rule|PART|Part)\s+[0-9]+", 3),
}
GENERAL = r"^\s*(?:Section|Article|Regulation|Rule|PART|Part|Pasal|BAB|Điều|Chương|Статья|Глава)\s+[0-9]+[A-Z]?|^\s*第[0-9一二三四五六七八九十百千]+条|^\s*[0-9]{1,3}[.]\s+\S|^\s*Q[0-9]+:"


def _segments(q) -> str:
    """(doc_id, economy, title, segment, label, body, n): the stretches between a document's boundaries by its economy's convention."""
    by = "CASE economy WHEN 'MY' THEN 'SG' WHEN 'IN' THEN 'SG' ELSE coalesce(economy, '') END"
    first = " ".join(f"WHEN conv = '{e}' THEN {q.has('line', a)}" for e, (a, _, _) in CONVENTIONS.items())
    second = " ".join(f"WHEN conv = '{e}' THEN {q.has('line', b)}" for e, (_, b, _) in CONVENTIONS.items())
    few = " ".join(f"WHEN conv = '{e}' THEN {n}" for e, (_, _, n) in CONVENTIONS.items())
    w = "PARTITION BY doc_id"
    return f"""ln AS (SELECT doc_id, economy, title, {by} AS conv, {q.numbered(q.split('text', chr(92) + 'n'), 'i', 'line')} FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
      m AS (SELECT *, CASE {first} ELSE {q.has('line', GENERAL)} END AS a, CASE {second} ELSE {q.has('line', GENERAL)} END AS b, {q.has('line', GENERAL)} AS c, CASE {few} ELSE 1 END AS least FROM ln),
      n AS (SELECT *, sum(CASE WHEN a THEN 1 ELSE 0 END) OVER ({w}) AS na, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER ({w}) AS nb FROM m),
      o AS (SELECT *, CASE WHEN na >= least THEN a WHEN nb >= least THEN b ELSE c END AS opens, CASE WHEN na >= least THEN 'usual' WHEN nb >= least THEN 'second' ELSE 'general' END AS how FROM n),
      s AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER ({w} ORDER BY i) AS BIGINT) AS segment FROM o),
      g AS (SELECT doc_id, max(economy) AS economy, max(title) AS title, max(how) AS how, segment, {q.join(q.gather('line', 'i'), chr(10))} AS body, min_by(trim(line), i) AS label FROM s GROUP BY doc_id, segment)"""


@query
def convention_boundaries(q):
    """By economy and way of finding: documents and the boundaries found in them."""
    return f"WITH {_segments(q)} SELECT economy, how, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE segment > 0) AS boundaries FROM g GROUP BY economy, how"


@query
def convention_provisions(q):
    """Provisions by their economy's convention: stretches of at least 20 characters, or 8 where three tenths are of a script without blanks; labels that are
    a year alone are none; a document without boundaries is one provision, unless its title says it is a commentary."""
    dense = f"CAST(length({q.sub('body', f'[^{NO_SPACE}]')}) AS DOUBLE) / greatest(length(body), 1) >= 3e-1"
    return f"""WITH {_segments(q)}, k AS (SELECT *, max(segment) OVER (PARTITION BY doc_id) AS last_ FROM g)
      SELECT doc_id, segment, md5(trim(body)) AS body_md5, CASE WHEN last_ = 0 THEN '(document)' ELSE substring(label, 1, 40) END AS label FROM k
      WHERE length(trim(body)) >= CASE WHEN {dense} THEN 8 ELSE 20 END AND NOT {q.has('label', r'^(?:19|20)[0-9]{2}[A-Za-z.]*$')} AND (segment > 0 OR (last_ = 0 AND NOT {q.has("lower(coalesce(title, ''))", 'guide to|explanatory|commentary|答记者问|解读')}))"""


# ---- guards and gates -----------------------------------------------------------------------------------------------


@query
def language_guard(q):
    """Documents of an economy in English where it has any, else all of them: a guard that never empties an economy."""
    english = "lower(coalesce(lang, '')) IN ('en', 'eng')"
    return f"SELECT economy, doc_id FROM (SELECT economy, doc_id, CASE WHEN {english} THEN 1 ELSE 0 END AS e, max(CASE WHEN {english} THEN 1 ELSE 0 END) OVER (PARTITION BY economy) AS any_ FROM documents) d WHERE e = any_"


@query
def concept_gate_full(q):
    """Whether a candidate is worth embedding: a concept word of its pillar in the law's name, a keyword score, or a name that is not mostly ASCII; the others score 0.5."""
    t = "lower(coalesce(law_name, ''))"
    concept = f"CASE WHEN starts{'' if q.spark else '_'}with(indicator_id, 'P7') THEN {_hits(q, t, CONCEPTS['P7'])} ELSE {_hits(q, t, CONCEPTS['P6'])} END > 0"
    ascii_ = f"CAST(length({q.sub(t, '[^ -~]')}) AS DOUBLE) / greatest(length({t}), 1) >= 85e-2"
    return f"SELECT run_id, indicator_id, doc_id, max(CASE WHEN {concept} OR coalesce(keyword, 0) > 0 OR NOT ({ascii_}) THEN coalesce(semantic, 5e-1) ELSE 5e-1 END) AS dense FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id"


@query
def topical_guard_by_pillar(q):
    """Whether a reference row's rationale holds a term of its own pillar; rows of other pillars are exempt."""
    t = "lower(rationale)"
    return f"SELECT ref_id, CASE WHEN starts{'' if q.spark else '_'}with(indicator_id, 'P6') THEN {_hits(q, t, CONCEPTS['P6'])} > 0 WHEN starts{'' if q.spark else '_'}with(indicator_id, 'P7') THEN {_hits(q, t, CONCEPTS['P7'])} > 0 ELSE true END AS on_topic FROM ref_row WHERE rationale IS NOT NULL AND indicator_id IS NOT NULL"


# ---- rankings -------------------------------------------------------------------------------------------------------


@query
def law_ranking_scoped(q):
    """Laws of each ranking by reciprocal ranks of their best candidate in three scores, times 0.6 where they are sectoral, the five best."""
    best = "SELECT run_id, indicator_id, law_name, max(keyword) AS keyword, max(semantic) AS semantic, max({x}) AS x, max(scope) AS scope FROM doc_rank WHERE law_name IS NOT NULL GROUP BY run_id, indicator_id, law_name".format(x=q.cross)
    place = lambda c: f"CASE WHEN {c} IS NOT NULL THEN 1e0 / (60 + row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY {c} DESC NULLS LAST, law_name)) ELSE 0e0 END"
    return f"""WITH b AS ({best}), f AS (SELECT run_id, indicator_id, law_name, ({place('keyword')} + {place('semantic')} + {place('x')}) * CASE WHEN scope < 1 THEN 6e-1 ELSE 1e0 END AS rrf FROM b),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY round(rrf, 9) DESC, law_name) AS place FROM f) SELECT run_id, indicator_id, law_name, round(rrf, 5) AS rrf, place FROM r WHERE place <= 5"""


@query
def law_score_modes(q):
    """A law's score by four ways of taking its candidates: the best, the mean of three, the sum of five, and how many stand among an indicator's fifty best."""
    return """WITH o AS (SELECT indicator_id, law_name, doc_id, max(coalesce(keyword, 0) + coalesce(semantic, 0)) AS s FROM doc_rank WHERE law_name IS NOT NULL AND doc_id IS NOT NULL GROUP BY indicator_id, law_name, doc_id),
      p AS (SELECT *, row_number() OVER (PARTITION BY indicator_id, law_name ORDER BY round(s, 9) DESC, doc_id) AS k, row_number() OVER (PARTITION BY indicator_id ORDER BY round(s, 9) DESC, doc_id, law_name) AS place FROM o)
      SELECT indicator_id, law_name, round(max(s), 6) AS best, round(avg(s) FILTER (WHERE k <= 3), 7) AS mean_top3, round(sum(s) FILTER (WHERE k <= 5), 6) AS sum_top5, count(*) FILTER (WHERE place <= 50) AS count_topk FROM p GROUP BY indicator_id, law_name"""


@query
def dense_guarantee_floor(q):
    """Candidates that the vectors bring beside the ten best of each ranking: three at most, none under 0.45."""
    return """WITH o AS (SELECT run_id, indicator_id, doc_id, max(keyword) AS k, max(semantic) AS s FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id), p AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY coalesce(k, 0) DESC, doc_id) AS place FROM o),
      e AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY s DESC, doc_id) AS n FROM p WHERE place > 10 AND s >= 45e-2) SELECT run_id, indicator_id, doc_id, round(s, 6) AS semantic FROM e WHERE n <= 3"""


@query
def second_pass_depth(q):
    """A second look into the laws in contention: m = clamp(round(12 log2(n) / 6), 3, 40) of the candidates of each indicator's four best laws, n being how many the law has."""
    m = "CAST(greatest(3, least(40, round(12 * (ln(n) / ln(2)) / 6))) AS INT)"
    return f"""WITH o AS (SELECT indicator_id, law_name, doc_id, max(coalesce(keyword, 0) + coalesce(semantic, 0)) AS s FROM doc_rank WHERE law_name IS NOT NULL AND doc_id IS NOT NULL GROUP BY indicator_id, law_name, doc_id),
      l AS (SELECT indicator_id, law_name, count(*) AS n, row_number() OVER (PARTITION BY indicator_id ORDER BY round(max(s), 9) DESC, law_name) AS place FROM o GROUP BY indicator_id, law_name),
      p AS (SELECT o.indicator_id, o.law_name, o.doc_id, {m} AS m, row_number() OVER (PARTITION BY o.indicator_id, o.law_name ORDER BY round(s, 9) DESC, o.doc_id) AS k FROM o JOIN l ON o.indicator_id = l.indicator_id AND o.law_name = l.law_name WHERE l.place <= 4) SELECT indicator_id, law_name, doc_id, k AS place FROM p WHERE k <= m"""


@query
def stratified_targets(q):
    """A sample of laws: all that targets name, the hardest by how near their titles come to a target's without being it, and a seeded draw of the rest."""
    key = lambda c: "trim(" + q.sub(f"lower({c})", r"[^\p{L}\p{N}]+", " ") + ")"
    return f"""WITH t AS (SELECT DISTINCT economy, {key('law_label')} AS k FROM trace_target WHERE law_label IS NOT NULL), l AS (SELECT law_id, economy, title, {key('title')} AS k FROM corpus_law),
      own AS (SELECT l.law_id, 'target' AS stratum FROM l LEFT SEMI JOIN t ON l.economy = t.economy AND l.k = t.k), rest AS (SELECT * FROM l LEFT ANTI JOIN t ON l.economy = t.economy AND l.k = t.k),
      tw AS (SELECT DISTINCT economy, {q.rows(plain_words(q, 'k'))} AS w FROM t), rw AS (SELECT law_id, economy, {q.rows(plain_words(q, 'title'))} AS w FROM rest), a AS (SELECT law_id, economy, count(*) AS near FROM rw JOIN tw USING (economy, w) GROUP BY law_id, economy),
      h AS (SELECT law_id, row_number() OVER (PARTITION BY economy ORDER BY near DESC, law_id) AS n FROM a), hard AS (SELECT law_id, 'hard' AS stratum FROM h WHERE n <= 10),
      d AS (SELECT rest.law_id, row_number() OVER (PARTITION BY economy ORDER BY md5('3' || rest.law_id)) AS n FROM rest LEFT ANTI JOIN hard ON rest.law_id = hard.law_id)
      SELECT * FROM own UNION ALL SELECT * FROM hard UNION ALL SELECT law_id, 'drawn' FROM d WHERE n <= 10""".replace("LEFT SEMI JOIN", "LEFT SEMI JOIN" if q.spark else "SEMI JOIN").replace("LEFT ANTI JOIN", "LEFT ANTI JOIN" if q.spark else "ANTI JOIN")


@query
def newest_runs(q):
    """The ten newest runs of each outcome, the newest first."""
    return "SELECT outcome, run_id, place FROM (SELECT coalesce(outcome, 'none') AS outcome, run_id, row_number() OVER (PARTITION BY coalesce(outcome, 'none') ORDER BY started_at DESC, run_id) AS place FROM corpus_run WHERE run_id IS NOT NULL) r WHERE place <= 10"


# ---- stages and reports -------------------------------------------------------------------------------------------


@query
def derived_funnel(q):
    """The first stage at which each target is lost, found anew from the tables: is its law in the catalogue, was a version fetched, was it split, do provisions have its section."""
    key = lambda c: "trim(" + q.sub(f"lower({c})", r"[^\p{L}\p{N}]+", " ") + ")"
    number = lambda c: q.one(f"upper({c})", "([0-9]+[A-Z]?)")
    return f"""WITH t AS (SELECT target_id, economy, {key("coalesce(law_label, '')")} AS k, {number("coalesce(primary_section, '')")} AS s FROM trace_target), l AS (SELECT economy, {key('title')} AS k, min(law_id) AS law_id FROM corpus_law GROUP BY 1, 2),
      v AS (SELECT law_id, max(CASE WHEN content_sha256 IS NOT NULL THEN 1 ELSE 0 END) AS fetched, max(CASE WHEN state = 'split' THEN 1 ELSE 0 END) AS split_ FROM corpus_version WHERE law_id IS NOT NULL GROUP BY law_id),
      p AS (SELECT DISTINCT economy, {key('law_name')} AS k, {number('article_section')} AS s FROM provisions WHERE law_name IS NOT NULL AND article_section IS NOT NULL)
      SELECT t.economy, CASE WHEN l.law_id IS NULL THEN 'DISCOVERY' WHEN coalesce(v.fetched, 0) = 0 THEN 'FETCH' WHEN coalesce(v.split_, 0) = 0 THEN 'EXTRACTION' WHEN p.s IS NULL THEN 'SECTION' ELSE 'SURVIVED' END AS lost_at, count(*) AS targets
      FROM t LEFT JOIN l ON t.economy = l.economy AND t.k = l.k LEFT JOIN v ON l.law_id = v.law_id LEFT JOIN p ON t.economy = p.economy AND t.k = p.k AND t.s = p.s GROUP BY 1, 2"""


@query
def retrieval_stage(q):
    """Where each target's law stands in its economy's rankings of its indicator: by its candidate, else by its law's family, else not at all."""
    key = lambda c: "trim(" + q.sub(q.sub(f"lower({c})", "(?:1[89]|20)[0-9][0-9]", " "), r"[^\p{L}]+", " ") + ")"
    return f"""WITH r AS (SELECT economy, indicator_id, law_name, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY coalesce(keyword, 0) + coalesce(semantic, 0) DESC, doc_id, law_name) AS place FROM (SELECT DISTINCT run_id, economy, indicator_id, doc_id, law_name, keyword, semantic FROM doc_rank WHERE doc_id IS NOT NULL) d),
      own AS (SELECT economy, indicator_id, law_name, min(place) AS place FROM r WHERE law_name IS NOT NULL GROUP BY 1, 2, 3), kin AS (SELECT economy, indicator_id, {key('law_name')} AS k, min(place) AS place FROM r WHERE law_name IS NOT NULL GROUP BY 1, 2, 3)
      SELECT t.target_id, CASE WHEN own.place IS NOT NULL THEN 'law' WHEN kin.place IS NOT NULL THEN 'family' ELSE 'none' END AS found_by, coalesce(own.place, kin.place) AS place FROM trace_target t LEFT JOIN own ON t.economy = own.economy AND t.indicator_id = own.indicator_id AND t.law_label = own.law_name LEFT JOIN kin ON t.economy = kin.economy AND t.indicator_id = kin.indicator_id AND {key('t.law_label')} = kin.k"""


@query
def grading_stage(q):
    """What became of targets that retrieval found: graded away or kept, by economy and pillar, and the share kept."""
    return f"SELECT economy, {q.one('indicator_id', '^P([0-9]+)-')} AS pillar, count(*) FILTER (WHERE lost_at IN ('GRADING', 'SURVIVED')) AS graded, count(*) FILTER (WHERE lost_at = 'SURVIVED') AS kept, round(count(*) FILTER (WHERE lost_at = 'SURVIVED') / nullif(CAST(count(*) FILTER (WHERE lost_at IN ('GRADING', 'SURVIVED')) AS DOUBLE), 0), 6) AS share FROM trace_target GROUP BY 1, 2"


@query
def verbatim_pages(q):
    """Whether the first 60 characters of each page's middle stand on the page itself or one next to it, in the result's whole text."""
    return f"""WITH p AS (SELECT ocr_id, text AS whole, {q.numbered('pages', 'i', 'p')} FROM ocr_result WHERE {q.size('pages')} > 0), t AS (SELECT ocr_id, i, p.text AS t, whole FROM p),
      n AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY ocr_id ORDER BY i), '') || ' ' || coalesce(t, '') || ' ' || coalesce(lead(t) OVER (PARTITION BY ocr_id ORDER BY i), '') AS around FROM t)
      SELECT ocr_id, count(*) AS pages, count(*) FILTER (WHERE contains(around, substring(t, CAST(greatest(length(t) / 2, 1) AS INT), 60))) AS grounded, count(*) FILTER (WHERE contains(coalesce(whole, ''), substring(t, CAST(greatest(length(t) / 2, 1) AS INT), 60))) AS in_whole FROM n GROUP BY ocr_id""".replace("length(t) / 2", "floor(length(t) / 2)")


@query
def round_scores(q):
    """A round's score by indicator: citations asked for, found with their section, found by number of the section alone."""
    number = lambda c: q.one(f"upper({c})", "([0-9]+[A-Z]?)")
    return f"""WITH c AS (SELECT DISTINCT economy, indicator_id, s FROM (SELECT economy, indicator_id, {q.rows('sections')} AS s FROM label_row WHERE sections IS NOT NULL) x WHERE s IS NOT NULL), r AS (SELECT DISTINCT economy, indicator_id, s FROM (SELECT economy, indicator_id, {q.rows('sections')} AS s FROM ref_row WHERE sections IS NOT NULL) y WHERE s IS NOT NULL),
      rn AS (SELECT DISTINCT economy, indicator_id, {number('s')} AS n FROM r) SELECT c.indicator_id, count(*) AS asked, count(r.s) AS with_section, count(rn.n) AS by_number FROM c LEFT JOIN r ON c.economy = r.economy AND c.indicator_id = r.indicator_id AND c.s = r.s LEFT JOIN rn ON c.economy = rn.economy AND c.indicator_id = rn.indicator_id AND {number('c.s')} = rn.n GROUP BY c.indicator_id"""


@query
def target_builder(q):
    """Targets of the key: each law of a label with its sections; where the panel's reference row of the economy and indicator has sections of its own, these go before."""
    panel = q.join(q.sort(f"{'collect_set' if q.spark else 'list'}({'' if q.spark else 'DISTINCT '}s)"), "|")
    return f"""WITH l AS (SELECT DISTINCT label_id, economy, indicator_id, law, own FROM (SELECT label_id, economy, indicator_id, {q.join('sections', '|')} AS own, {q.rows('laws')} AS law FROM label_row WHERE laws IS NOT NULL) x WHERE law IS NOT NULL),
      p AS (SELECT economy, indicator_id, law_name, {panel} AS curated FROM (SELECT economy, indicator_id, law_name, {q.rows('sections')} AS s FROM ref_row WHERE sections IS NOT NULL) y WHERE s IS NOT NULL AND law_name IS NOT NULL GROUP BY 1, 2, 3)
      SELECT l.label_id, l.law, coalesce(p.curated, l.own) AS sections, p.curated IS NOT NULL AS overridden FROM l LEFT JOIN p ON l.economy = p.economy AND l.indicator_id = p.indicator_id AND l.law = p.law_name"""


@query
def latest_flags(q):
    """Each law's latest compilation by its amendments, and whether it was never amended."""
    return f"""SELECT law_id, max(amendment_date) AS latest, count(DISTINCT amendment_date) AS compilations, coalesce(bool_or({q.has("coalesce(amendment_date, '')", '^Original$')}), false) OR count(amendment_date) = 0 AS never_amended FROM corpus_version WHERE law_id IS NOT NULL GROUP BY law_id"""


@query
def scored_export(q):
    """The scored report: rows with a score, by pillar, then by the indicator's code as text, then the higher score, then row."""
    pillar = f"CAST({q.one('indicator_id', '^P([0-9]+)-')} AS INT)"
    return f"SELECT row_number() OVER (PARTITION BY economy ORDER BY {pillar}, indicator_id, raw_score DESC, ref_id) AS line, economy, indicator_id, ref_id, raw_score FROM ref_row WHERE raw_score IS NOT NULL AND {q.has('indicator_id', '^P[0-9]+-')} AND economy IS NOT NULL"


@query
def payload_summary(q):
    """The summary a JSON report begins with, by economy: rows, laws, indicators, mean score, and the reader's error as one less its confidence where it has no rate."""
    return f"""SELECT a.economy, a.mappings, a.laws, a.indicators, a.score, o.error FROM (SELECT economy, count(*) AS mappings, count(DISTINCT law_name) AS laws, count(DISTINCT indicator_id) AS indicators, round(avg(raw_score), 6) AS score FROM ref_row GROUP BY economy) a
      LEFT JOIN (SELECT economy, round(avg(coalesce(cer, 5e-1)), 6) AS error FROM ocr_result GROUP BY economy) o ON a.economy = o.economy"""


@query
def matrix_rows(q):
    """Rows of a coverage matrix: each law of an economy with its strongest cell for each indicator of two pillars, laws with more indicators first."""
    cells = ", ".join(f"max(raw_score) FILTER (WHERE indicator_id = 'P{p}-I{i}') AS p{p}_i{i}" for p, n in ((6, 5), (7, 5)) for i in range(1, n + 1))
    return f"""SELECT *, row_number() OVER (PARTITION BY economy ORDER BY covered DESC, law_name) AS line FROM (SELECT economy, law_name, count(DISTINCT indicator_id) AS covered, {cells} FROM ref_row WHERE law_name IS NOT NULL GROUP BY economy, law_name) m"""


@query
def indicator_dimension(q):
    """Indicators by pillar as a dimension: measured ones are those of pillars 6 and 7, and no choice means these."""
    p = f"CAST({q.one('indicator_id', '^P([0-9]+)-')} AS INT)"
    return f"SELECT indicator_id, pillar, pillar IN (6, 7) AS measured, 'P' || CAST(pillar AS {q.string}) || ' ' || {q.one('indicator_id', '-(I[0-9]+)$')} AS short, count(*) AS rows_ FROM (SELECT indicator_id, {p} AS pillar FROM label_row WHERE {q.has('indicator_id', '^P[0-9]+-')} UNION ALL SELECT indicator_id, {p} FROM ref_row WHERE {q.has('indicator_id', '^P[0-9]+-')}) i GROUP BY indicator_id, pillar"


@query
def portal_probe(q):
    """What a probe of each host finds: how many pages answer, in which formats, with how much text, and a verdict."""
    return f"""SELECT host, count(*) AS pages, count(DISTINCT kind) AS kinds, round(avg(CASE WHEN n > 200 THEN 1e0 ELSE 0e0 END), 6) AS with_text, CASE WHEN avg(CASE WHEN n > 200 THEN 1e0 ELSE 0e0 END) >= 5e-1 THEN 'readable' WHEN max(n) > 0 THEN 'thin' ELSE 'silent' END AS verdict FROM
      (SELECT {q.one("lower(coalesce(final_url, url))", '^[a-z]+://([^/?#]+)')} AS host, coalesce(nullif(content_type, ''), 'unknown') AS kind, coalesce(length({page(q)}), octet_length(body), 0) AS n FROM fetched_page) x GROUP BY host"""


@query
def failover_order(q):
    """The readers to try for each economy, in order: the lowest error rate first, those without a rate last, each once."""
    return "SELECT economy, provider, row_number() OVER (PARTITION BY economy ORDER BY cer NULLS LAST, provider) AS place FROM (SELECT economy, provider, avg(cer) AS cer FROM ocr_result WHERE provider IS NOT NULL AND economy IS NOT NULL GROUP BY economy, provider) p"


@query
def shipped_against_lab(q):
    """The blend that is in use (0.65 to 0.35) against the other ways to blend: how many of the first five of a ranking they share."""
    alphas = q.rows(q.array("25e-2", "5e-1", "8e-1", "1e0"))
    return f"""WITH o AS (SELECT run_id, indicator_id, doc_id, max(coalesce(keyword, 0)) AS k, max(coalesce(semantic, 0)) AS s FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id), top_ AS (SELECT run_id, indicator_id, max(k) AS mk, max(s) AS ms FROM o GROUP BY run_id, indicator_id),
      n AS (SELECT o.run_id, o.indicator_id, doc_id, CASE WHEN mk > 0 THEN k / mk ELSE k END AS k, CASE WHEN ms > 0 THEN s / ms ELSE s END AS s FROM o JOIN top_ ON o.run_id = top_.run_id AND o.indicator_id = top_.indicator_id),
      a AS (SELECT run_id, indicator_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY round(65e-2 * k + 35e-2 * s, 9) DESC, doc_id) AS p FROM n) x WHERE p <= 5), g AS (SELECT *, {alphas} AS alpha FROM n),
      b AS (SELECT alpha, run_id, indicator_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY alpha, run_id, indicator_id ORDER BY round(alpha * k + (1 - alpha) * s, 9) DESC, doc_id) AS p FROM g) y WHERE p <= 5)
      SELECT b.alpha, count(*) AS lab, count(a.doc_id) AS shared FROM b LEFT JOIN a ON b.run_id = a.run_id AND b.indicator_id = a.indicator_id AND b.doc_id = a.doc_id GROUP BY b.alpha"""


@query
def extraction_regression(q):
    """Versions whose number of provisions fell by more than a tenth between two writes that have one: what a sweep over all economies has to show."""
    return f"""WITH w AS (SELECT DISTINCT economy, version_id, provisions_n, {INSTANT[q.spark]} AS t, write_seq FROM corpus_version WHERE provisions_n IS NOT NULL AND version_id IS NOT NULL), l AS (SELECT *, lag(provisions_n) OVER (PARTITION BY version_id ORDER BY t, write_seq, provisions_n) AS before_ FROM w)
      SELECT economy, count(*) AS writes, count(*) FILTER (WHERE provisions_n < 9e-1 * before_) AS fell, count(*) FILTER (WHERE provisions_n > before_) AS rose FROM l GROUP BY economy"""


@query
def consolidated_first(q):
    """Titles of one family, a consolidated one before the others, and how many each economy would drop."""
    return f"SELECT economy, count(*) AS titles, count(*) FILTER (WHERE {q.has('lower(title)', CONSOLIDATED)}) AS consolidated FROM corpus_law WHERE title IS NOT NULL GROUP BY economy"
