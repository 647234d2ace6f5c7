"""Evaluation and lookups: linking lanes, recall, sweeps, coverage, readiness, costs and reports."""

from __future__ import annotations

from lexloom.plans.dialects import registry
from lexloom.plans.naming_plans import TYPES, bilingual, host_path, plain_words

QUERIES, ORACLE, query = registry()


def _distinct(q, value: str) -> str:
    return q.sort(f"{'collect_set' if q.spark else 'list'}({'' if q.spark else 'DISTINCT '}{value})")


@query
def link_law_lanes(q):
    """The catalogue's law that a reference row means, by three lanes: its act number within the economy; an address that spells at
    least two of its words and half of them; the words of the names, at least 0.62 of either side and 0.02 before any other."""
    number = lambda c: q.one(f"lower({c})", r"(?:act|no\.?|№|第) *(a?[0-9]+)")
    url_words = q.distinct(q.every(host_path(q, "u"), "([a-z]{3,})"))
    words, types = plain_words(q, "law_name"), " OR ".join(rf"({q.has('r.english', rf'\b{w}\b')} AND NOT {q.has('l.english', rf'\b{w}\b')})" for w in TYPES)
    return f"""WITH r AS (SELECT ref_id, economy, law_name, {number('law_number')} AS number, {words} AS words, {bilingual(q, 'law_name')} AS english, source_urls FROM ref_row WHERE law_name IS NOT NULL),
      l AS (SELECT law_id, economy, {number('law_number')} AS number, {plain_words(q, 'title')} AS words, {bilingual(q, 'title')} AS english, {host_path(q, 'source_url')} AS page FROM corpus_law),
      by_number AS (SELECT ref_id, min(law_id) AS law_id, 1 AS lane, 1e0 AS score FROM r JOIN l USING (economy, number) WHERE number <> '' GROUP BY ref_id HAVING count(*) = 1),
      u AS (SELECT ref_id, economy, words, {q.rows('source_urls')} AS u FROM r WHERE source_urls IS NOT NULL),
      by_url AS (SELECT ref_id, min(law_id) AS law_id, 2 AS lane, 1e0 AS score FROM (SELECT ref_id, economy, {host_path(q, 'u')} AS page FROM u WHERE {q.size(q.shared('words', url_words))} >= 2 AND {q.size(q.shared('words', url_words))} >= 0.5 * {q.size('words')}) k JOIN l USING (economy, page) GROUP BY ref_id),
      rw AS (SELECT ref_id, economy, {q.size('words')} AS n, {q.rows('words')} AS w FROM r), lw AS (SELECT law_id, economy, {q.size('words')} AS m, {q.rows('words')} AS w FROM l),
      met AS (SELECT ref_id, law_id, CAST(count(*) AS DOUBLE) / greatest(max(n), max(m)) AS score FROM rw JOIN lw USING (economy, w) GROUP BY ref_id, law_id HAVING count(*) >= 0.62 * greatest(max(n), max(m))),
      typed AS (SELECT met.ref_id, met.law_id, round(score, 6) AS score, {q.join('l.words', ' ')} AS name FROM met JOIN r ON r.ref_id = met.ref_id JOIN l ON l.law_id = met.law_id WHERE NOT ({types})),
      named AS (SELECT ref_id, name, min(law_id) AS law_id, max(score) AS score FROM typed GROUP BY ref_id, name),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, name) AS k, coalesce(lead(score) OVER (PARTITION BY ref_id ORDER BY score DESC, name), 0) AS next FROM named),
      lanes AS (SELECT * FROM by_number UNION ALL SELECT * FROM by_url UNION ALL SELECT ref_id, law_id, 3, score FROM ranked WHERE k = 1 AND score - next >= 0.02)
      SELECT ref_id, law_id, CASE lane WHEN 1 THEN 'act_number' WHEN 2 THEN 'url' ELSE 'name' END AS how, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY lane) AS k FROM lanes) x WHERE k = 1"""


@query
def kit_known_full(q):
    """Whether a reference row is known to the answer key of its economy and indicator: an address within another, or three quarters of a
    key name's words and no other year."""
    year = lambda c: q.distinct(q.every(c, "((?:1[89]|20)[0-9]{2})"))
    key = lambda u: q.sub(host_path(q, u), r"\.(?:pdf|html?|aspx)$")
    return f"""WITH a AS (SELECT ref_id, economy, indicator_id, {plain_words(q, "coalesce(law_name, '')")} AS words, {year("coalesce(law_name, '')")} AS years, source_urls FROM ref_row),
      k AS (SELECT economy, indicator_id, {q.rows('laws')} AS law FROM label_row WHERE laws IS NOT NULL), kw AS (SELECT DISTINCT economy, indicator_id, {plain_words(q, 'law')} AS words, {year('law')} AS years FROM k WHERE law IS NOT NULL),
      aw AS (SELECT ref_id, economy, indicator_id, years, {q.rows('words')} AS w FROM a), kx AS (SELECT economy, indicator_id, {q.join('words', ' ')} AS name, years AS key_years, {q.size('words')} AS n, {q.rows('words')} AS w FROM kw),
      met AS (SELECT ref_id, name, years, key_years, max(n) AS n, count(*) AS shared FROM aw JOIN kx USING (economy, indicator_id, w) GROUP BY ref_id, name, years, key_years),
      by_name AS (SELECT DISTINCT ref_id FROM met WHERE shared >= 0.75 * n AND ({q.size('years')} = 0 OR {q.size('key_years')} = 0 OR {q.size(q.shared('years', 'key_years'))} > 0)),
      au AS (SELECT ref_id, economy, {q.rows('source_urls')} AS u FROM a WHERE source_urls IS NOT NULL), ku AS (SELECT economy, {q.rows('portal_urls')} AS u FROM label_row WHERE portal_urls IS NOT NULL),
      by_url AS (SELECT DISTINCT ref_id FROM (SELECT ref_id, economy, {key('u')} AS p FROM au) x JOIN (SELECT DISTINCT economy, {key('u')} AS p FROM ku) y USING (economy, p) WHERE p <> '')
      SELECT ref_row.ref_id, by_url.ref_id IS NOT NULL AS by_url, by_name.ref_id IS NOT NULL AS by_name FROM ref_row LEFT JOIN by_url ON ref_row.ref_id = by_url.ref_id LEFT JOIN by_name ON ref_row.ref_id = by_name.ref_id"""


@query
def discovery_recall(q):
    """Share of an economy's key laws that documents have: by the last part of an address, or by six tenths of a name's words in a title."""
    stem = lambda u: q.sub(q.one(host_path(q, u), "([^/]+)$"), r"\.(?:pdf|html?|aspx)$")
    return f"""WITH g AS (SELECT DISTINCT economy, law, {plain_words(q, 'law')} AS words FROM (SELECT economy, {q.rows('laws')} AS law FROM label_row WHERE laws IS NOT NULL) x WHERE law IS NOT NULL),
      gu AS (SELECT economy, u FROM (SELECT economy, {q.rows('portal_urls')} AS u FROM label_row WHERE portal_urls IS NOT NULL) x), d AS (SELECT DISTINCT economy, {plain_words(q, 'title')} AS words FROM documents WHERE title IS NOT NULL),
      gw AS (SELECT economy, law, {q.size('words')} AS n, {q.rows('words')} AS w FROM g), dw AS (SELECT economy, {q.join('words', ' ')} AS title, {q.rows('words')} AS w FROM d),
      hit AS (SELECT DISTINCT economy, law FROM (SELECT economy, law, title FROM gw JOIN dw USING (economy, w) GROUP BY economy, law, title HAVING count(*) >= 0.6 * max(n)) x),
      stems AS (SELECT economy, count(DISTINCT {stem('gu.u')}) AS addresses, count(DISTINCT CASE WHEN s.s IS NOT NULL THEN {stem('gu.u')} END) AS found FROM gu LEFT JOIN (SELECT DISTINCT economy AS e, {stem('source_url')} AS s FROM documents) s ON gu.economy = s.e AND {stem('gu.u')} = s.s GROUP BY economy)
      SELECT g.economy, count(*) AS laws, count(hit.law) AS by_name, max(coalesce(stems.addresses, 0)) AS addresses, max(coalesce(stems.found, 0)) AS by_address FROM g LEFT JOIN hit ON g.economy = hit.economy AND g.law = hit.law LEFT JOIN stems ON g.economy = stems.economy GROUP BY g.economy"""


@query
def section_parent_match(q):
    """Cited sections and the sections an economy's provisions have: the same, or one the dotted parent of the other."""
    key = lambda c: q.one(f"lower({c})", r"([0-9]+[a-z]{0,2}(?:\.[0-9]+)*)")
    root = lambda c: q.one(c, "^([^.]*)")
    return f"""WITH c AS (SELECT DISTINCT economy, {key('s')} AS want FROM (SELECT economy, {q.rows('sections')} AS s FROM ref_row WHERE sections IS NOT NULL) x WHERE s IS NOT NULL),
      p AS (SELECT DISTINCT economy, {key('article_section')} AS got FROM provisions WHERE article_section IS NOT NULL AND NOT {q.has('lower(article_section)', '^ *(?:part|division|schedule|chapter|bab|chương|глава)')})
      SELECT c.economy, want, got, CASE WHEN want = got THEN 'same' WHEN length(got) < length(want) THEN 'parent' ELSE 'part' END AS how FROM c JOIN p ON c.economy = p.economy AND {root('want')} = {root('got')}
      WHERE want <> '' AND (want = got OR (contains(want, '.') AND (starts{'' if q.spark else '_'}with(want, got || '.') OR starts{'' if q.spark else '_'}with(got, want || '.'))))"""


@query
def snippet_context(q):
    """A provision's wording with 300 characters on either side, cut by its span out of its record."""
    span = [q.one("prov_json", r'"char_span": *\[ *([0-9]+) *, *([0-9]+)', i) for i in (1, 2)]
    said = q.field("prov_json", "verbatim_snippet")
    return f"""SELECT provision_id, lo, hi, md5(substring(said, CAST(greatest(1, lo - 300) AS INT), CAST(hi - lo + 600 AS INT))) AS context_md5, length(substring(said, CAST(greatest(1, lo - 300) AS INT), CAST(hi - lo + 600 AS INT))) AS n
      FROM (SELECT DISTINCT provision_id, {said} AS said, TRY_CAST({span[0]} AS BIGINT) % greatest(length({said}), 1) + 1 AS lo, TRY_CAST({span[0]} AS BIGINT) % greatest(length({said}), 1) + 61 AS hi FROM provisions WHERE prov_json IS NOT NULL) s WHERE said IS NOT NULL AND lo IS NOT NULL"""


@query
def grade_all_switch(q):
    """Of each ranking, whether all its candidates are graded (80 or fewer), how many term ranking may see, and the reranker's pool."""
    return "SELECT run_id, indicator_id, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) <= 80 AS grade_all, greatest(80, 3 * 8) AS visible, greatest(3 * 8, 8) AS pool FROM doc_rank GROUP BY run_id, indicator_id"


@query
def bm25_visible(q):
    """The candidates of each ranking that term ranking may see: the 80 best by keyword, ties by id."""
    return "SELECT run_id, indicator_id, doc_id, place FROM (SELECT run_id, indicator_id, doc_id, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY keyword DESC, doc_id) AS place FROM (SELECT run_id, indicator_id, doc_id, max(keyword) AS keyword FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id) d WHERE keyword IS NOT NULL) r WHERE place <= 80"


@query
def law_prefilter(q):
    """Candidates of the five best laws of each indicator, a law standing by its best candidate: a semi join of rankings with their laws."""
    return """SELECT DISTINCT d.run_id, d.indicator_id, d.doc_id FROM doc_rank d LEFT SEMI JOIN (SELECT indicator_id, law_name FROM (SELECT indicator_id, law_name, row_number() OVER (PARTITION BY indicator_id ORDER BY best DESC, law_name) AS k FROM
      (SELECT indicator_id, law_name, max(coalesce(keyword, 0) + coalesce(semantic, 0)) AS best FROM doc_rank WHERE law_name IS NOT NULL GROUP BY indicator_id, law_name) a) b WHERE k <= 5) t ON d.indicator_id = t.indicator_id AND d.law_name = t.law_name""".replace("LEFT SEMI JOIN", "LEFT SEMI JOIN" if q.spark else "SEMI JOIN")


@query
def rank_decay(q):
    """Numbers that an answer names in order of mention, each once, and the score that falls with their rank: max(0.15, 1 - 0.08 rank)."""
    return f"""SELECT ref_id, cited, round(greatest(15e-2, 1e0 - 8e-2 * (row_number() OVER (PARTITION BY ref_id ORDER BY first_at) - 1)), 4) AS score FROM (SELECT ref_id, cited, min(spot) AS first_at FROM
      (SELECT ref_id, {q.numbered(q.every('rationale', '([0-9]+)'), 'spot', 'cited')} FROM ref_row WHERE rationale IS NOT NULL) m GROUP BY ref_id, cited) f"""


@query
def grader_metrics(q):
    """What a grader that accepts half of a name's words makes of pairs by kind: a reference row with the target of its own indicator, of a sibling
    indicator of its workbook, and of another workbook of the economy. Rows meet by their places in an order by hash, one with one."""
    place = lambda by, i: f"row_number() OVER (PARTITION BY {by} ORDER BY md5('5' || {i}), {i})"
    share = lambda a, b: f"{q.size(q.shared(a, b))} >= 0.5 * {q.size(a)} AND {q.size(a)} > 0"
    pillar = "split_part(indicator_id, '-', 1)"
    side = lambda i, c, t: f"(SELECT {i} AS id, workbook_id, economy, indicator_id, {plain_words(q, c)} AS words, {place('workbook_id, indicator_id', i)} AS own, {place(f'workbook_id, {pillar}', i)} AS kin, {place('economy', i)} AS any_ FROM {t} WHERE {c} IS NOT NULL)"
    return f"""WITH r AS {side('ref_id', 'law_name', 'ref_row')}, t AS {side('target_id', 'law_label', 'trace_target')},
      pairs AS (SELECT 'positive' AS kind, r.words AS a, t.words AS b FROM r JOIN t ON r.workbook_id = t.workbook_id AND r.indicator_id = t.indicator_id AND r.own = t.own
        UNION ALL SELECT 'sibling_negative', r.words, t.words FROM r JOIN t ON r.workbook_id = t.workbook_id AND split_part(r.indicator_id, '-', 1) = split_part(t.indicator_id, '-', 1) AND r.kin = t.kin AND r.indicator_id <> t.indicator_id
        UNION ALL SELECT 'random_negative', r.words, t.words FROM r JOIN t ON r.economy = t.economy AND r.any_ = t.any_ AND r.workbook_id <> t.workbook_id)
      SELECT kind, count(*) AS graded, round(avg(CASE WHEN {share('a', 'b')} THEN 1e0 ELSE 0e0 END), 6) AS accepted FROM pairs GROUP BY kind"""


@query
def weight_simplex(q):
    """Every blend of keyword, semantic and scope in steps of 0.05 and how well it tells the laws that reference rows of the economy name from the
    others: area under the curve by rank sums, the best first. The grid is 231 points, one pass over the scores."""
    steps = q.rows(q.array(*map(str, range(21))))
    return f"""WITH cited AS (SELECT DISTINCT economy, law_name FROM ref_row WHERE law_name IS NOT NULL),
      one AS (SELECT run_id, indicator_id, doc_id, max(economy) AS economy, max(law_name) AS law_name, coalesce(max(keyword), 0) AS k, coalesce(max(semantic), 0) AS s, coalesce(max(scope), 0) AS c FROM doc_rank GROUP BY run_id, indicator_id, doc_id),
      x AS (SELECT k / (SELECT max(k) FROM one) AS k, s / (SELECT max(s) FROM one) AS s, c / (SELECT max(c) FROM one) AS c, cited.law_name IS NOT NULL AS hit FROM one LEFT JOIN cited ON one.economy = cited.economy AND one.law_name = cited.law_name),
      i AS (SELECT *, {steps} AS i FROM x), g AS (SELECT *, {steps} AS j FROM i), w AS (SELECT i / 20e0 AS wk, j / 20e0 AS ws, (20 - i - j) / 20e0 AS wc, k, s, c, hit FROM g WHERE i + j <= 20),
      f AS (SELECT wk, ws, wc, round(wk * k + ws * s + wc * c, 6) AS f, count(*) AS n, count(*) FILTER (WHERE hit) AS p FROM w GROUP BY 1, 2, 3, 4),
      r AS (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY wk, ws, wc ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - p) / 2e0 AS below FROM f)
      SELECT wk, ws, wc, round(sum(p * below) / (sum(p) * sum(n - p)), 6) AS auc FROM r GROUP BY wk, ws, wc HAVING sum(p) > 0 AND sum(n - p) > 0"""


@query
def recovery_curve(q):
    """Where the laws that an economy's reference rows name stand in its rankings: found by each depth, the ninth tenth of the places, and laws met."""
    cut = lambda k: f"count(*) FILTER (WHERE place <= {k}) AS by_{k}"
    places = f"{'sort_array(collect_list(place))' if q.spark else 'list(place ORDER BY place)'}"
    p90 = f"element_at({places}, CAST(floor(0.9 * count(*)) AS INT) + 1)" if q.spark else f"({places})[CAST(floor(0.9 * count(*)) AS INT) + 1]"
    return f"""WITH one AS (SELECT run_id, indicator_id, doc_id, max(economy) AS economy, max(law_name) AS law_name, max(coalesce(keyword, 0) + coalesce(semantic, 0)) AS score FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM one), t AS (SELECT DISTINCT economy, law_name FROM ref_row WHERE law_name IS NOT NULL)
      SELECT r.economy, count(*) AS targets, {', '.join(cut(k) for k in (5, 10, 20, 40))}, {p90} AS p90, count(DISTINCT r.law_name) AS laws FROM r JOIN t ON r.economy = t.economy AND r.law_name = t.law_name GROUP BY r.economy"""


@query
def pool_size_sweep(q):
    """For each size of the reranker's pool, the share of national laws among the five that stand first after it."""
    sizes = q.rows(q.array("4", "8", "15", "25"))
    return f"""WITH one AS (SELECT run_id, indicator_id, doc_id, max(keyword) AS k, max({q.cross}) AS x, max(scope) AS s FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id),
      a AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY coalesce(k, 0) DESC, doc_id) AS place FROM one), z AS (SELECT *, {sizes} AS pool FROM a WHERE place <= 25),
      b AS (SELECT pool, s, row_number() OVER (PARTITION BY pool, run_id, indicator_id ORDER BY CASE WHEN place <= pool THEN 0 ELSE 1 END, CASE WHEN place <= pool THEN coalesce(x, -1e9) END DESC, place) AS k FROM z)
      SELECT pool, count(*) AS kept, round(avg(CASE WHEN s >= 1 THEN 1e0 ELSE 0e0 END), 6) AS national FROM b WHERE k <= 5 GROUP BY pool"""


@query
def added_candidates(q):
    """Candidates that a deeper cut adds to each ranking (places 6 to 9), and two of each by hash for a reader."""
    return """WITH one AS (SELECT run_id, indicator_id, doc_id, max(keyword) AS k FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id), a AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY coalesce(k, 0) DESC, doc_id) AS place FROM one),
      b AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY md5('7' || doc_id)) AS draw FROM a WHERE place BETWEEN 6 AND 9) SELECT run_id, indicator_id, doc_id, place FROM b WHERE draw <= 2"""


@query
def depth_config_eval(q):
    """For each depth of shortlist: candidates kept, the share of named laws among the found, and what a deeper list adds to the one before."""
    depths = q.rows(q.array("5", "10", "20", "40"))
    return f"""WITH one AS (SELECT run_id, indicator_id, doc_id, max(economy) AS economy, max(law_name) AS law_name, max(coalesce(keyword, 0) + coalesce(semantic, 0)) AS score FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY run_id, indicator_id, doc_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM one), t AS (SELECT DISTINCT economy, law_name FROM ref_row WHERE law_name IS NOT NULL),
      h AS (SELECT r.place, t.law_name IS NOT NULL AS hit FROM r LEFT JOIN t ON r.economy = t.economy AND r.law_name = t.law_name), c AS (SELECT *, {depths} AS depth FROM h WHERE place <= 40),
      k AS (SELECT depth, count(*) AS calls, count(*) FILTER (WHERE hit) AS hits FROM c WHERE place <= depth GROUP BY depth)
      SELECT depth, calls, hits, round(hits / (SELECT count(*) FROM h WHERE hit), 6) AS recall, hits - coalesce(lag(hits) OVER (ORDER BY depth), 0) AS added FROM k"""


@query
def f1_per_dollar(q):
    """Reading engines by quality for money: 1 - error rate times the share of results with a text, by pages read at each engine's price; no price, no rank."""
    return f"""WITH p AS (SELECT * FROM (VALUES ('rapid', 2e-3), ('paddle', 4e-3), ('azure', 1e-2)) t(provider, price)), m AS (SELECT provider, count(*) AS results, sum(greatest(coalesce({q.size('pages')}, 0), 1)) AS pages, avg(1 - coalesce(cer, 1)) AS precision_, avg(CASE WHEN coalesce(text, '') <> '' THEN 1e0 ELSE 0e0 END) AS recall FROM ocr_result GROUP BY provider)
      SELECT m.provider, CAST(pages AS BIGINT) AS pages, round(pages * price, 6) AS cost, round(2 * precision_ * recall / (precision_ + recall), 6) AS f1, round(2 * precision_ * recall / (precision_ + recall) / (pages * price), 6) AS f1_per_dollar FROM m LEFT JOIN p ON m.provider = p.provider"""


@query
def ocr_measure(q):
    """Each reading engine's results, pages, error rate and confidence; the ones that read a text layer or make texts up have no rate."""
    conf = q.map("pages", "p", "p.confidence") if q.spark else "list_transform(pages, lambda p: p.confidence)"
    return f"""SELECT provider, count(*) AS results, CAST(sum(coalesce({q.size('pages')}, 0)) AS BIGINT) AS pages, CASE WHEN provider NOT IN ('mock', 'text_layer') THEN round(avg(cer), 6) END AS cer, round(avg(c), 6) AS confidence FROM
      (SELECT ocr_id, provider, pages, cer, CASE WHEN {q.size('pages')} > 0 THEN {'aggregate(filter(' + conf + ', v -> v IS NOT NULL), 0D, (a, v) -> a + v) / nullif(size(filter(' + conf + ', v -> v IS NOT NULL)), 0)' if q.spark else 'list_avg(' + conf + ')'} END AS c FROM ocr_result) x GROUP BY provider"""


def _state(q) -> str:
    page = f"coalesce(html, {q.utf8('body')})"
    return f"""(SELECT economy, {q.one("coalesce(final_url, url)", '^[a-z]+://([^/?#]+)')} AS host, engine, CASE WHEN status >= 400 THEN 'failed' WHEN {page} IS NULL AND body IS NULL THEN 'empty' WHEN {q.has(f'lower({page})', 'id="root"|<noscript>')} AND NOT {q.has(f'lower({page})', '<(?:h[1-6]|p|li)[ >]')} THEN 'shell' WHEN length(trim(coalesce({page}, 'x'))) = 0 THEN 'empty' ELSE 'answers' END AS state, doc_id FROM fetched_page)"""


@query
def readiness_level(q):
    """How far each economy has come: laws measured, provisions extracted, a portal that answers, or only declared."""
    return f"""WITH e AS (SELECT economy FROM corpus_law UNION SELECT economy FROM fetched_page), p AS (SELECT economy, bool_or(state = 'answers') AS answers FROM {_state(q)} s GROUP BY economy), x AS (SELECT DISTINCT economy FROM provisions), m AS (SELECT DISTINCT economy FROM trace_target WHERE lost_at = 'SURVIVED')
      SELECT e.economy, CASE WHEN m.economy IS NOT NULL THEN 'measured' WHEN x.economy IS NOT NULL THEN 'extracted' WHEN p.answers THEN 'reachable' ELSE 'declared' END AS level FROM e LEFT JOIN p ON e.economy = p.economy LEFT JOIN x ON e.economy = x.economy LEFT JOIN m ON e.economy = m.economy WHERE e.economy IS NOT NULL"""


@query
def blocker_text(q):
    """The most telling thing that is wrong with each host's pages, the first of: shells, failures, empty pages; none if all answer."""
    return f"""SELECT host, count(*) AS pages, CASE WHEN bool_or(state = 'shell') THEN 'answers with a frame for scripts' WHEN bool_or(state = 'failed') THEN 'some pages fail' WHEN bool_or(state = 'empty') THEN 'some pages are empty' ELSE 'none' END AS blocker FROM {_state(q)} s WHERE host <> '' GROUP BY host"""


@query
def primary_portal(q):
    """The host to take as an economy's source: one that answers before others, a plain fetch before a browser, more pages, then the name."""
    return f"""SELECT economy, host, hosts FROM (SELECT economy, host, count(*) OVER (PARTITION BY economy) AS hosts, row_number() OVER (PARTITION BY economy ORDER BY answers DESC, plain DESC, pages DESC, host) AS k FROM
      (SELECT economy, host, max(CASE WHEN state = 'answers' THEN 1 ELSE 0 END) AS answers, max(CASE WHEN engine = 'static' THEN 1 ELSE 0 END) AS plain, count(*) AS pages FROM {_state(q)} s WHERE host <> '' AND economy IS NOT NULL GROUP BY economy, host) a) b WHERE k = 1"""


@query
def status_headline(q):
    """Targets by the three groups a headline names, and those without any."""
    return "SELECT economy, count(*) FILTER (WHERE lost_at = 'SURVIVED') AS accepted, count(*) FILTER (WHERE lost_at IN ('GRADING', 'RETRIEVAL')) AS in_review, count(*) FILTER (WHERE lost_at IN ('FETCH', 'DISCOVERY')) AS not_found, count(*) FILTER (WHERE lost_at IS NULL) AS unknown FROM trace_target GROUP BY economy"


@query
def engine_deltas(q):
    """Two reading engines beside each other in each economy: results, error rates and how far they are apart."""
    one = lambda e: f"round(avg(cer) FILTER (WHERE provider = '{e}'), 6)"
    return f"SELECT economy, count(*) FILTER (WHERE provider = 'rapid') AS rapid, count(*) FILTER (WHERE provider = 'paddle') AS paddle, {one('rapid')} AS rapid_cer, {one('paddle')} AS paddle_cer, round(avg(cer) FILTER (WHERE provider = 'paddle') - avg(cer) FILTER (WHERE provider = 'rapid'), 6) AS delta FROM ocr_result GROUP BY economy"


@query
def rerank_lanes(q):
    """The reranker a document's language has; a language without one has none, never the English one."""
    return """WITH m AS (SELECT * FROM (VALUES ('en', 'english'), ('eng', 'english'), ('zh', 'multilingual'), ('zh-cn', 'multilingual'), ('ru', 'multilingual'), ('rus', 'multilingual'), ('vi', 'multilingual')) t(code, reranker))
      SELECT lang, reranker, count(*) AS n FROM documents LEFT JOIN m ON lower(documents.lang) = m.code GROUP BY lang, reranker"""


@query
def language_flags(q):
    """Of every document's letters: the share in Latin script, in scripts without blanks, and what follows for reading it."""
    from lexloom.functions.text import NO_SPACE

    letters, latin, dense = (f"CAST(length({q.sub('text', p)}) AS DOUBLE)" for p in (r"\P{L}", r"[^A-Za-zÀ-ɏḀ-ỿ]", f"[^{NO_SPACE}]"))
    return f"SELECT doc_id, round(coalesce({latin} / nullif({letters}, 0), 0), 6) AS latin, round(coalesce({dense} / nullif({letters}, 0), 0), 6) AS dense, coalesce({dense} / nullif({letters}, 0), 0) >= 0.3 AS needs_segmentation FROM documents WHERE text IS NOT NULL"


@query
def source_queries(q):
    """The query each source is asked with for a pillar: a source's own where it has one for the pillar, else one made of the pillar's names."""
    return f"""WITH own AS (SELECT DISTINCT portal, economy FROM corpus_law WHERE portal IS NOT NULL), p AS (SELECT DISTINCT economy, {q.one('indicator_id', '^P([0-9]+)-')} AS pillar FROM label_row WHERE {q.has('indicator_id', '^P[0-9]+-')}),
      n AS (SELECT * FROM (VALUES ('lex-sg', '6', 'cross-border transfer'), ('lex-au', '7', 'privacy')) t(portal, pillar, narrowed))
      SELECT own.portal, p.pillar, coalesce(n.narrowed, 'pillar ' || p.pillar || ' ' || own.economy) AS query_ FROM own JOIN p ON own.economy = p.economy LEFT JOIN n ON own.portal = n.portal AND p.pillar = n.pillar"""


@query
def indicator_reference_merge(q):
    """What two sources say of each economy's indicators, put together: the panel's coverage before the key's, and where they disagree."""
    one = lambda t: f"(SELECT economy, indicator_id, max(lower(nullif(coverage, ''))) AS coverage, max(raw_score) AS score, count(*) AS n FROM {t} WHERE economy IS NOT NULL AND indicator_id IS NOT NULL GROUP BY economy, indicator_id)"
    return f"""SELECT coalesce(a.economy, b.economy) AS economy, coalesce(a.indicator_id, b.indicator_id) AS indicator_id, coalesce(a.coverage, b.coverage) AS coverage, coalesce(a.score, b.score) AS score, coalesce(a.n, 0) AS refs, coalesce(b.n, 0) AS labels, coalesce(a.coverage <> b.coverage, false) OR coalesce(a.score <> b.score, false) AS conflict
      FROM {one('ref_row')} a FULL OUTER JOIN {one('label_row')} b ON a.economy = b.economy AND a.indicator_id = b.indicator_id"""


@query
def reference_report(q):
    """What a reference set holds, by economy: rows, laws, sections, addresses, and rows that lack one of them."""
    n = lambda c: f"CAST(sum(coalesce({q.size(c)}, 0)) AS BIGINT)".replace("coalesce(size(", "coalesce(nullif(size(").replace("), 0))", "), -1), 0))") if q.spark else f"CAST(sum(coalesce(len({c}), 0)) AS BIGINT)"
    return f"SELECT economy, count(*) AS refs, count(DISTINCT law_name) AS laws, {n('sections')} AS sections, {n('source_urls')} AS addresses, count(*) FILTER (WHERE law_name IS NULL OR sections IS NULL OR rationale IS NULL) AS lacking FROM ref_row GROUP BY economy"


@query
def sections_by_law(q):
    """The sections cited for each law of an economy and indicator; where the panel names any, they go before those of the key."""
    rows = lambda t, law, rank: f"SELECT economy, indicator_id, law, {rank} AS source, {q.rows('sections')} AS s FROM (SELECT economy, indicator_id, {law} AS law, sections FROM {t} WHERE sections IS NOT NULL) x{rank} WHERE law IS NOT NULL"
    return f"""WITH a AS ({rows('ref_row', 'law_name', 1)} UNION ALL {rows('trace_target', 'law_label', 2)}), b AS (SELECT *, min(source) OVER (PARTITION BY economy, indicator_id, law) AS first_ FROM a WHERE s IS NOT NULL)
      SELECT economy, indicator_id, law, {q.join(_distinct(q, 's'), '|')} AS sections, max(source) AS source FROM b WHERE source = first_ GROUP BY economy, indicator_id, law"""


@query
def run_matrix(q):
    """Economies by pillars: rankings, candidates and laws of each cell."""
    return f"SELECT economy, {q.one('indicator_id', '^P([0-9]+)-')} AS pillar, count(DISTINCT run_id) AS runs, count(*) AS candidates, count(DISTINCT law_name) AS laws FROM doc_rank GROUP BY 1, 2"


@query
def run_notes(q):
    """One line on each run of incremental work."""
    return f"SELECT run_id, coalesce(outcome, 'never ended') || CASE WHEN note IS NOT NULL THEN ': ' || note ELSE '' END || ', ' || CAST(run_no AS {q.string}) AS said FROM corpus_run"


@query
def frequent_character_grams(q):
    """Grams of four characters of documents in scripts without blanks: the hundred in most documents."""
    runs = q.every("text", r"(\p{IsHan}{4,})" if q.spark else r"(\p{Han}{4,})")
    grams = "flatten(transform({r}, w -> transform(sequence(1, length(w) - 3), i -> substring(w, i, 4))))" if q.spark else "flatten(list_transform({r}, lambda w: list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4))))"
    return f"""SELECT gram, n FROM (SELECT gram, n, row_number() OVER (ORDER BY n DESC, gram) AS k FROM (SELECT gram, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, {q.rows(grams.format(r=runs))} AS gram FROM documents WHERE text IS NOT NULL) a GROUP BY gram) b) c WHERE k <= 100"""


@query
def duplicate_labels_three(q):
    """Laws with at least three section labels that occur more than once, in one run."""
    return "SELECT run_id, doc_id, count(*) AS repeated, CAST(sum(n) AS BIGINT) AS provisions FROM (SELECT run_id, doc_id, article_section, count(DISTINCT provision_id) AS n FROM provisions WHERE article_section IS NOT NULL AND doc_id IS NOT NULL GROUP BY run_id, doc_id, article_section HAVING count(DISTINCT provision_id) > 1) a GROUP BY run_id, doc_id HAVING count(*) >= 3"


@query
def bakeoff_pairs(q):
    """A set to compare graders on: of each indicator up to five pairs of a reference row with its rationale and five with that of another pillar's row
    of the economy, the next in an order by a seeded hash; rationales that many rows share are left out."""
    return """WITH r AS (SELECT ref_id, economy, indicator_id, law_name, rationale, count(*) OVER (PARTITION BY rationale) AS same FROM ref_row WHERE law_name IS NOT NULL AND rationale IS NOT NULL), f AS (SELECT * FROM r WHERE same <= 3),
      pos AS (SELECT indicator_id, ref_id, ref_id AS other_id, 1 AS label, row_number() OVER (PARTITION BY indicator_id ORDER BY md5('11' || ref_id)) AS k FROM f),
      o AS (SELECT *, row_number() OVER (PARTITION BY economy ORDER BY md5('11' || ref_id), ref_id) AS place FROM f),
      neg AS (SELECT a.indicator_id, a.ref_id, b.ref_id AS other_id, 0 AS label, row_number() OVER (PARTITION BY a.indicator_id ORDER BY md5('11' || a.ref_id)) AS k FROM o a JOIN o b ON a.economy = b.economy AND a.place = b.place - 1 WHERE split_part(a.indicator_id, '-', 1) <> split_part(b.indicator_id, '-', 1))
      SELECT indicator_id, ref_id, other_id, label FROM pos WHERE k <= 5 UNION ALL SELECT indicator_id, ref_id, other_id, label FROM neg WHERE k <= 5"""


@query
def freshness_of_links(q):
    """Laws that links lead to and whether the store has looked at them lately: a month before the newest look is stale, none is unverified."""
    month = "substring(last_checked, 1, 7)"
    return f"SELECT economy, CASE WHEN last_checked IS NULL THEN 'unverified' WHEN {month} < (SELECT max({month}) FROM corpus_law) THEN 'stale' ELSE 'verified' END AS state, count(*) AS laws FROM corpus_law GROUP BY 1, 2"
