"""The store and the fetching around it: states, checks, expiries, versions, pages, links, robots, readers."""

from __future__ import annotations

from lexloom.plans.dialects import registry
from lexloom.plans.naming_plans import host_path

QUERIES, ORACLE, query = registry()

#: Instants of writes, whatever zone they were written in; without a zone UTC.
INSTANT = {True: "TRY_CAST(CASE WHEN updated_at RLIKE '(Z|[+-][0-9]{2}(:?[0-9]{2})?)$' THEN updated_at ELSE updated_at || 'Z' END AS TIMESTAMP)", False: "TRY_CAST(CASE WHEN regexp_matches(updated_at, '(Z|[+-][0-9]{2}(:?[0-9]{2})?)$') THEN updated_at ELSE updated_at || 'Z' END AS TIMESTAMPTZ)"}


@query
def state_transitions(q):
    """Each version after all its writes: the latest state; of every other column the latest value that is not null; errors cut at 2,000 characters."""
    last = lambda c: f"max_by({c}, n) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    return f"""WITH o AS (SELECT DISTINCT version_id, state, substring(error, 1, 2000) AS error, content_sha256, chars, provisions_n, {INSTANT[q.spark]} AS t, write_seq FROM corpus_version WHERE version_id IS NOT NULL),
      w AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY t NULLS FIRST, write_seq NULLS FIRST, coalesce(state, ''), coalesce(error, ''), coalesce(content_sha256, ''), coalesce(chars, 0), coalesce(provisions_n, 0)) AS n FROM o)
      SELECT version_id, count(*) AS writes, {', '.join(map(last, ('state', 'error', 'content_sha256', 'chars', 'provisions_n')))} FROM w GROUP BY version_id"""


@query
def check_log(q):
    """The rows that checks of sources append: one for each economy and day of landing, with an id from both, what was looked at and what had changed."""
    day = f"CAST(CAST(landed_at AS DATE) AS {q.string})"
    return f"""SELECT substring({'sha1' if q.spark else 'sha1'}(economy || '|store|' || day_), 1, 16) AS check_id, economy, day_, count(DISTINCT version_id) AS n_checked, count(DISTINCT CASE WHEN state <> 'failed' THEN content_sha256 END) AS n_changed FROM
      (SELECT economy, {day} AS day_, version_id, state, content_sha256 FROM corpus_version WHERE economy IS NOT NULL AND landed_at IS NOT NULL) c GROUP BY economy, day_"""


@query
def session_purge(q):
    """Users' sessions of 12 hours from their last event: who is still in at the end of the log, and who was purged."""
    return """SELECT CASE WHEN last_ + INTERVAL 12 HOUR > (SELECT max(ts) FROM events) THEN 'live' ELSE 'purged' END AS state, count(*) AS users, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, max(ts) AS last_, count(*) AS n FROM events GROUP BY user_id) u GROUP BY 1"""


@query
def second_pass(q):
    """A second pass over documents that the store holds: how many there are to fetch, which is none, and to split again."""
    return """SELECT economy, count(*) AS known, count(*) FILTER (WHERE b.body_path IS NULL) AS to_fetch, count(*) FILTER (WHERE b.body_path IS NOT NULL AND coalesce(b.body, '') = '') AS empty FROM (SELECT DISTINCT economy, body_path FROM corpus_version WHERE body_path IS NOT NULL) v LEFT JOIN body_file b ON v.body_path = b.body_path GROUP BY economy"""


@query
def build_steps(q):
    """What each version still needs, from its latest write: to be fetched, extracted, split, or nothing; failed ones are tried again."""
    return f"""SELECT economy, CASE state WHEN 'discovered' THEN 'fetch' WHEN 'failed' THEN 'fetch' WHEN 'fetched' THEN 'extract' WHEN 'extracted' THEN 'split' ELSE 'nothing' END AS step, count(*) AS versions FROM
      (SELECT version_id, economy, state, row_number() OVER (PARTITION BY version_id ORDER BY {INSTANT[q.spark]} DESC NULLS LAST, write_seq DESC NULLS LAST, state) AS k FROM corpus_version WHERE version_id IS NOT NULL) w WHERE k = 1 GROUP BY 1, 2"""


@query
def version_parts(q):
    """Versions of a law numbered by the time each was first seen: <law>v1, v2, and so on."""
    return f"""SELECT version_id, law_id || 'v' || CAST(row_number() OVER (PARTITION BY law_id ORDER BY first_, version_id) AS {q.string}) AS part FROM (SELECT law_id, version_id, min({INSTANT[q.spark]}) AS first_ FROM corpus_version WHERE law_id IS NOT NULL AND version_id IS NOT NULL GROUP BY law_id, version_id) v"""


@query
def version_signals(q):
    """What tells one version of a law from another: the day its catalogue says it stands as at, else the day of an amendment, else its content."""
    as_at = [q.one("lower(coalesce(l.title, '') || ' ' || coalesce(l.catalogue_json, ''))", r"as at *[:-]? *([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", i) for i in (1, 2, 3)]
    day = f"{as_at[2]} || '-' || lpad({as_at[1]}, 2, '0') || '-' || lpad({as_at[0]}, 2, '0')"
    return f"""SELECT how, count(*) AS versions, count(DISTINCT signal) AS signals FROM (SELECT v.version_id, CASE WHEN {as_at[2]} <> '' THEN {day} WHEN v.amendment_date IS NOT NULL THEN v.amendment_date ELSE substring(v.content_sha256, 1, 12) END AS signal,
      CASE WHEN {as_at[2]} <> '' THEN 'as at' WHEN v.amendment_date IS NOT NULL THEN 'amended' WHEN v.content_sha256 IS NOT NULL THEN 'content' ELSE 'none' END AS how FROM corpus_version v LEFT JOIN corpus_law l ON v.law_id = l.law_id) s GROUP BY how"""


@query
def catalogue_complete(q):
    """Laws of each economy that the store has seen against those its catalogue declares."""
    return """SELECT l.economy, count(*) AS declared, count(v.law_id) AS seen, CASE WHEN count(v.law_id) = count(*) THEN 'complete' WHEN count(v.law_id) = 0 THEN 'not begun' ELSE 'incomplete' END AS verdict FROM (SELECT DISTINCT economy, law_id FROM corpus_law) l LEFT JOIN (SELECT DISTINCT law_id FROM corpus_version) v ON l.law_id = v.law_id GROUP BY l.economy"""


@query
def in_force_strict(q):
    """Documents whose law the register knows as in force, under the register's title; what can't be verified is dropped."""
    key = lambda c: "trim(" + q.sub(f"lower({c})", r"[^\p{L}\p{N}]+", " ") + ")"
    return f"""SELECT d.doc_id, coalesce(l.title, d.title) AS title FROM documents d JOIN (SELECT economy, {key('title')} AS k, min(title) AS title FROM corpus_law WHERE status = 'active' GROUP BY 1, 2) l ON d.economy = l.economy AND {key('d.title')} = l.k WHERE d.title IS NOT NULL"""


@query
def section_records(q):
    """Records of provisions that count as in force, their text put together from the first field that has one, without tags."""
    said = f"coalesce({q.field('prov_json', 'verbatim_snippet')}, {q.field('prov_json', 'text')})"
    return f"""SELECT DISTINCT p.provision_id, md5(trim({q.sub(q.sub(said, '<[^<>]*>', ' '), '[ \\t\\n]+', ' ')})) AS text_md5 FROM provisions p LEFT JOIN (SELECT DISTINCT economy, title FROM corpus_law WHERE status = 'repealed') r ON p.economy = r.economy AND p.law_name = r.title WHERE r.title IS NULL AND {said} IS NOT NULL"""


def page(q) -> str:
    """The text of a fetched page: of its html, else of its body where that is UTF-8."""
    return f"coalesce(html, {q.utf8('body')})"


def links(q) -> str:
    """(fetch_id, host, page, target): the links of every page, made whole with its address."""
    href = q.every(page(q), r'(?i)<a [^>]*href *= *["\x27]([^"\x27#]+)')
    base = "coalesce(final_url, url)"
    root = q.one(base, "^([a-zA-Z]+://[^/?#]+)")
    return f"""(SELECT fetch_id, host, page, CASE WHEN {q.has('h', '^[a-zA-Z]+:')} THEN h WHEN starts{'' if q.spark else '_'}with(h, '/') THEN root || h ELSE root || '/' || h END AS target FROM
      (SELECT fetch_id, {q.one(f'lower({base})', '^[a-z]+://([^/?#]+)')} AS host, {host_path(q, base)} AS page, {root} AS root, {q.rows(href)} AS h FROM fetched_page) x)"""


@query
def page_links(q):
    """The links of all pages by host: how many, to the same host, and to how many different pages."""
    return f"SELECT host, count(*) AS links, count(*) FILTER (WHERE {q.one('lower(target)', '^[a-z]+://([^/?#]+)')} = host) AS inside, count(DISTINCT target) AS targets FROM {links(q)} l GROUP BY host"


@query
def link_filter(q):
    """Links of pages that a site adapter takes: within the host, with a word of laws in the address, an id, and each once."""
    return f"SELECT DISTINCT host, target, {q.one('target', '([0-9a-f]{4,}|[0-9]{2,})')} AS id FROM {links(q)} l WHERE {q.one('lower(target)', '^[a-z]+://([^/?#]+)')} = host AND {q.has('lower(target)', '/(?:laws?|act|all|l|x)(?:[/?]|$)')}"


@query
def page_crawl(q):
    """A walk of two steps from each host's fetched pages along links within the host: pages by the least number of steps."""
    inside = f"(SELECT DISTINCT host, page AS a, {host_path(q, 'target')} AS b FROM {links(q)} l WHERE {q.one('lower(target)', '^[a-z]+://([^/?#]+)')} = host)"
    return f"""WITH e AS {inside}, s0 AS (SELECT DISTINCT {q.one("lower(coalesce(final_url, url))", '^[a-z]+://([^/?#]+)')} AS host, {host_path(q, 'coalesce(final_url, url)')} AS p FROM fetched_page),
      s1 AS (SELECT DISTINCT e.host, e.b AS p FROM e JOIN s0 ON e.host = s0.host AND e.a = s0.p), s2 AS (SELECT DISTINCT e.host, e.b AS p FROM e JOIN s1 ON e.host = s1.host AND e.a = s1.p),
      every_ AS (SELECT host, p, min(d) AS d FROM (SELECT host, p, 0 AS d FROM s0 UNION ALL SELECT host, p, 1 FROM s1 UNION ALL SELECT host, p, 2 FROM s2) u GROUP BY host, p) SELECT host, d AS steps, count(*) AS pages FROM every_ GROUP BY host, d"""


@query
def sitemap_ids(q):
    """Ids of laws in the addresses of each host's pages, each once, with the first page that has it."""
    return f"SELECT host, id, min(fetch_id) AS first_page, count(*) AS pages FROM (SELECT fetch_id, {q.one('lower(url)', '^[a-z]+://([^/?#]+)')} AS host, {q.rows(q.every('url', '(?:laws|lawId=|/act)/?([0-9a-f]{6,}|[0-9]+)'))} AS id FROM fetched_page) s GROUP BY host, id"


@query
def nested_sitemaps(q):
    """Sitemaps by two levels: hosts point to the first sign of their laws' ids, and those to the laws."""
    return f"""WITH leaf AS (SELECT DISTINCT {q.one('lower(source_url)', '^[a-z]+://([^/?#]+)')} AS host, {q.one('source_url', '/([0-9a-z]+)$')} AS id FROM corpus_law WHERE source_url IS NOT NULL), maps AS (SELECT host, substring(id, 1, 1) AS part, count(*) AS laws FROM leaf WHERE id <> '' GROUP BY 1, 2)
      SELECT host, count(*) AS maps, CAST(sum(laws) AS BIGINT) AS laws, max(laws) AS largest FROM maps GROUP BY host"""


@query
def search_results(q):
    """Addresses that search pages lead to: redirects unwrapped, one of each, the first five of an economy by place and address."""
    u = q.one("u", r"[?&](?:uddg|url|q|u)=([^&]+)")
    plain = f"replace(replace(replace({u}, '%3A', ':'), '%2F', '/'), '%3F', '?')"
    return f"""SELECT economy, target, place FROM (SELECT economy, target, row_number() OVER (PARTITION BY economy ORDER BY first_, target) AS place FROM (SELECT economy, CASE WHEN {u} <> '' THEN {plain} ELSE u END AS target, min(label_id) AS first_ FROM
      (SELECT economy, label_id, {q.rows('portal_urls')} AS u FROM label_row WHERE portal_urls IS NOT NULL UNION ALL SELECT economy, label_id, 'https://find.example/?uddg=' || replace(replace(x, ':', '%3A'), '/', '%2F') FROM (SELECT economy, label_id, {q.rows('other_urls')} AS x FROM label_row WHERE other_urls IS NOT NULL) o) a WHERE u IS NOT NULL GROUP BY 1, 2) b) c WHERE place <= 5"""


@query
def landing_body(q):
    """Where a law's body lies: its own address, else what follows from its landing page in the economy, and in which format."""
    body = "coalesce(body_url, CASE WHEN economy = 'AU' THEN source_url || '/latest/text' WHEN economy IN ('SG', 'MY') THEN source_url || '?view=print' ELSE source_url END)"
    return f"SELECT law_id, {body} AS body, CASE WHEN {q.has(f'lower({body})', '[.]pdf(?:[?#]|$)')} THEN 'pdf' WHEN {q.has(f'lower({body})', '[.]docx?(?:[?#]|$)')} THEN 'docx' WHEN {q.has(f'lower({body})', '[.]txt(?:[?#]|$)')} THEN 'text' ELSE 'html' END AS fmt FROM corpus_law"


@query
def embedded_files(q):
    """Documents that a page shows in a viewer: the address behind a viewer's file parameter or a frame's source, made whole."""
    at = q.one(page(q), r'(?i)(?:[?&]file=|<(?:iframe|embed|object)[^>]*(?:src|data) *= *["\x27])([^"\x27&]+)')
    root = q.one("coalesce(final_url, url)", "^([a-zA-Z]+://[^/?#]+)")
    return f"SELECT fetch_id, CASE WHEN {at} = '' THEN NULL WHEN {q.has(at, '^[a-zA-Z]+:')} THEN {at} ELSE {root} || '/' || {q.sub(at, '^/+')} END AS embedded, {at} <> '' AS shown_in_viewer FROM fetched_page"


@query
def conditional_reuse(q):
    """What a second fetch of each page may do: ask with a tag or a date, read the copy anew, or leave it; and whether the body is within 50 MB."""
    return """SELECT CASE WHEN status IN (304) THEN 'reuse' WHEN status >= 400 THEN 'fetch' WHEN html IS NULL AND body IS NULL THEN 'fetch' WHEN engine = 'browser' THEN 'render' ELSE 'ask' END AS next_, coalesce(octet_length(body) <= 52428800, true) AS within, count(*) AS pages FROM fetched_page GROUP BY 1, 2"""


@query
def seeded_cache(q):
    """The store of bodies after texts that came with a listing were put into it under their address's hash; what is there already stays."""
    return """SELECT origin, count(*) AS bodies, count(DISTINCT key_) AS keys FROM (SELECT origin, key_, row_number() OVER (PARTITION BY key_ ORDER BY origin) AS k FROM (SELECT 'cache' AS origin, md5(body_path) AS key_ FROM body_file UNION ALL SELECT 'seeded', md5(source_url) FROM documents WHERE text IS NOT NULL AND source_url IS NOT NULL) a) b WHERE k = 1 GROUP BY origin"""


@query
def engine_orders(q):
    """The engines to try on each host, in order: those that brought texts, by how often, then the others."""
    got = "CASE WHEN coalesce(status, 200) < 400 AND (html IS NOT NULL OR body IS NOT NULL) THEN 1 ELSE 0 END"
    host = q.one("lower(coalesce(final_url, url))", "^[a-z]+://([^/?#]+)")
    return f"SELECT host, engine, row_number() OVER (PARTITION BY host ORDER BY got DESC, engine) AS place FROM (SELECT {host} AS host, engine, CAST(sum({got}) AS BIGINT) AS got FROM fetched_page WHERE engine IS NOT NULL GROUP BY 1, 2) e"


@query
def triage_merge(q):
    """Whether each scan has a text layer: by its reader's own word (an error rate of 0), else by characters a page."""
    return f"SELECT ocr_id, CASE WHEN cer = 0 THEN 'text' WHEN coalesce(length(text), 0) >= 40 * greatest(coalesce({q.size('pages')}, 0), 1) THEN 'text' ELSE 'scanned' END AS kind, CASE WHEN cer = 0 THEN 'reader' ELSE 'density' END AS said_by FROM ocr_result"


@query
def engine_substitution(q):
    """The engine that reads a language's script: the first of the wanted order that can."""
    return """WITH can AS (SELECT * FROM (VALUES ('rapid', 'latin'), ('rapid', 'han'), ('paddle', 'latin'), ('paddle', 'han'), ('paddle', 'cyrillic')) t(provider, script)), want AS (SELECT * FROM (VALUES ('rapid', 1), ('paddle', 2)) w(provider, place)),
      s AS (SELECT ocr_id, provider, CASE WHEN economy IN ('CN') THEN 'han' WHEN economy IN ('RU', 'KZ', 'MN') THEN 'cyrillic' WHEN economy IN ('TH', 'LA') THEN 'other' ELSE 'latin' END AS script FROM ocr_result), best AS (SELECT script, min_by(want.provider, place) AS engine FROM can JOIN want ON can.provider = want.provider GROUP BY script)
      SELECT s.script, s.provider, best.engine, count(*) AS results FROM s LEFT JOIN best ON s.script = best.script GROUP BY 1, 2, 3"""


@query
def borderline_calls(q):
    """Candidates near the edge that get a second vote, and which of them a budget of forty calls a run covers, the nearest first."""
    return f"""SELECT run_id, indicator_id, doc_id, k <= 40 AS called FROM (SELECT run_id, indicator_id, doc_id, row_number() OVER (PARTITION BY run_id ORDER BY gap, indicator_id, doc_id) AS k FROM
      (SELECT run_id, indicator_id, doc_id, min(abs(semantic - 45e-2)) AS gap FROM doc_rank WHERE doc_id IS NOT NULL AND semantic IS NOT NULL AND semantic BETWEEN 3e-1 AND 6e-1 GROUP BY run_id, indicator_id, doc_id) a) b"""


@query
def content_overlap(q):
    """How many of a rationale's words of five letters and more a law's name has, and whether that is a strong hit."""
    words = lambda c: q.distinct(q.every(f"lower({c})", r"(\p{L}{5,})"))
    both = q.size(q.shared(words("law_name"), words("rationale")))
    return f"SELECT ref_id, {both} AS hits, {both} >= 2 AS strong FROM ref_row WHERE law_name IS NOT NULL AND rationale IS NOT NULL"


@query
def anchor_names(q):
    """The name that a page's links give a law: the first anchor marked as English, else the first anchor."""
    marked, first = (q.one(page(q), p) for p in (r"(?i)<a [^>]*>([^<]{4,})</a>\s*\((?:en|bi|english)\)", r"(?i)<a [^>]*>([^<]+)</a>"))
    return f"SELECT fetch_id, CASE WHEN {marked} <> '' THEN {marked} WHEN {first} <> '' THEN {first} END AS name, {marked} <> '' AS english FROM fetched_page"


@query
def guideline_names(q):
    """The name of a guideline or notice: the first line that names the kind, with the line after it where that begins with a capital."""
    lines = q.split("text", "\\n")
    hit = q.keep(lines, "l", q.has("l", "^(?:[Gg]uideline|GUIDELINE|[Nn]otice|NOTICE|[Cc]ircular|[Tt]hông tư|[Пп]оложение|通知)"))
    first = f"element_at({hit}, 1)" if q.spark else f"({hit})[1]"
    return f"SELECT doc_id, trim({first}) AS name FROM documents WHERE text IS NOT NULL AND {q.size(hit)} > 0"


@query
def law_name_chain(q):
    """A document's law name: its title where that is one; else the first line with a word of laws; else the title as it stands."""
    from lexloom.plans.naming_plans import LAW_WORD, cleaned, title_kind

    hit = q.keep(q.split("coalesce(text, '')", "\\n"), "l", f"{q.has('lower(l)', LAW_WORD)} AND length(l) BETWEEN 8 AND 120")
    first = f"trim(try_element_at({hit}, 1))" if q.spark else f"trim(({hit})[1])"
    own = f"{title_kind(q, 'title')} = 'named' AND {q.has('lower(' + cleaned(q, 'title') + ')', LAW_WORD)}"
    return f"SELECT doc_id, CASE WHEN {own} THEN {cleaned(q, 'title')} ELSE coalesce({first}, {cleaned(q, 'title')}) END AS law_name, CASE WHEN {own} THEN 'title' WHEN {first} IS NOT NULL THEN 'text' ELSE 'as it stands' END AS origin FROM documents"


@query
def location_references(q):
    """Where in its scan each page's text lies: its mark where the text has marks, else the place its length would have among all, else an anchor."""
    n = q.size("pages")
    texts = q.map("pages", "p", "length(coalesce(p.text, ''))")
    total = f"aggregate({texts}, 0, (a, v) -> a + v)" if q.spark else f"CAST(coalesce(list_sum({texts}), 0) AS BIGINT)"
    return f"""SELECT ocr_id, CASE WHEN {q.has('text', chr(12) + '[0-9]+' + chr(12))} THEN 'p. ' || {q.one('text', chr(12) + '([0-9]+)' + chr(12))} WHEN {n} > 0 THEN 'p. ~1 of ' || CAST({n} AS {q.string}) ELSE '#doc' || coalesce(doc_id, '') END AS location, coalesce(CASE WHEN {n} > 0 THEN CAST({total} AS BIGINT) END, 0) AS chars FROM ocr_result"""


# ---- access rules ---------------------------------------------------------------------------------------------------

AGENT = "lexloom-reader/1.0"
# Files of access rules of the hosts of the fixtures; a host that is not here could not be read.
ROBOTS = {
    "lex.sg.example": "User-agent: *\nDisallow: /laws/\nCrawl-delay: 5\n\nUser-agent: lexloom\nUser-agent: otherbot\nDisallow: /laws/0\nAllow: /laws/0a\nDisallow: /*?f=1.\n",
    "lex.au.example": "# open\nUser-agent: *\nDisallow:\n",
    "lex.my.example": "User-agent: *\nDisallow: /\nAllow: /laws/*?f=\nDisallow: /laws/f\nAllow: /laws/f\n",
    "lex.cn.example": "User-agent: lex\nDisallow: /laws/1\nUser-agent: lexloom-reader\nDisallow: /laws/*.$\nDisallow: /laws/*0$\n",
    "lex.vn.example": "User-agent: otherbot\nDisallow: /\n",
    "lex.ru.example": "User-agent: *\nAllow: /laws\nDisallow: /laws/2\n",
}
#: Hosts whose file can't be read and that are fetched by a written exception all the same.
EXCEPTIONS = {"lex.th.example": "agreed in writing"}
# The same rules by host as patterns, for the agent above: (host, pattern, its length, allowed).
RULES = [
    ("lex.sg.example", "^/laws/0", 7, False), ("lex.sg.example", "^/laws/0a", 8, True), ("lex.sg.example", "^/.*[?]f=1[.]", 7, False), ("lex.my.example", "^/", 1, False), ("lex.my.example", "^/laws/.*[?]f=", 10, True),
    ("lex.my.example", "^/laws/f", 7, False), ("lex.my.example", "^/laws/f", 7, True), ("lex.cn.example", "^/laws/.*[.]$", 9, False), ("lex.cn.example", "^/laws/.*0$", 9, False), ("lex.ru.example", "^/laws", 5, True), ("lex.ru.example", "^/laws/2", 7, False),
]
_VALUES = ", ".join(f"('{h}', '{p}', {n}, {str(a).lower()})" for h, p, n, a in RULES)
ROBOTS_SQL = f"""WITH r AS (SELECT * FROM (VALUES {_VALUES}) t(host, rule, n, allow)), f AS (SELECT * FROM (VALUES {', '.join(f"('{h}')" for h in ROBOTS)}) t(host)), e AS (SELECT * FROM (VALUES {', '.join(f"('{h}')" for h in EXCEPTIONS)}) t(host)),
  u AS (SELECT DISTINCT coalesce(final_url, url) AS url FROM fetched_page), p AS (SELECT url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^#]*)', 1) END AS path FROM u),
  m AS (SELECT p.url, p.host, max(struct_pack(n := r.n, allow := r.allow)) AS best FROM p LEFT JOIN r ON p.host = r.host AND regexp_matches(p.path, r.rule) GROUP BY 1, 2)
SELECT m.url, CASE WHEN f.host IS NULL THEN e.host IS NOT NULL ELSE coalesce(best.allow, true) END AS allowed, CASE WHEN f.host IS NULL AND e.host IS NOT NULL THEN 'exception' WHEN f.host IS NULL THEN 'unreadable' WHEN coalesce(best.allow, true) THEN '' ELSE 'disallowed' END AS reason FROM m LEFT JOIN f ON m.host = f.host LEFT JOIN e ON m.host = e.host"""


def robots_decisions(spark, d):
    """Whether each address may be fetched, and why not: the group of the most specific agent, the longest pattern that matches, permission
    on ties; hosts whose file can't be read only by a written exception."""
    from pyspark.sql import functions as F

    from lexloom.sources.files import decide, robots_rules
    from lexloom.sources.tables import table

    files = spark.createDataFrame(list(ROBOTS.items()), "host string, body string")
    exceptions = spark.createDataFrame(list(EXCEPTIONS.items()), "host string, why string")
    pages = table(spark, d, "fetched_page").select(F.coalesce("final_url", "url").alias("url")).distinct()
    return decide(pages, robots_rules(files), files.select("host"), exceptions, AGENT)


QUERIES["robots_decisions"], ORACLE["robots_decisions"] = robots_decisions, ROBOTS_SQL
