"""Names and identities of laws and their addresses: which title is one, which key groups, which spelling is shown."""

from __future__ import annotations

from lexloom.functions.text import HAN_ARTICLE, MONGOLIAN_ARTICLE, NO_SPACE
from lexloom.plans.dialects import registry

QUERIES, ORACLE, query = registry()

# Words of portals, kinds of laws, signs of amendments, consolidations and dead versions.
GENERIC = r"(?i)^\W*(?:home|index|download|untitled|document|legislation|search|acts?|laws?|portal|view|pdf|page)\W*(?:[0-9]*)\W*$"
LAW_WORD = r"(?i)\b(?:act|code|law|rules|regulations?|ordinance|order)\b|undang|peraturan|luật|nghị định|закон|положение|кодекс|法|条例|办法"
AMENDS = r"(?i)amend|perubahan|sửa đổi|изменени|修正"
CONSOLIDATED = r"(?i)consolidat|compilation"
DEAD = r"(?i)repealed|historical|superseded|revoked|ceased"
PORTAL = r"(?i)(?:\s*[|–-]\s*(?:official portal|legislation online|gazette|lex-[a-z]{2}))+\s*$"
PREFIX = r"(?i)^\s*\[?(?:pdf|html|docx?)\]?\s*[:|-]\s*"


def cleaned(q, c: str) -> str:
    return f"trim({q.sub(q.sub(f'trim({c})', PREFIX), PORTAL)})"


def wordlike(q, w: str) -> str:
    """Whether a token can be a word of a name: four Latin letters with a vowel, four other letters, or two of a script without blanks."""
    latin = q.sub(w, "[^A-Za-z]")
    return f"(CASE WHEN {latin} <> '' THEN length({latin}) >= 4 AND {q.has(latin, '[aeiouAEIOU]')} ELSE length({q.sub(w, '[^\\p{L}]')}) >= 4 OR {q.has(w, f'[{NO_SPACE}]{{2,}}')} END)"


def title_kind(q, c: str) -> str:
    t = cleaned(q, c)
    words = q.keep(q.split(t, r"\s+"), "w", wordlike(q, "w"))
    return f"""CASE WHEN coalesce({t}, '') = '' THEN 'blank' WHEN {q.has(t, GENERIC)} THEN 'generic' WHEN NOT {q.has(t, r'\p{L}{4,}')} AND NOT {q.has(t, f'[{NO_SPACE}]{{2,}}')} THEN 'wordless'
      WHEN {q.size(words)} = 0 THEN 'code' ELSE 'named' END"""


@query
def title_kinds(q):
    """Whether a title can be a law's name: documents' titles, file names of addresses and names as typed."""
    file = q.sub(q.one("url", r"/([^/?#]*)(?:[?#].*)?$"), r"[_.-]+", " ")
    return f"""SELECT kind, count(*) AS n, count(DISTINCT title) AS titles FROM (SELECT title, {title_kind(q, 'title')} AS kind FROM
      (SELECT title FROM documents UNION ALL SELECT {file} FROM fetched_page UNION ALL SELECT law_name FROM ref_row UNION ALL SELECT upper({q.one('title', '^([^ ]+ [^ ]+)')}) FROM corpus_law) t) k GROUP BY kind"""


def statute_id(q, url: str) -> str:
    """The number that an address gives a statute, whatever its other parts; null if none."""
    sl, act, my = q.one(url, r"(?i)/sl/[^?#]*?s([0-9]+)"), q.one(url, r"(?i)/(?:act|acts-supp|laws)/([a-z0-9]+(?:-[0-9]+)?)"), q.one(url, r"(?i)[?&/ _]act[=_ ]?(a?[0-9]+)")
    return f"CASE WHEN {sl} <> '' THEN 'sl-s' || {sl} WHEN {act} <> '' THEN 'act-' || lower({act}) WHEN {my} <> '' THEN 'no-' || lower({my}) END"


@query
def statute_ids(q):
    """Statute numbers of all addresses that a law, a page or a document has."""
    return f"""SELECT url, {statute_id(q, 'url')} AS statute FROM (SELECT source_url AS url FROM corpus_law UNION SELECT url FROM fetched_page UNION SELECT source_url FROM documents UNION SELECT final_url FROM fetched_page) u WHERE url IS NOT NULL"""


def law_key(q, c: str) -> str:
    t = q.sub(q.sub(f"lower({cleaned(q, c)})", r"\(?(?:amendment|amending|consolidated|consolidation)\)?", " "), r"(?:no\.?|act)\s*[0-9]+", " ")
    return f"trim({q.sub(q.sub(t, '(?:1[89]|20)[0-9]{2}', ' '), '[^\\p{L}]+', ' ')})"


def url_key(q, url: str) -> str:
    stem = q.sub(q.sub(q.sub(q.one(f"lower({url})", r"/([^/?#]*)/?(?:[?#].*)?$"), r"\.(?:pdf|html?|docx?|txt)$"), r"(?:1[89]|20)[0-9]{2}"), "[^a-z0-9]")
    ids = q.join(q.every(q.one(url, r"\?(.*)$"), r"([0-9]{2,})"), "")
    return f"({stem} || CASE WHEN {ids} <> '' THEN ':' || {ids} ELSE '' END)"


def dedup_key(q, title: str, url: str) -> str:
    """The statute's number in economies whose addresses have one; else the address where the title is no name; else the title's family."""
    by_url = f"'url:' || {url_key(q, url)}"
    return f"""CASE WHEN economy IN ('SG', 'MY') AND {statute_id(q, url)} IS NOT NULL THEN lower(economy) || ':' || {statute_id(q, url)} WHEN {title_kind(q, title)} <> 'named' THEN {by_url}
      WHEN {law_key(q, title)} <> '' THEN {law_key(q, title)} ELSE {by_url} END"""


@query
def dedup_keys(q):
    """The groups that documents and laws of an economy fall into."""
    return f"""SELECT economy, key_, count(*) AS members, count(DISTINCT title) AS titles FROM (SELECT economy, title, {dedup_key(q, 'title', 'source_url')} AS key_ FROM
      (SELECT economy, title, source_url FROM documents UNION ALL SELECT economy, title, source_url FROM corpus_law) a) k GROUP BY economy, key_"""


@query
def pick_best_nine(q):
    """Of each group the version that stands first by nine keys: in force, English, consolidated view, named, principal, consolidated,
    a file rather than a page, the latest year, the latest date; of equals the larger address."""
    flag = lambda test: f"CASE WHEN {test} THEN 1 ELSE 0 END"
    named = flag(q.has("lower(title)", LAW_WORD))
    year = f"coalesce(CASE WHEN {q.has('title', '(?:1[89]|20)[0-9]{2}')} THEN CAST({q.one('title', '((?:1[89]|20)[0-9]{2})')} AS INT) END, 0)"
    keys = [
        flag(f"NOT ({q.has('url', DEAD)} OR {q.has('title', DEAD)} OR status = 'repealed')"), flag(f"NOT (economy = 'MY' AND {q.has('title', '(?i)akta|undang-undang|peraturan')})"), flag(f"NOT {q.has('url', '(?i)/published/')}"),
        named, flag(f"NOT {q.has('lower(title)', AMENDS)}"), flag(q.has("title", CONSOLIDATED)), flag(q.has("url", r"(?i)\.pdf$")), year, "seen",
    ]
    order = ", ".join(f"{k} DESC" for k in keys)
    return f"""SELECT economy, key_, url, title FROM (SELECT *, row_number() OVER (PARTITION BY economy, key_ ORDER BY {order}, url DESC, title DESC) AS k FROM
      (SELECT economy, title, url, status, seen, {dedup_key(q, 'title', 'url')} AS key_ FROM (SELECT economy, title, coalesce(body_url, source_url) AS url, status, coalesce(last_checked, '') AS seen FROM corpus_law WHERE title IS NOT NULL
        UNION ALL SELECT economy, title, source_url, 'active', '' FROM documents WHERE title IS NOT NULL) a WHERE url IS NOT NULL) b) c WHERE k = 1"""


def host_path(q, url: str) -> str:
    return q.sub(q.sub(q.sub(f"lower(trim({url}))", r"^[a-z]+://(?:www\.)?"), "[?#].*$"), "/+$")


@query
def url_key_variants(q):
    """Three comparable forms of an address: host and path, the same without its ending, and host with the longest number in it."""
    numbers = q.every("url", r"([0-9]{2,})")
    longest = q.join(q.keep(numbers, "n", f"length(n) = (CASE WHEN {q.size(numbers)} = 0 THEN 0 ELSE {'array_max(transform(' + numbers + ', m -> length(m)))' if q.spark else 'list_max(list_transform(' + numbers + ', lambda m: length(m)))'} END)"), "-")
    p = host_path(q, "url")
    return f"""SELECT url, {p} AS page, {q.sub(p, r'\.(?:pdf|html?|aspx)$')} AS stem, {q.one(p, '^([^/]+)')} || '#' || {longest} AS by_id FROM (SELECT DISTINCT url FROM (SELECT url FROM fetched_page UNION ALL SELECT source_url FROM corpus_law UNION ALL SELECT source_url FROM documents) a WHERE url IS NOT NULL) u"""


TYPES = ("act", "code", "rules", "regulations", "ordinance", "order", "guideline", "circular", "licence")


def bilingual(q, c: str) -> str:
    """A title in small letters with the words of another official language as English ones, in a fixed order."""
    t = q.sub(f"lower({c})", r"[^\p{L}\p{N}]+", " ")
    for pattern, word in (("undang undang", "act"), (r"\bakta\b", "act"), ("peraturan pemerintah", "regulations"), (r"\bperaturan\b", "regulations"), (r"\bperintah\b", "order"), ("kod tata amalan", "code"), (r"\buntuk\b|\bbagi\b|\bdan\b|\btentang\b|\btahun\b", " ")):
        t = q.sub(t, pattern, word)
    return f"trim({q.sub(t, ' +', ' ')})"


def plain_words(q, c: str) -> str:
    t = q.sub(q.sub(bilingual(q, c), r"(?:1[89]|20)[0-9]{2}", " "), r"\b(?:the|of|and|no|nomor)\b", " ")
    return q.distinct(q.keep(q.split(t, " +"), "w", "length(w) > 2"))


@query
def bilingual_terms(q):
    return f"SELECT law_id, {bilingual(q, 'title')} AS english FROM corpus_law"


@query
def name_token_variants(q):
    """The words of a name by four rules: Latin ones of three letters, those and numbers of three signs, those of the bilingual form, and all."""
    stop = "'the', 'of', 'on', 'and', 'or', 'a', 'an', 'to', 'for', 'in', 'act', 'law', 'laws', 'no'"
    low = "lower(law_name)"
    latin = q.keep(q.every(low, "([a-z]{3,})"), "w", f"w NOT IN ({stop})")
    signs = q.keep(q.every(low, "([a-z0-9]+)"), "w", f"w NOT IN ({stop}) AND length(w) > 2")
    every = q.every(low, r"([\p{L}\p{N}]+)")
    shown = lambda a: q.join(a, " ")
    return f"SELECT ref_id, {shown(q.distinct(latin))} AS latin, {shown(q.distinct(signs))} AS signs, {shown(plain_words(q, 'law_name'))} AS plain, {shown(q.distinct(every))} AS every_word FROM ref_row WHERE law_name IS NOT NULL"


@query
def name_folds(q):
    """Names in small letters and common widths, without brackets, punctuation and what every title of an economy has."""
    wide = "".join(chr(c) for c in range(0xFF10, 0xFF5B) if chr(c).isalnum())
    thin = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    t = q.sub(f"lower(translate(law_name, '{wide}', '{thin}'))", r"[（(《【\[][^）)》】\]]*[）)》】\]]", " ")
    t = f"' ' || {q.sub(t, '[^\\p{L}\\p{N}]+', '  ')} || ' '"
    t = q.sub(f"({t})", " (?:the|of|republic|kingdom|people  s|act|law|no|nomor|tahun|1[89][0-9][0-9]|20[0-9][0-9]) ", " ")
    return f"SELECT fold, count(*) AS names, count(DISTINCT law_name) AS spellings FROM (SELECT law_name, trim({q.sub(t, ' +', ' ')}) AS fold FROM (SELECT law_name FROM ref_row UNION ALL SELECT law_label FROM trace_target) a WHERE law_name IS NOT NULL) b GROUP BY fold"


@query
def type_compatible(q):
    """Whether a label and the reference name of its workbook and indicator agree on the kind of instrument: what the label says the name says too.
    Labels and names of equal place by id meet."""
    a, b = bilingual(q, "t.law_label"), bilingual(q, "r.law_name")
    clash = " OR ".join(f"({q.has(a, rf'\b{w}\b')} AND NOT {q.has(b, rf'\b{w}\b')})" for w in TYPES)
    return f"SELECT r.ref_id, t.target_id, NOT ({clash}) AS compatible FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, indicator_id ORDER BY ref_id) AS place FROM ref_row WHERE law_name IS NOT NULL) r JOIN (SELECT *, row_number() OVER (PARTITION BY workbook_id, indicator_id ORDER BY target_id) AS place FROM trace_target WHERE law_label IS NOT NULL) t ON r.workbook_id = t.workbook_id AND r.indicator_id = t.indicator_id AND r.place = t.place"


def short_ref(q, c: str) -> str:
    latin = q.sub(q.sub(f"trim({c})", r"(?i)^(?:sections?|secs?\.?|s\.)\s*", "§"), r"^(?:[Aa]rticles?|ARTICLE|[Aa]rts?\.?|[Pp]asal|[Đđ]iều|[Сс]татья|СТАТЬЯ)\s*", "Art ")
    short = f"trim({q.sub(q.sub(latin, r'[–—-]\s*[0-9]+.*$', '+'), r'\(.*$')})"
    han, mn = q.one(c, HAN_ARTICLE), q.one(f"lower({c})", MONGOLIAN_ARTICLE)
    return f"""CASE WHEN {c} IS NULL OR trim({c}) IN ('', '—') THEN '·' WHEN trim({c}) = '(document)' THEN 'doc' WHEN {q.has(han, '^[0-9]+$')} THEN '§' || CAST(TRY_CAST({han} AS BIGINT) AS {q.string})
      WHEN {mn} <> '' THEN '§' || CAST(TRY_CAST({mn} AS BIGINT) AS {q.string}) ELSE substring({short}, 1, 6) END"""


@query
def short_reference(q):
    """A citation as a narrow cell shows it."""
    return f"SELECT ref, count(*) AS n, count(DISTINCT article_section) AS writings FROM (SELECT article_section, {short_ref(q, 'article_section')} AS ref FROM provisions UNION ALL SELECT primary_section, {short_ref(q, 'primary_section')} FROM trace_target) a GROUP BY ref"


@query
def pillar_selection(q):
    """The pillars that a choice names: all (6 and 7), all12, or a list; the choices are those of the workbooks and the two words."""
    chosen = f"CASE WHEN choice = 'all' THEN {q.array('6', '7')} WHEN choice = 'all12' THEN {q.array(*map(str, range(1, 13)))} ELSE {q.sort(q.map(q.keep(q.split('choice', ' *, *'), 'w', q.has('w', '^[0-9]+$')), 'w', 'CAST(w AS INT)'))} END"
    of = q.join(q.sort(f"{'collect_set' if q.spark else 'list'}({'DISTINCT ' if not q.spark else ''}{q.one('indicator_id', '^P([0-9]+)')})"), ", ")
    return f"SELECT choice, {q.rows(chosen)} AS pillar FROM (SELECT {of} AS choice FROM ref_row WHERE {q.has('indicator_id', '^P[0-9]+-')} GROUP BY workbook_id UNION SELECT 'all' UNION SELECT 'all12') c"


@query
def law_timelines(q):
    """Each law's timeline of amendments, written as JSON and read again: one entry means it stands as it was made, else its latest date."""
    dates = f"{'collect_set' if q.spark else 'list'}({'DISTINCT ' if not q.spark else ''}amendment_date)"
    timeline = f"'{{\"items\":[\"' || {q.join(q.sort(dates), '\",\"')} || '\"]}}'"
    found = q.every("timeline", r"([0-9]{4}-[0-9]{2}-[0-9]{2})")
    top = f"array_max({found})" if q.spark else f"list_max({found})"
    return f"""SELECT law_id, timeline, CASE WHEN {q.size(found)} = 0 THEN NULL WHEN {q.size(found)} = 1 THEN 'Original' ELSE {top} END AS last_amended FROM (SELECT law_id, {timeline} AS timeline FROM corpus_version WHERE amendment_date IS NOT NULL AND law_id IS NOT NULL GROUP BY law_id) t"""


@query
def print_widget_strip(q):
    """Documents without a print dialogue's list of provisions, widgets and share links, and what is left of each."""
    t = q.sub(q.sub("text", r"(?is)Select the provisions you wish to print.*?(No\. S [0-9]+)", "$1"), r"(?im)^[ \t]*(?:print|share|download|back to top|skip to content|\[link\])[ \t]*$", "")
    return f"SELECT doc_id, length(text) - length({t}) AS cut, md5({t}) AS text_md5 FROM documents WHERE text IS NOT NULL"


@query
def phrase_eligibility(q):
    """Whether a query term is a phrase: two words, or three characters of a script without blanks."""
    bare = lambda c: q.sub(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$")
    return f"SELECT DISTINCT term, {q.size(q.split('term', ' +'))} >= 2 OR ({q.has('term', f'[{NO_SPACE}]')} AND length(term) >= 3) AS phrase FROM (SELECT {bare('law_name')} AS term FROM ref_row WHERE law_name IS NOT NULL UNION ALL SELECT {q.rows(q.split(bare('law_label'), ' +'))} FROM trace_target WHERE law_label IS NOT NULL) t"


@query
def indicator_parts(q):
    """Pillar and number of every indicator that a table names."""
    a, b = q.one("indicator_id", "^P([0-9]+)-I([0-9]+)$", 1), q.one("indicator_id", "^P([0-9]+)-I([0-9]+)$", 2)
    return f"SELECT indicator_id, CASE WHEN {a} <> '' THEN CAST({a} AS INT) END AS pillar, CASE WHEN {b} <> '' THEN CAST({b} AS INT) END AS number, count(*) AS n FROM (SELECT indicator_id FROM ref_row UNION ALL SELECT indicator_id FROM label_row UNION ALL SELECT indicator_id FROM trace_target UNION ALL SELECT indicator_id FROM doc_rank) i GROUP BY indicator_id"


@query
def prose_citations(q):
    """Sections, numbers of acts and addresses named in running text, in order of mention, each once."""
    section = q.every("said", r"(?i)(?:section|pasal|ayat|clause|rule|regulation|статья|статьи|Điều|第)\s*([0-9]+[A-Za-z]?(?:\([0-9a-z]+\))*)")
    return f"""SELECT source, id, cited, count(*) AS n FROM (SELECT source, id, {q.rows(section)} AS cited FROM (SELECT 'ref' AS source, ref_id AS id, rationale AS said FROM ref_row UNION ALL SELECT 'label', label_id, impact FROM label_row) t WHERE said IS NOT NULL) c GROUP BY source, id, cited"""


@query
def currency_flags(q):
    """What addresses and titles say of their version: as published, or no longer in force."""
    return f"SELECT economy, {q.has('url', '(?i)/published/')} AS as_published, {q.has('url', DEAD)} OR {q.has('title', DEAD)} OR repealed AS superseded, count(*) AS n FROM (SELECT economy, coalesce(source_url, '') AS url, coalesce(title, '') AS title, coalesce(status = 'repealed', false) AS repealed FROM corpus_law UNION ALL SELECT economy, coalesce(source_url, ''), coalesce(title, ''), false FROM documents) a GROUP BY 1, 2, 3"


@query
def language_of_law(q):
    """Whether a law is to be read as English or in another official language: English marks of the address first, then others, then the title."""
    return f"SELECT law_id, CASE WHEN {q.has('url', '(?i)/en/|_bi[.]|language=bi')} THEN 'English' WHEN {q.has('url', '(?i)/ms/|_bm[.]|language=bm|/akta/')} THEN 'other' WHEN {q.has('lower(title)', 'akta|undang|peraturan|luật|nghị|закон|положение|法|条例|办法')} THEN 'other' ELSE 'English' END AS language FROM (SELECT law_id, title, coalesce(body_url, source_url, '') AS url FROM corpus_law) a"
