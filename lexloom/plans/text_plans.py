"""Queries on the text functions, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _held(pattern: str) -> str:
    """A pattern as it may stand in a template that is formatted later."""
    return pattern.replace("{", "{{").replace("}", "}}")


TOKENS_SQL = f"flatten(list_transform(regexp_extract_all(lower({{c}}), '({_held(T.TOKEN_RUNS)})', 1), lambda r: CASE WHEN regexp_matches(r, '^[{_held(T.NO_SPACE)}]{{{{2,}}}}$') THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))"


def tokens_sql(c: str) -> str:
    return TOKENS_SQL.format(c=c)


YEARS_SQL = r"list_transform(regexp_extract_all({c}, '(?:^|[^0-9])((?:1[89]|20)[0-9]{{2}})(?:$|[^0-9])', 1), lambda y: CAST(y AS INT))"
LATEST_SQL = f"coalesce(list_max({YEARS_SQL}), 0)"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(trim({c}), '(?i)^\s*\[?(pdf|html|docx?)\]?\s*[:|-]\s*', ''), '(?i)(\s*[|–-]\s*(official portal|legislation online|gazette|lex-[a-z]{{2}}))+\s*$', ''))"
LAW_KEY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\(?(?:amendment|amending|consolidated|consolidation)\)?', ' ', 'g'), '(?:no\.?|act)\s*[0-9]+', ' ', 'g'), '(?:1[89]|20)[0-9]{{2}}', ' ', 'g'), '[^\p{{L}}]+', ' ', 'g'))"
HOST_PATH_SQL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^[a-z]+://(?:www\.)?', ''), '[?#].*$', ''), '/+$', '')"
HAN_UNITS_SQL = "一二三四五六七八九"


def han_sql(x: str) -> str:
    """The number of Chinese numerals up to the thousands, by their units."""
    x = f"translate({x}, '零两', '〇二')"
    digit = lambda e: f"CASE WHEN {e} = '' THEN 0 ELSE instr('{HAN_UNITS_SQL}', {e}) END"
    units = [f"CASE WHEN contains({x}, '{u}') THEN greatest(1, " + digit(f"regexp_extract({x}, '([{HAN_UNITS_SQL}]){u}', 1)") + f") * {n} ELSE 0 END" for u, n in (("千", 1000), ("百", 100), ("十", 10))]
    ones = digit(f"regexp_extract({x}, '([{HAN_UNITS_SQL}])$', 1)")
    return f"CASE WHEN regexp_matches({x}, '^[〇{HAN_UNITS_SQL}十百千]+$') THEN {' + '.join(units)} + {ones} END"


_CHUNKS = f"string_split_regex(regexp_replace({{c}}, '{_held(T.LABEL_WORDS)}', ' ', 'g'), '[;,]| and ')"
_BASE, _SUBS = (f"lower(regexp_extract(k, '{_held(T.CITED)}', {i}))" for i in (1, 2))
SPINE_SQL = (
    f"list_sort(list_distinct(list_filter(flatten([list_transform(regexp_extract_all({{c}}, '{_held(T.HAN_ARTICLE)}', 1), lambda h: CASE WHEN regexp_matches(h, '^[0-9]+$') THEN CAST(TRY_CAST(h AS BIGINT) AS VARCHAR) ELSE CAST({han_sql('h')} AS VARCHAR) END), "
    f"regexp_extract_all(lower({{c}}), '{_held(T.MONGOLIAN_ARTICLE)}', 1), list_transform(regexp_extract_all({{c}}, '(?i)\\bAPP\\s*([0-9]+(?:\\.[0-9]+)?)', 1), lambda a: 'app' || a), "
    f"list_transform({_CHUNKS}, lambda k: {_BASE}), list_transform({_CHUNKS}, lambda k: {_BASE} || {_SUBS}), list_transform({_CHUNKS}, lambda k: regexp_extract({_BASE}, '^([^.]*)', 1))]), lambda x: x IS NOT NULL AND x <> '')))"
)
SECTION_KEY_SQL = r"CASE WHEN regexp_matches(lower({c}), '^\s*(?:part|chapter|schedule|bab|chương|глава|附表)') THEN NULL WHEN regexp_extract(upper({c}), '([0-9]+[A-Z]{{0,2}}(?:\.[0-9]+)*)', 1) <> '' THEN regexp_extract(upper({c}), '([0-9]+[A-Z]{{0,2}}(?:\.[0-9]+)*)', 1) END"
LABEL_SQL = r"""CASE WHEN regexp_matches(lower(t), '^(?:app|australian privacy principle|principle)\s*[0-9]') THEN 'APP ' || regexp_extract(t, '([0-9]+(?:\.[0-9]+)?)', 1) WHEN regexp_matches(lower(t), '^(?:section|sec\.?|s\.?|art\.?|article)?\s*[0-9]+[a-z]?$') THEN 'Section ' || n WHEN regexp_matches(lower(t), '^pasal\s*[0-9]') THEN 'Pasal ' || n
  WHEN regexp_matches(lower(t), '^điều\s*[0-9]') THEN 'Điều ' || n WHEN regexp_matches(lower(t), '^статья\s*[0-9]') THEN 'Статья ' || n ELSE t END"""
STOP = ["the", "and", "act", "law", "code", "rules", "regulations", "ordinance", "undang", "peraturan", "tahun", "luật", "закон", "года"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
NAME_TOKENS_SQL = "list_sort(list_filter(list_distinct(" + TOKENS_SQL + f"), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL})))"


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize_script_aware(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT law_id, {CLEAN_SQL.format(c='''title || ' | Official Portal - lex-' || lower(economy)''')} AS title FROM corpus_law")
def title_clean(spark, d):
    t = F.concat("title", F.lit(" | Official Portal - lex-"), F.lower("economy"))
    return table(spark, d, "corpus_law").select("law_id", T.clean_title(t).alias("title"))


@query(f"SELECT doc_id, {LATEST_SQL.format(c='title')} AS latest_year FROM documents")
def latest_year(spark, d):
    return table(spark, d, "documents").select("doc_id", T.latest_year(F.col("title")).alias("latest_year"))


@query(f"SELECT economy, {LAW_KEY_SQL.format(c='title')} AS law_key, count(*) AS laws, max({LATEST_SQL.format(c='title')}) AS latest FROM corpus_law GROUP BY 1, 2")
def law_key_group(spark, d):
    t = table(spark, d, "corpus_law").select("economy", T.law_key(F.col("title")).alias("law_key"), T.latest_year(F.col("title")).alias("y"))
    return t.groupBy("economy", "law_key").agg(F.count("*").alias("laws"), F.max("y").alias("latest"))


@query(
    rf"""SELECT fetch_id, concat_ws(':', regexp_replace(regexp_replace(regexp_replace(regexp_extract({HOST_PATH_SQL.format(c='url')}, '([^/]+)$', 1), '\.(?:pdf|html?|docx?|txt)$', ''), '(?:1[89]|20)[0-9]{{2}}', '', 'g'), '[^a-z0-9]', '', 'g'),
    nullif(array_to_string(regexp_extract_all(url, '[?&=:]([0-9]{{2,}})', 1), '-'), '')) AS law_key FROM fetched_page"""
)
def url_law_key(spark, d):
    return table(spark, d, "fetched_page").select("fetch_id", T.url_law_key(F.col("url")).alias("law_key"))


@query(f"SELECT {HOST_PATH_SQL.format(c='url')} AS page, count(*) AS fetches FROM fetched_page GROUP BY 1")
def url_canonical(spark, d):
    return table(spark, d, "fetched_page").groupBy(T.url_host_path(F.col("url")).alias("page")).agg(F.count("*").alias("fetches"))


@query(rf"SELECT law_id, trim(regexp_replace(trim(regexp_replace(lower({CLEAN_SQL.format(c='title')}), '[^a-z0-9]+', ' ', 'g')), ' (?:1[89]|20)[0-9]{{2}}$', '')) AS identity FROM corpus_law")
def law_identity(spark, d):
    return table(spark, d, "corpus_law").select("law_id", T.law_identity(F.col("title")).alias("identity"))


@query(f"SELECT ref_id, array_to_string({NAME_TOKENS_SQL.format(c='law_name')}, ' ') AS words FROM ref_row WHERE law_name IS NOT NULL")
def name_tokens(spark, d):
    return table(spark, d, "ref_row").where("law_name is not null").select("ref_id", F.array_join(T.name_tokens(F.col("law_name"), STOP), " ").alias("words"))


@query(f"SELECT doc_id, array_to_string({SPINE_SQL.format(c='article_section')}, '|') AS spine, count(*) AS n FROM provisions WHERE article_section IS NOT NULL GROUP BY 1, 2")
def article_spine(spark, d):
    p = table(spark, d, "provisions").where("article_section is not null")
    return p.groupBy("doc_id", F.array_join(T.article_spine(F.col("article_section")), "|").alias("spine")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {SECTION_KEY_SQL.format(c='article_section')} AS section_key, count(*) AS n FROM provisions GROUP BY 1, 2")
def section_key(spark, d):
    return table(spark, d, "provisions").groupBy("doc_id", T.section_key(F.col("article_section")).alias("section_key")).agg(F.count("*").alias("n"))


HAN_TERM = "([〇零一二两三四五六七八九十百千]+)"


@query(
    f"""WITH n AS (SELECT unnest(regexp_extract_all(text, '{HAN_TERM}', 1)) AS numeral FROM documents WHERE text IS NOT NULL UNION ALL SELECT unnest(regexp_extract_all(article_section, '{HAN_TERM}', 1)) FROM provisions WHERE article_section IS NOT NULL
    UNION ALL SELECT * FROM (VALUES ('十'), ('二十'), ('九十九'), ('一百'), ('一百零一'), ('一百一十'), ('九百九十九'), ('一千零一'), ('两千三百'), ('〇')) t(numeral)) SELECT numeral, CAST({han_sql('numeral')} AS INT) AS value, count(*) AS n FROM n GROUP BY 1"""
)
def han_numerals(spark, d):
    """Every run of Chinese numerals in documents and labels, and some that may not occur, with its number."""
    found = lambda t, c: table(spark, d, t).where(F.col(c).isNotNull()).select(F.explode(F.regexp_extract_all(c, F.lit(HAN_TERM), 1)).alias("numeral"))
    more = spark.createDataFrame([(n,) for n in "十 二十 九十九 一百 一百零一 一百一十 九百九十九 一千零一 两千三百 〇".split()], "numeral string")
    n = found("documents", "text").union(found("provisions", "article_section")).union(more).groupBy("numeral").agg(F.count("*").alias("n"))
    return n.select("numeral", T.han_to_int(F.col("numeral")).alias("value"), "n")


@query(rf"WITH a AS (SELECT doc_id, trim(regexp_replace(article_section, '[.:;,\s]+$', '')) AS t FROM provisions), b AS (SELECT doc_id, t, upper(regexp_extract(t, '([0-9]+[A-Za-z]?)', 1)) AS n FROM a) SELECT doc_id, {LABEL_SQL} AS label, count(*) AS n FROM b GROUP BY 1, 2")
def label_normalise(spark, d):
    return table(spark, d, "provisions").groupBy("doc_id", T.label(F.col("article_section")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT indicator_id, CASE WHEN regexp_matches(indicator_id, '^P[0-9]+-I[0-9]+$') THEN CAST(CAST(regexp_extract(indicator_id, '^P([0-9]+)', 1) AS INT) AS VARCHAR) || '.' || CAST(CAST(regexp_extract(indicator_id, '-I([0-9]+)$', 1) AS INT) AS VARCHAR) END AS code FROM doc_rank")
def code_convert(spark, d):
    return table(spark, d, "doc_rank").select("indicator_id", T.code(F.col("indicator_id")).alias("code")).distinct()


MONTHS_SQL = ", ".join(f"'{m}'" for m in T.MONTHS)


@query(
    rf"""SELECT version_id, write_seq, CASE WHEN amendment_date = 'Original' THEN amendment_date
    WHEN regexp_matches(amendment_date, '^[0-9]{{4}}-(?:0[1-9]|1[0-2])') THEN ([{MONTHS_SQL}])[CAST(substring(amendment_date, 6, 2) AS INT)] || ' ' || substring(amendment_date, 1, 4)
    WHEN regexp_matches(amendment_date, '^[0-9]{{4}}') THEN substring(amendment_date, 1, 4) WHEN {LATEST_SQL.format(c='title')} > 0 THEN CAST({LATEST_SQL.format(c='title')} AS VARCHAR) END AS last_amended
    FROM corpus_version v LEFT JOIN corpus_law l ON v.law_id = l.law_id"""
)
def last_amended_format(spark, d):
    v = table(spark, d, "corpus_version").select("version_id", "write_seq", "law_id", "amendment_date").join(table(spark, d, "corpus_law").select("law_id", "title"), "law_id", "left")
    return v.select("version_id", "write_seq", T.last_amended(F.col("amendment_date"), F.col("title")).alias("last_amended"))


INSTRUMENT = [("COMMENTARY", "guide to|explanatory|commentary"), ("DRAFT", "draft|bill,"), ("REPEALED", "repealed|revoked"), ("AMENDING", "amendment|amending|perubahan|sửa đổi|изменени|修正案")]


@query("SELECT law_id, CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{k}'" for k, p in INSTRUMENT) + " ELSE 'SCOREABLE' END AS status FROM corpus_law")
def instrument_status(spark, d):
    c = None
    for k, p in INSTRUMENT:
        hit = F.lower("title").rlike(p)
        c = F.when(hit, k) if c is None else c.when(hit, k)
    return table(spark, d, "corpus_law").select("law_id", c.otherwise("SCOREABLE").alias("status"))


SCRIPT = {"CN": ("\\p{IsHan}", "\\p{Han}"), "RU": ("\\p{IsCyrillic}", "\\p{Cyrillic}"), "KZ": ("\\p{IsCyrillic}", "\\p{Cyrillic}")}


@query(
    r"""SELECT doc_id, round(coalesce((length(s) - length(regexp_replace(s, CASE economy WHEN 'CN' THEN '\p{Han}' WHEN 'RU' THEN '\p{Cyrillic}' WHEN 'KZ' THEN '\p{Cyrillic}' ELSE '\p{Latin}' END, '', 'g'))) / nullif(length(regexp_replace(s, '\P{L}', '', 'g')), 0), 0), 6) AS validity
    FROM (SELECT doc_id, economy, substring(text, 1, 4000) AS s FROM documents WHERE text IS NOT NULL)"""
)
def script_validity(spark, d):
    """Share of letters in the script that the economy writes in, over the first 4,000 characters."""
    doc = table(spark, d, "documents").where("text is not null").select("doc_id", "economy", F.substring("text", 1, 4000).alias("s"))
    own = F.length("s") - F.length(F.regexp_replace("s", r"\p{IsLatin}", ""))
    for e, (java, _) in SCRIPT.items():
        own = F.when(F.col("economy") == e, F.length("s") - F.length(F.regexp_replace("s", java, ""))).otherwise(own)
    letters = F.nullif(F.length(F.regexp_replace("s", r"\P{L}", "")), F.lit(0))
    return doc.select("doc_id", F.round(F.coalesce(own / letters, F.lit(0.0)), 6).alias("validity"))


@query("SELECT doc_id, coalesce((length(s) - length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g'))) / nullif(length(s), 0), 0) < 0.15 AS ascii FROM (SELECT doc_id, substring(text, 1, 1000) AS s FROM documents WHERE text IS NOT NULL)")
def mostly_ascii(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.mostly_ascii(F.col("text")).alias("ascii"))


TERMS = ["data", "register", "transfer", "permit", "sever", "данные", "catatan", "登记", "hồ sơ", "archive", "consent", "safeguards"]
TERMS_SQL = ", ".join(f"'{t}'" for t in TERMS)


@query(f"SELECT doc_id, round(least(1.0, len(list_filter([{TERMS_SQL}], lambda t: contains(b, t))) / greatest(4, {len(TERMS)} * 0.25)), 3) AS relevance FROM (SELECT doc_id, lower(concat_ws(' ', title, substring(text, 1, 4000))) AS b FROM documents)")
def relevance_terms(spark, d):
    """Distinct query terms in title and first 4,000 characters, by a quarter of the terms (at least 4), at most 1."""
    doc = table(spark, d, "documents").select("doc_id", F.lower(F.concat_ws(" ", "title", F.substring("text", 1, 4000))).alias("b"))
    hits = F.size(F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.col("b"), t)))
    return doc.select("doc_id", F.round(F.least(F.lit(1.0), hits / max(4, len(TERMS) * 0.25)), 3).alias("relevance"))


@query(
    rf"""SELECT label_id, CASE WHEN len(v) = 0 THEN 0.0 ELSE round(len(list_filter(v, lambda w: contains(lower(impact), w))) / len(v), 4) END AS relevance
    FROM (SELECT label_id, impact, list_filter(list_distinct(regexp_extract_all(lower(array_to_string(laws, ' ')), '([a-z][a-z-]{{3,}})', 1)), lambda w: w NOT IN ({STOP_SQL})) AS v FROM label_row WHERE laws IS NOT NULL AND impact IS NOT NULL)"""
)
def snippet_relevance(spark, d):
    """Share of a row's distinctive law words that its impact text holds."""
    r = table(spark, d, "label_row").where("laws is not null and impact is not null")
    v = F.array_except(F.regexp_extract_all(F.lower(F.array_join("laws", " ")), F.lit("([a-z][a-z-]{3,})"), 1), F.array(*map(F.lit, STOP)))
    r = r.select("label_id", "impact", v.alias("v"))
    return r.select("label_id", F.when(F.size("v") == 0, 0.0).otherwise(F.round(F.size(F.filter("v", lambda w: F.contains(F.lower("impact"), w))) / F.size("v"), 4)).alias("relevance"))


#: Pages with their text: of html, else of a body that is UTF-8; of other bodies it is null.
PAGES_SQL = "(SELECT fetch_id, coalesce(html, TRY(decode(body))) AS html FROM fetched_page)"


def page_texts(spark, d):
    body = F.col("body").cast("string")
    return table(spark, d, "fetched_page").select("fetch_id", F.coalesce("html", F.when(F.is_valid_utf8(body), body)).alias("html"))


HTML_SQL = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<!--.*?-->|<(?:script|style|head|nav|header|footer|aside|noscript)\b.*?</(?:script|style|head|nav|header|footer|aside|noscript)\s*>', ' ', 'g'),
  '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|ul|ol|table)\s*>', chr(10), 'g'), '<[^<>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))"""


@query(f"SELECT fetch_id, md5({HTML_SQL}) AS text_md5, length({HTML_SQL}) AS chars FROM {PAGES_SQL}")
def html_to_text_regex(spark, d):
    t = T.html_to_text(F.col("html"))
    return page_texts(spark, d).select("fetch_id", F.md5(t).alias("text_md5"), F.length(t).alias("chars"))


@query(
    r"""SELECT fetch_id, (contains(lower(html), 'id="root"') OR contains(lower(html), '<noscript>')) AND NOT regexp_matches(lower(regexp_replace(html, '(?is)<(?:script|noscript)\b.*?</(?:script|noscript)\s*>', '', 'g')), '<(?:h[1-6]|p|li|td)[ >]') AS shell FROM """ + PAGES_SQL
)
def js_shell_filter(spark, d):
    return page_texts(spark, d).select("fetch_id", T.is_script_shell(F.col("html")).alias("shell"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT (regexp_matches(substring(lower(text), 1, 600), '404|not found|access denied|service unavailable|page does not exist') AND length(text) < 4000)")
def error_page_filter(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull() & ~T.is_error_page(F.col("text"))).select("doc_id")


@query(
    r"""SELECT fetch_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?m)^#{1,6}[ \t]+|[ \t]+#+$', '', 'g'), '\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '\*\*|__|`', '', 'g'), '(?m)^[ \t]*[-*+][ \t]+', '', 'g')) AS plain_md5 FROM """ + PAGES_SQL
)
def markdown_to_plain(spark, d):
    return page_texts(spark, d).select("fetch_id", F.md5(T.markdown_to_plain(F.col("html"))).alias("plain_md5"))


@query("SELECT doc_id, economy || substring(sha1(source_url), 1, 10) AS doc_key, substring(sha256(coalesce(text, '')), 1, 20) AS content_key FROM documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.concat("economy", F.substring(F.sha1("source_url"), 1, 10)).alias("doc_key"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 20).alias("content_key")
    )


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


def paired(spark, d):
    """Reference names and target labels of one workbook and indicator, the k-th name by id with the k-th label: one with one, however many there are."""
    from lexloom.operators.retrieval import places

    by = ["workbook_id", "indicator_id"]
    r = places(table(spark, d, "ref_row").where("law_name is not null").select(*by, "ref_id", "law_name"), by, [F.col("ref_id")], "place")
    t = places(table(spark, d, "trace_target").where("law_label is not null").select(*by, "target_id", "law_label"), by, [F.col("target_id")], "place")
    return r.join(t, [*by, "place"]).select("ref_id", "target_id", "law_name", "law_label")


@query()
def cer_levenshtein(spark, d):
    """Character error rate of labels against names (`paired`), by characters of any script; SQL here counts bytes, so a test holds it against brute force."""
    cer = F.levenshtein(F.lower("law_name"), F.lower("law_label")) / F.greatest(F.length("law_name"), F.lit(1))
    return paired(spark, d).select("ref_id", "target_id", F.round(cer, 4).alias("cer"))


@query("SELECT ref_id, CASE WHEN raw_score IS NULL THEN '' ELSE printf('%.2f', raw_score) END AS shown FROM ref_row")
def score_format(spark, d):
    return table(spark, d, "ref_row").select("ref_id", F.when(F.col("raw_score").isNull(), "").otherwise(F.format_string("%.2f", "raw_score")).alias("shown"))


@query("SELECT law_id FROM corpus_law WHERE len(list_filter(string_split('service act', ' '), lambda w: NOT contains(lower(title), w))) = 0")
def all_words_match(spark, d):
    """Titles that hold every word of a query, anywhere."""
    return table(spark, d, "corpus_law").where(F.forall(F.split(F.lit("service act"), " "), lambda w: F.contains(F.lower("title"), w))).select("law_id")


@query("SELECT law_id FROM corpus_law WHERE contains(lower(title), 'audit oversight act') OR contains(regexp_replace(lower(title), ' \\(amendment\\)', ''), 'audit oversight act')")
def catalogue_match(spark, d):
    t = F.lower("title")
    return table(spark, d, "corpus_law").where(t.contains("audit oversight act") | F.regexp_replace(t, r" \(amendment\)", "").contains("audit oversight act")).select("law_id")


TYPES = [("amendment", "amendment|perubahan|修正案|изменени"), ("rules", "rules|regulations|peraturan|办法|положение"), ("code", "code|条例"), ("ordinance", "ordinance|nghị định"), ("act", "act|law|luật|undang|закон|法")]


@query("SELECT law_id, CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{k}'" for k, p in TYPES) + " ELSE 'guidance' END AS type FROM corpus_law")
def instrument_type(spark, d):
    c = None
    for k, p in TYPES:
        hit = F.lower("title").rlike(p)
        c = F.when(hit, k) if c is None else c.when(hit, k)
    return table(spark, d, "corpus_law").select("law_id", c.otherwise("guidance").alias("type"))


@query(r"SELECT DISTINCT url FROM fetched_page WHERE regexp_extract(url, '^https?://([^/]+)', 1) LIKE 'lex.%' AND NOT regexp_matches(url, '/(?:search|login|about|contact|help)(?:[/?]|$)')")
def url_law_filter(spark, d):
    """Addresses on the law portals that are not navigation."""
    u = F.col("url")
    return table(spark, d, "fetched_page").where(F.parse_url(u, F.lit("HOST")).startswith("lex.") & ~u.rlike(r"/(?:search|login|about|contact|help)(?:[/?]|$)")).select("url").distinct()


@query(
    rf"""SELECT k AS kind, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'pdf') THEN 'pdf' WHEN contains(t, 'word') THEN 'docx' WHEN contains(t, 'html') THEN 'html' WHEN starts_with(t, 'text/') THEN 'text'
    WHEN regexp_matches(p, '\.pdf$') THEN 'pdf' WHEN regexp_matches(p, '\.docx?$') THEN 'docx' WHEN regexp_matches(p, '\.txt$') THEN 'text' ELSE 'html' END AS k FROM (SELECT lower(coalesce(content_type, '')) AS t, {HOST_PATH_SQL.format(c='url')} AS p FROM fetched_page)) GROUP BY 1"""
)
def content_type_format(spark, d):
    return table(spark, d, "fetched_page").groupBy(T.content_kind(F.col("content_type"), F.col("url")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT law_id, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(title, '[^\p{L}\s]', ' ', 'g'), '\s+'), lambda w: regexp_matches(w, '^\p{Lu}') AND lower(w) NOT IN ('of', 'the', 'and', 'on')), lambda w: upper(substring(w, 1, 1))), '') AS acronym FROM corpus_law"""
)
def acronym_title(spark, d):
    return table(spark, d, "corpus_law").select("law_id", T.acronym(F.col("title")).alias("acronym"))


@query(
    r"""SELECT doc_id, i AS line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
    WHERE trim(line) <> '' AND NOT regexp_matches(line, '[:;]') AND len(list_filter(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> ''), lambda w: regexp_matches(w, '^[\p{Lu}0-9(«“]') OR lower(w) IN ('of', 'the', 'and', 'on', 'in', 'for', 'to'))) >= 0.8 * len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda w: w <> ''))"""
)
def title_lines(spark, d):
    """Lines of documents that look like titles."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where((F.trim("line") != "") & T.title_like(F.col("line"))).select("doc_id", (F.col("i") + 1).alias("line_no"))


@query(r"SELECT doc_id, CASE WHEN coalesce((length(text) - length(regexp_replace(text, '\p{Han}', '', 'g'))) / nullif(length(text), 0), 0) >= 0.3 THEN 8 ELSE 20 END AS least_chars FROM documents WHERE text IS NOT NULL")
def min_provision_chars(spark, d):
    """The least length of a provision by the density of its script."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.when(T.share_of(F.col("text"), r"\p{IsHan}") >= 0.3, 8).otherwise(20).alias("least_chars"))


@query(
    r"""SELECT doc_id, i + 1 AS page, length(t) AS chars, round(0.55 + 0.4 * coalesce(length(regexp_replace(t, '\P{L}', '', 'g')) / nullif(length(t), 0), 0), 4) AS confidence
    FROM (SELECT doc_id, i, substring(text, i * 1800 + 1, 1800) AS t FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(1, ceil(length(text) / 1800)) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL))"""
)
def mock_ocr_pages(spark, d):
    """Texts in pages of 1,800 characters with a confidence from their share of letters."""
    doc = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 1800)).cast("int") - 1)).alias("i"))
    t = doc.select("doc_id", (F.col("i") + 1).alias("page"), F.substring(F.col("text"), F.col("i") * 1800 + 1, F.lit(1800)).alias("t"))
    letters = F.coalesce(F.length(F.regexp_replace("t", r"\P{L}", "")) / F.nullif(F.length("t"), F.lit(0)), F.lit(0.0))
    return t.select("doc_id", "page", F.length("t").alias("chars"), F.round(0.55 + 0.4 * letters, 4).alias("confidence"))
