"""Queries on evidence: grounding, attribution, votes, sweeps, discovery and cache keys."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.operators import retrieval as R
from lexloom.plans.retrieval_plans import BY, DR, _dedup_ranks
from lexloom.plans.text_plans import HOST_PATH_SQL, NAME_TOKENS_SQL, PAGES_SQL, STOP, page_texts
from lexloom.operators.retrieval import places
from lexloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


WORDS = "list_distinct(regexp_extract_all(lower({c}), '([a-z]{{3,}})', 1))"


def words(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), 1))


GROUND = f"""SELECT l.label_id, r.ref_id, CASE WHEN contains(l.impact, substring(trim(r.rationale), 1, 200)) THEN 1.0 ELSE round(len(list_intersect({WORDS.format(c="l.impact")}, {WORDS.format(c="r.rationale")})) / nullif(len({WORDS.format(c="r.rationale")}), 0), 3) END AS grounding
FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, indicator_id ORDER BY label_id) AS place FROM (SELECT DISTINCT workbook_id, indicator_id, label_id, impact FROM label_row WHERE impact IS NOT NULL) x) l
JOIN (SELECT *, row_number() OVER (PARTITION BY workbook_id, indicator_id ORDER BY ref_id) AS place FROM ref_row WHERE rationale IS NOT NULL) r ON l.workbook_id = r.workbook_id AND l.indicator_id = r.indicator_id AND l.place = r.place"""


def _label_ref(spark, d):
    """Labels and reference rows of one workbook and indicator, the k-th with the k-th by id."""
    by = ["workbook_id", "indicator_id"]
    left = places(table(spark, d, "label_row").where("impact is not null").select(*by, "label_id", "impact").distinct(), by, [F.col("label_id")], "place")
    right = places(table(spark, d, "ref_row").where("rationale is not null").select(*by, "ref_id", "rationale"), by, [F.col("ref_id")], "place")
    return left.join(right, [*by, "place"])


@query(GROUND)
def snippet_grounding(spark, d):
    """1 where a text holds the first 200 characters of another, else the share of its words."""
    share = F.round(F.size(F.array_intersect(words("impact"), words("rationale"))) / F.nullif(F.size(words("rationale")), F.lit(0)), 3)
    hit = F.contains("impact", F.substring(F.trim("rationale"), 1, 200))
    return _label_ref(spark, d).select("label_id", "ref_id", F.when(hit, 1.0).otherwise(share).alias("grounding"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '((?:sub-section|paragraph|clause) (?:[0-9]+)?\([0-9a-z]+\))', 1)) AS citations, regexp_matches(text, '\([0-9a-z]{1,4}\)') AS has_sub FROM documents WHERE text IS NOT NULL")
def subsection_citation(spark, d):
    n = F.size(F.regexp_extract_all("text", F.lit(r"((?:sub-section|paragraph|clause) (?:[0-9]+)?\([0-9a-z]+\))"), 1))
    return table(spark, d, "documents").where("text is not null").select("doc_id", n.alias("citations"), F.col("text").rlike(r"\([0-9a-z]{1,4}\)").alias("has_sub"))


TOPICS = ["data", "record", "register", "данн", "реестр", "catatan", "登记", "数据", "dữ liệu"]


@query("SELECT doc_id, len(list_filter([" + ", ".join(f"'{t}'" for t in TOPICS) + "], lambda t: contains(lower(text), t))) > 0 OR coalesce(length(regexp_replace(substring(text, 1, 1000), '[^\\x00-\\x7F]', '', 'g')) / nullif(length(substring(text, 1, 1000)), 0), 1) < 0.85 AS topical FROM documents WHERE text IS NOT NULL")
def topical_guard(spark, d):
    """Texts with a term of the topic; texts that are mostly not ASCII are exempt."""
    s = F.substring("text", 1, 1000)
    exempt = F.coalesce(F.length(F.regexp_replace(s, r"[^\x00-\x7F]", "")) / F.nullif(F.length(s), F.lit(0)), F.lit(1.0)) < 0.85
    return table(spark, d, "documents").where("text is not null").select("doc_id", (F.exists(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(F.lower("text"), t)) | exempt).alias("topical"))


SECTORS = ["pension", "health", "maritime", "postal", "aviation", "медицин", "kesehatan", "健康", "y tế"]


@query("SELECT law_id, len(list_filter([" + ", ".join(f"'{t}'" for t in SECTORS) + "], lambda t: contains(lower(title), t))) > 0 AS sectoral FROM corpus_law")
def sectoral_marker(spark, d):
    return table(spark, d, "corpus_law").select("law_id", F.exists(F.array(*map(F.lit, SECTORS)), lambda t: F.contains(F.lower("title"), t)).alias("sectoral"))


@query(f"WITH {DR}, g AS (SELECT *, keyword IS NULL OR keyword = 0 AS gated FROM dr) SELECT run_id, indicator_id, count(*) FILTER (WHERE gated) AS skipped, round(avg(CASE WHEN gated THEN 0.5 ELSE coalesce(semantic, 0.5) END), 3) AS mean_dense FROM g GROUP BY 1, 2")
def concept_gate(spark, d):
    """Documents without any keyword signal skip the costly score and take its middle."""
    g = _dedup_ranks(spark, d).withColumn("gated", F.col("keyword").isNull() | (F.col("keyword") == 0))
    return g.groupBy(*BY).agg(F.count_if("gated").alias("skipped"), F.round(F.avg(F.when(F.col("gated"), 0.5).otherwise(F.coalesce("semantic", F.lit(0.5)))), 3).alias("mean_dense"))


@query(f"WITH {DR}, v AS (SELECT run_id, indicator_id, doc_id, keyword >= median(keyword) OVER w AS a, semantic >= median(semantic) OVER w AS b, cross_ >= median(cross_) OVER w AS c FROM dr WINDOW w AS (PARTITION BY run_id, indicator_id)) SELECT run_id, indicator_id, count(*) AS n, count(*) FILTER (WHERE CAST(coalesce(a, false) AS INT) + CAST(coalesce(b, false) AS INT) + CAST(coalesce(c, false) AS INT) >= 2) AS accepted FROM v GROUP BY 1, 2")
def crosscheck_majority(spark, d):
    """Votes of three judges, each for the upper half by its score; two of three decide, a judge without a score does not vote."""
    r = _dedup_ranks(spark, d)
    med = r.groupBy(*BY).agg(*(F.median(s).alias(f"m_{s}") for s in ("keyword", "semantic", "cross")))
    votes = sum((F.coalesce((F.col(s) >= F.col(f"m_{s}")).cast("int"), F.lit(0)) for s in ("keyword", "semantic", "cross")), F.lit(0))
    return r.join(med, BY).groupBy(*BY).agg(F.count("*").alias("n"), F.count_if(votes >= 2).alias("accepted"))


@query(
    f"""WITH {DR}, g AS (SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS w), x AS (SELECT g.w, round(g.w * semantic / m + (1 - g.w) * coalesce(keyword / nullif(k, 0), 0), 9) AS s, CASE WHEN scope >= 1 AND scope <> 60 THEN 1 ELSE 0 END AS pos FROM (SELECT *, max(semantic) OVER (PARTITION BY run_id, indicator_id) AS m, max(keyword) OVER (PARTITION BY run_id, indicator_id) AS k FROM dr WHERE semantic IS NOT NULL AND scope IS NOT NULL) q, g),
    r AS (SELECT w, pos, rank() OVER (PARTITION BY w ORDER BY s) + (count(*) OVER (PARTITION BY w, s) - 1) / 2.0 AS r FROM x) SELECT w, round((sum(CASE WHEN pos = 1 THEN r ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (count(*) - sum(pos))), 6) AS auc FROM r GROUP BY 1"""
)
def weight_grid(spark, d):
    """Area under the curve for each weight of a blend, over all rankings at once. Ranks come from running totals over ranges."""
    from lexloom.operators.ranking import running_total

    p = Window.partitionBy(*BY)
    q = _dedup_ranks(spark, d).where("semantic is not null and scope is not null").withColumn("m", F.max("semantic").over(p)).withColumn("k", F.max("keyword").over(p))
    x = q.select(F.explode(F.array(*map(F.lit, (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))).alias("w"), "semantic", "keyword", "m", "k", ((F.col("scope") >= 1) & (F.col("scope") != 60)).cast("int").alias("pos"))
    s = F.round(F.col("w") * F.col("semantic") / F.col("m") + (1 - F.col("w")) * F.coalesce(F.col("keyword") / F.nullif(F.col("k"), F.lit(0.0)), F.lit(0.0)), 9)
    v = x.select("w", s.alias("s"), "pos").groupBy("w", "s").agg(F.count("*").alias("n"), F.sum("pos").alias("p"))
    r = running_total(v, ["w"], [F.col("s")], "n", "below").withColumn("sum_r", F.col("p") * (F.col("below") + (F.col("n") + 1) / 2.0))
    P, N = F.sum("p"), F.sum("n")
    return r.groupBy("w").agg(F.round((F.sum("sum_r") - P * (P + 1) / 2.0) / (P * (N - P)), 6).alias("auc"))


@query(
    f"""WITH {DR}, n AS (SELECT indicator_id, law_name, count(*) AS n FROM dr WHERE law_name IS NOT NULL GROUP BY 1, 2) SELECT indicator_id, law_name, n, CAST(least(40, greatest(3, round(8 * log2(n) / 6))) AS INT) AS depth FROM n"""
)
def adaptive_depth(spark, d):
    """How many provisions of a law to look at, by the logarithm of how many it has."""
    n = _dedup_ranks(spark, d).where("law_name is not null").groupBy("indicator_id", "law_name").agg(F.count("*").alias("n"))
    return n.withColumn("depth", F.least(F.lit(40.0), F.greatest(F.lit(3.0), F.round(8 * F.log2("n") / 6))).cast("int"))


LAW = r"((?:[A-Z][a-z]+ )+(?:\(Amendment\) )?(?:Act|Code|Rules|Regulations|Ordinance) (?:19|20)[0-9]{2})"
CITE = r"((?:section|regulation|rule|clause) [0-9]+)"


@query(
    rf"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, i, nullif(regexp_extract(line, '{LAW}', 1), '') AS law, nullif(regexp_extract(line, '{CITE}', 1), '') AS cite FROM t),
    a AS (SELECT *, last_value(law IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS before, first_value(law IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM m)
    SELECT doc_id, i AS line_no, cite, coalesce(before, after) AS law FROM a WHERE cite IS NOT NULL"""
)
def citation_attribution(spark, d):
    """The law that a citation means: the nearest named at or before its line, else the nearest after."""
    ln = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    m = ln.select("doc_id", (F.col("i") + 1).alias("line_no"), F.nullif(F.regexp_extract("line", LAW, 1), F.lit("")).alias("law_"), F.nullif(F.regexp_extract("line", CITE, 1), F.lit("")).alias("cite"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before, after = F.last("law_", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("law_", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return m.withColumn("law", F.coalesce(before, after)).where("cite is not null").select("doc_id", "line_no", "cite", "law")


@query(
    r"""WITH pg AS (SELECT ocr_id, p.page AS page, regexp_replace(p.text, '\s+', ' ', 'g') AS t FROM (SELECT ocr_id, unnest(pages) AS p FROM ocr_result) WHERE p.text IS NOT NULL), a AS (SELECT ocr_id, page, t, substring(t, 101, 60) AS probe FROM pg WHERE length(t) >= 160), n AS (SELECT a.ocr_id, a.page, bool_or(contains(b.t, a.probe)) AS found FROM a JOIN pg b ON a.ocr_id = b.ocr_id AND b.page BETWEEN a.page - 1 AND a.page + 1 GROUP BY 1, 2)
    SELECT ocr_id, count(*) AS pages, count(*) FILTER (WHERE found) AS found FROM n GROUP BY 1"""
)
def verbatim_roundtrip(spark, d):
    """Probes of 60 characters sought on the cited page and those beside it, by an equi-join on exploded page numbers."""
    o = table(spark, d, "ocr_result").select("ocr_id", F.explode("pages").alias("p")).where("p.text is not null").select("ocr_id", "p.page", F.regexp_replace("p.text", r"\s+", " ").alias("t"))
    a = o.where(F.length("t") >= 160).select("ocr_id", "page", F.substring("t", 101, 60).alias("probe"), F.explode(F.array(F.col("page") - 1, "page", F.col("page") + 1)).alias("at"))
    j = a.join(o.select("ocr_id", F.col("page").alias("at"), "t"), ["ocr_id", "at"]).groupBy("ocr_id", "page").agg(F.bool_or(F.contains("t", "probe")).alias("found"))
    return j.groupBy("ocr_id").agg(F.count("*").alias("pages"), F.count_if("found").alias("found"))


@query(
    r"""SELECT fetch_id, count(*) AS links, count(DISTINCT h) AS targets, count(*) FILTER (WHERE h LIKE '/%') AS local FROM (SELECT fetch_id, unnest(regexp_extract_all(html, '(?i)<a[^<>]*href="([^"]*)"', 1)) AS h FROM """ + PAGES_SQL + """) GROUP BY 1"""
)
def link_scrape(spark, d):
    """Links of pages by pattern."""
    h = page_texts(spark, d).select("fetch_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a[^<>]*href="([^"]*)"'), 1)).alias("h"))
    return h.groupBy("fetch_id").agg(F.count("*").alias("links"), F.countDistinct("h").alias("targets"), F.count_if(F.startswith("h", F.lit("/"))).alias("local"))


@query(f"SELECT page, arg_max(title, struct_pack(n := length(title), t := title)) AS title FROM (SELECT {HOST_PATH_SQL.format(c='source_url')} AS page, title FROM documents WHERE title IS NOT NULL UNION ALL SELECT {HOST_PATH_SQL.format(c='source_url')}, title FROM corpus_law) GROUP BY 1")
def longest_title_wins(spark, d):
    """Addresses from two enumerations, each with its longest title."""
    one = lambda t: table(spark, d, t).where("title is not null").select(T.url_host_path(F.col("source_url")).alias("page"), "title")
    return one("documents").unionByName(one("corpus_law")).groupBy("page").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("title"))


@query("SELECT fetch_id, url, fetched_at FROM fetched_page QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) = 1")
def latest_fetch(spark, d):
    """The last fetch of each address."""
    w = Window.partitionBy("url").orderBy(F.desc("fetched_at"), F.desc("fetch_id"))
    return table(spark, d, "fetched_page").select("fetch_id", "url", "fetched_at", F.row_number().over(w).alias("k")).where("k = 1").select("fetch_id", "url", "fetched_at")


@query(
    "WITH k AS (SELECT coalesce(sha256(html), sha256(body)) AS k, fetched_at FROM fetched_page WHERE html IS NOT NULL OR body IS NOT NULL), m AS (SELECT max(CAST(fetched_at AS DATE)) AS last_ FROM k), c AS (SELECT DISTINCT k FROM k, m WHERE CAST(fetched_at AS DATE) < last_) SELECT count(*) AS todo FROM k WHERE k NOT IN (SELECT k FROM c)"
)
def extraction_cache(spark, d):
    """Pages that a cache filled before the newest day does not hold, by the hash of their content."""
    k = F.coalesce(F.sha2(F.col("html").cast("binary"), 256), F.sha2("body", 256))
    p = table(spark, d, "fetched_page").where("html is not null or body is not null").select(k.alias("k"), F.to_date("fetched_at").alias("day"))
    cached = p.where(F.col("day") < p.agg(F.max("day").alias("m")).select("m").scalar()).select("k").distinct()
    return p.join(cached, "k", "left_anti").agg(F.count("*").alias("todo"))


@query("SELECT run_id, indicator_id, sha1(concat_ws('|', run_id, indicator_id, CAST(count(DISTINCT doc_id) AS VARCHAR))) AS cache_key FROM doc_rank GROUP BY 1, 2")
def result_cache_key(spark, d):
    g = table(spark, d, "doc_rank").groupBy(*BY).agg(F.countDistinct("doc_id").alias("n"))
    return g.select(*BY, F.sha1(F.concat_ws("|", *BY, F.col("n").cast("string"))).alias("cache_key"))


@query("SELECT law_id, title AS back FROM corpus_law")
def encrypted_catalogue(spark, d):
    """Titles sealed and opened again with AES in GCM mode, in the engine."""
    key = F.lit("0123456789abcdef")
    sealed = table(spark, d, "corpus_law").select("law_id", F.aes_encrypt(F.col("title"), key, F.lit("GCM")).alias("x"))
    return sealed.select("law_id", F.aes_decrypt("x", key, F.lit("GCM")).cast("string").alias("back"))


@query("WITH p AS (SELECT * FROM (VALUES ('CN', 'zh', 'Han'), ('RU', 'ru', 'Cyrillic'), ('KZ', 'ru', 'Cyrillic'), ('VN', 'vi', 'Latin'), ('ID', 'id', 'Latin')) t(economy, language, script)) SELECT l.economy, coalesce(p.language, 'en') AS language, coalesce(p.script, 'Latin') AS script, count(*) AS laws FROM corpus_law l LEFT JOIN p USING (economy) GROUP BY 1, 2, 3")
def language_profile(spark, d):
    """A lookup with a default."""
    p = spark.createDataFrame([("CN", "zh", "Han"), ("RU", "ru", "Cyrillic"), ("KZ", "ru", "Cyrillic"), ("VN", "vi", "Latin"), ("ID", "id", "Latin")], "economy string, language string, script string")
    j = table(spark, d, "corpus_law").select("economy").join(p, "economy", "left")
    return j.groupBy("economy", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("script", F.lit("Latin")).alias("script")).agg(F.count("*").alias("laws"))


@query("WITH n AS (SELECT * FROM (VALUES ('RU', 'данные'), ('RU', 'реестр'), ('CN', '数据'), ('ID', 'catatan')) t(economy, term)) SELECT e.economy, coalesce(list_sort(list(n.term) FILTER (WHERE n.term IS NOT NULL)), []) AS terms FROM (SELECT DISTINCT economy FROM corpus_law) e LEFT JOIN n USING (economy) GROUP BY 1")
def native_terms(spark, d):
    """Query terms in an economy's own language; economies without any have an empty list."""
    n = spark.createDataFrame([("RU", "данные"), ("RU", "реестр"), ("CN", "数据"), ("ID", "catatan")], "economy string, term string")
    return table(spark, d, "corpus_law").select("economy").distinct().join(n, "economy", "left").groupBy("economy").agg(F.sort_array(F.collect_list("term")).alias("terms"))


@query(
    """WITH p AS (SELECT DISTINCT economy, indicator_id, law_name FROM ref_row WHERE law_name IS NOT NULL), i AS (SELECT DISTINCT economy, indicator_id FROM p)
    SELECT p.economy, i.indicator_id, p.law_name, 'sibling' AS kind FROM p JOIN i ON p.economy = i.economy AND split_part(p.indicator_id, '-', 1) = split_part(i.indicator_id, '-', 1) AND p.indicator_id <> i.indicator_id WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.economy = p.economy AND q.indicator_id = i.indicator_id AND q.law_name = p.law_name) UNION SELECT economy, indicator_id, law_name, 'positive' FROM p"""
)
def pair_builder(spark, d):
    """Positive pairs, and negatives from sibling indicators that do not cite the law too."""
    p = table(spark, d, "ref_row").where("law_name is not null").select("economy", "indicator_id", "law_name").distinct()
    s = p.withColumn("p", F.substring_index("indicator_id", "-", 1))
    i = s.select("economy", "p", F.col("indicator_id").alias("other")).distinct()
    neg = s.join(i, ["economy", "p"]).where("other <> indicator_id").select("economy", F.col("other").alias("indicator_id"), "law_name").distinct().join(p, ["economy", "indicator_id", "law_name"], "left_anti")
    return neg.withColumn("kind", F.lit("sibling")).unionByName(p.withColumn("kind", F.lit("positive")))


@query(
    """WITH r AS (SELECT workbook_id, indicator_id, raw_score FROM ref_row WHERE raw_score IS NOT NULL), l AS (SELECT workbook_id, indicator_id, raw_score FROM label_row WHERE raw_score IS NOT NULL), m AS (SELECT r.workbook_id, r.indicator_id, avg(CASE WHEN abs(r.raw_score - l.raw_score) < 1e-9 THEN 1.0 ELSE 0.0 END) AS hit FROM r JOIN l ON r.workbook_id = l.workbook_id AND r.indicator_id = l.indicator_id GROUP BY 1, 2)
    SELECT indicator_id, count(*) AS panels, round(avg(hit), 6) AS agreement, round(max(hit) / nullif(avg(hit), 0), 6) AS contrast FROM m GROUP BY 1"""
)
def panel_agreement(spark, d):
    """How often two answer keys give one score, and the best panel against the mean. Scores are counted before the join, so no pairs of rows arise."""
    c = lambda t, n: table(spark, d, t).where("raw_score is not null").groupBy("workbook_id", "indicator_id", "raw_score").agg(F.count("*").alias(n))
    a, b = c("ref_row", "a"), c("label_row", "b")
    same = a.join(b, ["workbook_id", "indicator_id", "raw_score"]).groupBy("workbook_id", "indicator_id").agg(F.sum(F.col("a") * F.col("b")).alias("same"))
    tot = a.groupBy("workbook_id", "indicator_id").agg(F.sum("a").alias("a")).join(b.groupBy("workbook_id", "indicator_id").agg(F.sum("b").alias("b")), ["workbook_id", "indicator_id"])
    m = tot.join(same, ["workbook_id", "indicator_id"], "left").select("indicator_id", (F.coalesce("same", F.lit(0)) / (F.col("a") * F.col("b"))).alias("hit"))
    return m.groupBy("indicator_id").agg(F.count("*").alias("panels"), F.round(F.avg("hit"), 6).alias("agreement"), F.round(F.max("hit") / F.nullif(F.avg("hit"), F.lit(0.0)), 6).alias("contrast"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1] AS p90, round(quantile_cont(value, 0.5), 6) AS median_ FROM events GROUP BY 1")
def percentiles(spark, d):
    """The element at nine tenths by count, without gathering a group: values are counted and accumulated over ranges; and the median."""
    from lexloom.operators.ranking import running_total

    e = table(spark, d, "events").select("event_type", "value")
    v = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    size = v.groupBy("event_type").agg(F.sum("n").alias("all"))
    at = running_total(v, ["event_type"], [F.col("value")], "n", "below").join(size, "event_type")
    k = F.floor(F.col("all") * 0.9)
    p = at.where((F.col("below") <= k) & (k < F.col("below") + F.col("n"))).select("event_type", F.col("value").alias("p90"))
    return p.join(e.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median_")), "event_type")


@query("SELECT version_id, pages, greatest(1, chars // 1800) AS expected, abs(pages - greatest(1, chars // 1800)) <= greatest(2, 0.02 * pages) AS agrees FROM (SELECT version_id, max(pages) AS pages, max(chars) AS chars FROM corpus_version WHERE pages IS NOT NULL AND chars IS NOT NULL GROUP BY 1)")
def page_reconciliation(spark, d):
    """Page counts against what the text's length lets expect, with a tolerance."""
    v = table(spark, d, "corpus_version").where("pages is not null and chars is not null").groupBy("version_id").agg(F.max("pages").alias("pages"), F.max("chars").alias("chars"))
    want = F.greatest(F.lit(1), F.floor(F.col("chars") / 1800)).cast("int")
    return v.select("version_id", "pages", want.alias("expected"), (F.abs(F.col("pages") - want) <= F.greatest(F.lit(2.0), F.col("pages") * 0.02)).alias("agrees"))


@query(
    "WITH a AS (SELECT user_id, ts, event_id, sum(value) OVER w AS x, sum(value * (event_id % 3 - 1)) OVER w AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, lead(x) OVER v AS x2, lead(y) OVER v AS y2 FROM a WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(abs(sum(x * y2 - x2 * y)) / 2, 0) AS area FROM b GROUP BY 1"
)
def outline_area(spark, d):
    """Steps decoded to a line by running sums, and its area by the shoelace formula."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = table(spark, d, "events").withColumn("x", F.sum("value").over(w)).withColumn("y", F.sum(F.col("value") * (F.col("event_id") % 3 - 1)).over(w))
    b = a.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
    return b.groupBy("user_id").agg(F.round(F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2, 0).alias("area"))


@query("SELECT law_id, version_id FROM (SELECT law_id, version_id, amendment_date, max(TRY_CAST(amendment_date AS INT)) OVER (PARTITION BY law_id) AS newest FROM (SELECT DISTINCT law_id, version_id, amendment_date FROM corpus_version WHERE amendment_date IS NOT NULL)) WHERE TRY_CAST(amendment_date AS INT) = newest OR newest IS NULL")
def latest_compilation(spark, d):
    """The parts of each law's latest compilation; a law without a year keeps all."""
    v = table(spark, d, "corpus_version").where("amendment_date is not null").select("law_id", "version_id", "amendment_date").distinct().withColumn("y", F.col("amendment_date").try_cast("int"))
    new = F.max("y").over(Window.partitionBy("law_id"))
    return v.withColumn("newest", new).where((F.col("y") == F.col("newest")) | F.col("newest").isNull()).select("law_id", "version_id")


@query("SELECT law_id, sha256(string_agg(content_sha256, '|' ORDER BY content_sha256)) AS law_sha, count(*) AS parts FROM (SELECT DISTINCT law_id, content_sha256 FROM corpus_version WHERE content_sha256 IS NOT NULL) GROUP BY 1")
def multipart_hash(spark, d):
    """One hash of a law's parts."""
    p = table(spark, d, "corpus_version").where("content_sha256 is not null").select("law_id", "content_sha256").distinct()
    return p.groupBy("law_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("content_sha256")), "|"), 256).alias("law_sha"), F.count("*").alias("parts"))


@query(
    f"""WITH q AS (SELECT indicator_id, unnest({NAME_TOKENS_SQL.format(c='law_name')}) AS w FROM ref_row WHERE law_name IS NOT NULL), s AS (SELECT indicator_id, list_sort(list(DISTINCT w)) AS ws FROM q GROUP BY 1) SELECT indicator_id, len(ws) AS words_, array_to_string(ws[1:4], ', ') AS first_words FROM s"""
)
def prompt_terms(spark, d):
    """The first four terms of every indicator, as a prompt shows them."""
    w = table(spark, d, "ref_row").where("law_name is not null").select("indicator_id", F.explode(T.name_tokens(F.col("law_name"), STOP)).alias("w"))
    g = w.groupBy("indicator_id").agg(F.sort_array(F.collect_set("w")).alias("ws"))
    return g.select("indicator_id", F.size("ws").alias("words_"), F.array_join(F.slice("ws", 1, 4), ", ").alias("first_words"))


@query("SELECT ref_id, CASE WHEN raw_score IS NULL THEN 'failed' WHEN raw_score >= 0.5 THEN 'hit' ELSE 'miss' END AS outcome, concat_ws(' ', CASE WHEN coverage = '' THEN NULL ELSE coverage END, law_number, CASE WHEN len(sections) > 0 THEN 's. ' || sections[1] END) AS note FROM ref_row")
def notes_and_outcome(spark, d):
    """Notes put together from what is there; a missing score is a failure, not a miss."""
    s = F.col("raw_score")
    note = F.concat_ws(" ", F.nullif("coverage", F.lit("")), "law_number", F.when(F.size("sections") > 0, F.concat(F.lit("s. "), F.get("sections", F.lit(0)))))
    return table(spark, d, "ref_row").select("ref_id", F.when(s.isNull(), "failed").when(s >= 0.5, "hit").otherwise("miss").alias("outcome"), note.alias("note"))
