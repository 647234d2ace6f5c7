"""Queries on joins, sets, aggregates, windows and kept tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.operators import linkage as L
from lexloom.operators import merge as M
from lexloom.plans.text_plans import CLEAN_SQL, HOST_PATH_SQL, LATEST_SQL, LAW_KEY_SQL, NAME_TOKENS_SQL, SPINE_SQL, STOP
from lexloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def names(c):
    return T.name_tokens(F.col(c), STOP)


def names_sql(c):
    return NAME_TOKENS_SQL.format(c=c)


# ---- joins --------------------------------------------------------------------------------------------------------


@query("SELECT l.economy, v.state, count(*) AS writes, CAST(sum(v.bytes) AS BIGINT) AS bytes FROM corpus_version v JOIN corpus_law l USING (law_id) GROUP BY 1, 2")
def law_version_join(spark, d):
    v = table(spark, d, "corpus_version").select("law_id", "state", "bytes")
    return v.join(table(spark, d, "corpus_law").select("law_id", "economy"), "law_id").groupBy("economy", "state").agg(F.count("*").alias("writes"), F.sum("bytes").alias("bytes"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def three_way_join(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT economy, count(*) AS laws FROM corpus_law WHERE law_id IN (SELECT law_id FROM corpus_version WHERE state = 'split') GROUP BY 1")
def semi_join_current(spark, d):
    done = table(spark, d, "corpus_version").where("state = 'split'").select("law_id")
    return table(spark, d, "corpus_law").join(done, "law_id", "left_semi").groupBy("economy").agg(F.count("*").alias("laws"))


@query("SELECT law_id, title FROM corpus_law WHERE law_id NOT IN (SELECT law_id FROM corpus_version WHERE state = 'split' AND law_id IS NOT NULL)")
def todo_antijoin(spark, d):
    """Laws that have no split version yet."""
    done = table(spark, d, "corpus_version").where("state = 'split'").select("law_id")
    return table(spark, d, "corpus_law").join(done, "law_id", "left_anti").select("law_id", "title")


@query(
    """WITH i AS (SELECT DISTINCT economy, indicator_id FROM doc_rank), have AS (SELECT DISTINCT economy, indicator_id FROM ref_row)
    SELECT economy, indicator_id, 'No provision found' AS law_name FROM i WHERE NOT EXISTS (SELECT 1 FROM have WHERE have.economy = i.economy AND have.indicator_id = i.indicator_id) UNION ALL SELECT economy, indicator_id, law_name FROM ref_row WHERE law_name IS NOT NULL"""
)
def placeholder_antijoin(spark, d):
    """Reference rows, and a placeholder for every ranked indicator of an economy that has none."""
    ref = table(spark, d, "ref_row").select("economy", "indicator_id", "law_name")
    i = table(spark, d, "doc_rank").select("economy", "indicator_id").distinct()
    return i.join(ref, ["economy", "indicator_id"], "left_anti").withColumn("law_name", F.lit("No provision found")).unionByName(ref.where("law_name is not null"))


@query("SELECT t.target_id, coalesce(r.n, 0) AS refs FROM trace_target t LEFT JOIN (SELECT workbook_id, indicator_id, count(*) AS n FROM ref_row GROUP BY 1, 2) r ON t.workbook_id = r.workbook_id AND t.indicator_id = r.indicator_id")
def left_default(spark, d):
    r = table(spark, d, "ref_row").groupBy("workbook_id", "indicator_id").agg(F.count("*").alias("n"))
    return table(spark, d, "trace_target").join(r, ["workbook_id", "indicator_id"], "left").select("target_id", F.coalesce("n", F.lit(0)).alias("refs"))


@query("SELECT a.indicator_id, b.indicator_id AS sibling FROM (SELECT DISTINCT indicator_id FROM doc_rank) a JOIN (SELECT DISTINCT indicator_id FROM doc_rank) b ON split_part(a.indicator_id, '-', 1) = split_part(b.indicator_id, '-', 1) AND a.indicator_id <> b.indicator_id")
def siblings(spark, d):
    i = table(spark, d, "doc_rank").select("indicator_id").distinct().withColumn("p", F.substring_index("indicator_id", "-", 1))
    return i.join(i.select(F.col("indicator_id").alias("sibling"), "p"), "p").where("indicator_id <> sibling").select("indicator_id", "sibling")


@query("SELECT 'only_ref' AS side, economy, indicator_id FROM (SELECT DISTINCT economy, indicator_id FROM ref_row EXCEPT SELECT DISTINCT economy, indicator_id FROM label_row) UNION ALL SELECT 'only_label', economy, indicator_id FROM (SELECT DISTINCT economy, indicator_id FROM label_row EXCEPT SELECT DISTINCT economy, indicator_id FROM ref_row)")
def engine_diff(spark, d):
    """Keys that only one of two result sets has."""
    a = table(spark, d, "ref_row").select("economy", "indicator_id").distinct()
    b = table(spark, d, "label_row").select("economy", "indicator_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("only_ref")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_label"))).select("side", "economy", "indicator_id")


REF_LAW = f"""r AS (SELECT ref_id, economy, law_name, {names_sql('law_name')} AS w FROM ref_row WHERE law_name IS NOT NULL), l AS (SELECT law_id, economy, title, {names_sql('title')} AS w FROM corpus_law),
pr AS (SELECT r.economy, ref_id, law_id, len(list_intersect(r.w, l.w)) AS shared, len(r.w) AS na, len(l.w) AS nb FROM r JOIN l ON r.economy = l.economy WHERE len(list_intersect(r.w, l.w)) > 0)"""


def _ref_law(spark, d):
    r = table(spark, d, "ref_row").where("law_name is not null").select("ref_id", "economy", "law_name", names("law_name").alias("w"))
    return r, table(spark, d, "corpus_law").select("law_id", "economy", "title", names("title").alias("w"))


@query(f"WITH {REF_LAW} SELECT economy, ref_id, law_id, shared, round(shared / least(na, nb), 6) AS overlap FROM pr WHERE shared / least(na, nb) >= 0.75")
def same_law_overlap(spark, d):
    """Reference names and laws that share three quarters of the words of the shorter."""
    return L.overlap_pairs(*_ref_law(spark, d), "economy", "ref_id", "law_id", "w", 0.75).withColumn("overlap", F.round("overlap", 6))


@query(f"WITH {REF_LAW} SELECT ref_id, max(CASE WHEN len(list_intersect(ry, ly)) > 0 OR len(ry) = 0 THEN 1 ELSE 0 END) = 1 AS known FROM (SELECT pr.*, regexp_extract_all(rr.law_name, '((?:19|20)[0-9][0-9])', 1) AS ry, regexp_extract_all(cl.title, '((?:19|20)[0-9][0-9])', 1) AS ly FROM pr JOIN ref_row rr USING (ref_id) JOIN corpus_law cl USING (law_id) WHERE shared / nb >= 0.75) GROUP BY 1")
def kit_known(spark, d):
    """Names that cover three quarters of a law's words with no other year."""
    r, law = _ref_law(spark, d)
    y = lambda c: F.regexp_extract_all(c, F.lit("((?:19|20)[0-9][0-9])"), 1)
    p = L.overlap_pairs(r, law, "economy", "ref_id", "law_id", "w", 0.75, "right").join(r.select("ref_id", y(F.col("law_name")).alias("ry")), "ref_id").join(law.select("law_id", y(F.col("title")).alias("ly")), "law_id")
    return p.groupBy("ref_id").agg(F.bool_or(F.arrays_overlap("ry", "ly") | (F.size("ry") == 0)).alias("known"))


@query(
    f"""WITH {REF_LAW}, s AS (SELECT ref_id, law_id, round(shared / (na + nb - shared), 9) AS score FROM pr WHERE shared >= 2 AND shared / (na + nb - shared) >= 0.62),
    k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY ref_id ORDER BY score DESC, law_id)) SELECT ref_id, law_id, round(score, 6) AS score FROM k WHERE k = 1 AND (next IS NULL OR score - next >= 0.02)"""
)
def link_law_best(spark, d):
    """The law that a reference name means by symmetric overlap of words, unless a second is as near."""
    r, law = _ref_law(spark, d)
    p = L.overlap_pairs(r, law, "economy", "ref_id", "law_id", "w", 0.62, "longer").where("shared >= 2").join(r.select("ref_id", F.size("w").alias("na")), "ref_id").join(law.select("law_id", F.size("w").alias("nb")), "law_id")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return L.best_link(p.where(j >= 0.62), "ref_id", "law_id", j, 0.02).withColumn("score", F.round("score", 6))


@query(
    f"""WITH u AS (SELECT ref_id, unnest(source_urls) AS u FROM ref_row), a AS (SELECT DISTINCT ref_id, law_id FROM u JOIN corpus_law ON {HOST_PATH_SQL.format(c='u')} = {HOST_PATH_SQL.format(c='source_url')}), {REF_LAW}, b AS (SELECT DISTINCT ref_id, law_id FROM pr WHERE shared / na >= 0.9)
    SELECT coalesce(a.ref_id, b.ref_id) AS ref_id, coalesce(a.law_id, b.law_id) AS law_id, CASE WHEN a.ref_id IS NOT NULL THEN 'url' ELSE 'name' END AS signal FROM a FULL JOIN b ON a.ref_id = b.ref_id AND a.law_id = b.law_id"""
)
def url_or_name_hit(spark, d):
    """Reference rows and laws that share an address, or else the name's words; the address goes before."""
    key = lambda c: T.url_host_path(F.col(c))
    u = table(spark, d, "ref_row").select("ref_id", F.explode("source_urls").alias("u")).select("ref_id", key("u").alias("k"))
    a = u.join(table(spark, d, "corpus_law").select("law_id", key("source_url").alias("k")), "k").select("ref_id", "law_id").distinct().withColumn("a", F.lit("url"))
    b = L.overlap_pairs(*_ref_law(spark, d), "economy", "ref_id", "law_id", "w", 0.9, "left").select("ref_id", "law_id").distinct()
    return a.join(b, ["ref_id", "law_id"], "full").select("ref_id", "law_id", F.coalesce("a", F.lit("name")).alias("signal"))


def _spines_sql(t, i):
    return f"SELECT {i} AS id, economy, indicator_id, list_distinct(flatten(list_transform(sections, lambda s: {SPINE_SQL.format(c='s')}))) AS spine FROM {t} WHERE sections IS NOT NULL"


@query(f"WITH a AS ({_spines_sql('ref_row', 'ref_id')}), b AS ({_spines_sql('label_row', 'label_id')}) SELECT DISTINCT a.id AS ref_id, b.id AS label_id FROM a JOIN b ON a.economy = b.economy AND a.indicator_id = b.indicator_id AND list_has_any(a.spine, b.spine)")
def spine_overlap_join(spark, d):
    """Reference rows and labels of one economy and indicator that name a common section."""
    one = lambda t, i: table(spark, d, t).select(F.col(i), "economy", "indicator_id", F.explode("sections").alias("s")).select(i, "economy", "indicator_id", F.explode(T.article_spine(F.col("s"))).alias("n")).distinct()
    return one("ref_row", "ref_id").join(one("label_row", "label_id"), ["economy", "indicator_id", "n"]).select("ref_id", "label_id").distinct()


@query(
    f"""WITH a AS ({_spines_sql('ref_row', 'ref_id')}), b AS ({_spines_sql('label_row', 'label_id')}), k AS (SELECT a.id, count(*) AS rows_, bool_or(list_has_any(a.spine, b.spine)) AS shared FROM a JOIN b ON a.economy = b.economy AND a.indicator_id = b.indicator_id GROUP BY 1)
    SELECT ref_id, CASE WHEN k.id IS NULL THEN 'NEW' WHEN shared THEN 'KNOWN' ELSE 'NEW_SECTION' END AS tag FROM ref_row LEFT JOIN k ON ref_id = k.id"""
)
def baseline_tag(spark, d):
    """Whether the labels know a row's sections, its indicator with other sections, or neither."""
    hit = spine_overlap_join(spark, d).select("ref_id").distinct().withColumn("hit", F.lit(True))
    have = table(spark, d, "label_row").where("sections is not null").select("economy", "indicator_id").distinct().withColumn("any", F.lit(True))
    r = table(spark, d, "ref_row").select("ref_id", "economy", "indicator_id", F.col("sections").isNotNull().alias("s"))
    j = r.join(hit, "ref_id", "left").join(have, ["economy", "indicator_id"], "left")
    return j.select("ref_id", F.when(F.col("any").isNull() | ~F.col("s"), "NEW").when(F.col("hit"), "KNOWN").otherwise("NEW_SECTION").alias("tag"))


_ENTRY_SQL = f"SELECT label_id || '#' || pos AS eid, economy || '|' || indicator_id AS k, {NAME_TOKENS_SQL.format(c='law')} AS w, list_distinct(flatten(list_transform(coalesce(sections, []), lambda s: {SPINE_SQL.format(c='s')}))) AS spine FROM (SELECT DISTINCT label_id, economy, indicator_id, sections, unnest(laws) AS law, unnest(range(len(laws))) AS pos FROM label_row WHERE laws IS NOT NULL) x WHERE law IS NOT NULL AND economy IS NOT NULL AND indicator_id IS NOT NULL"
_ROW_SQL = f"SELECT ref_id, economy || '|' || indicator_id AS k, {NAME_TOKENS_SQL.format(c='law_name')} AS w, list_distinct(flatten(list_transform(coalesce(sections, []), lambda s: {SPINE_SQL.format(c='s')}))) AS spine FROM ref_row WHERE law_name IS NOT NULL AND economy IS NOT NULL AND indicator_id IS NOT NULL"


@query(
    f"""WITH r AS ({_ROW_SQL}), e AS ({_ENTRY_SQL}), p AS (SELECT r.ref_id, r.spine AS a, e.spine AS b FROM r JOIN e ON r.k = e.k WHERE len(r.w) > 0 AND len(e.w) > 0 AND len(list_intersect(r.w, e.w)) >= 0.75 * least(len(r.w), len(e.w))),
    g AS (SELECT ref_id, bool_or(list_has_any(a, b)) AS cited, bool_or(len(b) > 0) AS named FROM p GROUP BY 1)
    SELECT r.ref_id, CASE WHEN g.ref_id IS NULL THEN 'NEW' WHEN cited THEN 'KNOWN' WHEN named THEN 'NEW_ARTICLE' ELSE 'KNOWN_LAW' END AS outcome FROM r LEFT JOIN g ON r.ref_id = g.ref_id"""
)
def baseline_outcomes(spark, d):
    """What the key knows of each reference row: nothing of its law, its article, its law at other articles, or its law without an article.

    Laws are the same if they share three quarters of the shorter one's words within economy and indicator.
    """
    key = F.concat("economy", F.lit("|"), "indicator_id")

    def spines(rows, ident):
        n = rows.select(ident, F.explode("sections").alias("s")).select(ident, F.explode(T.article_spine(F.col("s"))).alias("n"))
        return n.groupBy(ident).agg(F.sort_array(F.collect_set("n")).alias("spine"))

    none = F.array().cast("array<string>")
    refs = table(spark, d, "ref_row").where("law_name is not null and economy is not null and indicator_id is not null")
    r = refs.join(spines(refs, "ref_id"), "ref_id", "left").select("ref_id", key.alias("k"), names("law_name").alias("w"), F.coalesce("spine", none).alias("a"))
    labels = table(spark, d, "label_row").where("economy is not null and indicator_id is not null").select("label_id", "economy", "indicator_id", "laws", "sections").distinct()
    laws = labels.join(spines(labels, "label_id"), "label_id", "left").select("label_id", key.alias("k"), F.coalesce("spine", none).alias("b"), F.posexplode("laws").alias("pos", "law")).where("law is not null")
    e = laws.select(F.concat_ws("#", "label_id", "pos").alias("eid"), "k", names("law").alias("w"), "b")
    one = e.groupBy("k", "w", "b").agg(F.min("eid").alias("eid"))  # entries that say the same count once
    pairs = L.overlap_pairs(r, one, "k", "ref_id", "eid", "w", 0.75).select("ref_id", "k", "eid").distinct()
    j = pairs.join(r.select("ref_id", "a"), "ref_id").join(one.select("k", "eid", "b"), ["k", "eid"])
    g = j.groupBy("ref_id").agg(F.bool_or(F.arrays_overlap("a", "b")).alias("cited"), F.bool_or(F.size("b") > 0).alias("named"))
    return r.join(g, "ref_id", "left").select("ref_id", F.when(F.col("named").isNull(), "NEW").when(F.col("cited"), "KNOWN").when(F.col("named"), "NEW_ARTICLE").otherwise("KNOWN_LAW").alias("outcome"))


# ---- duplicates and sets ------------------------------------------------------------------------------------------


@query("SELECT text_sha, min(doc_id) AS keep, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS text_sha FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def dedup_content_hash(spark, d):
    """Texts by content: the document kept and the number of copies. Hashes shuffle, texts do not."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("text_sha")).agg(F.min("doc_id").alias("keep"), F.count("*").alias("copies"))


@query(
    f"""SELECT economy, family, law_id FROM (SELECT economy, {LAW_KEY_SQL.format(c='title')} AS family, law_id, row_number() OVER (PARTITION BY economy, {LAW_KEY_SQL.format(c='title')} ORDER BY status = 'active' DESC, contains(lower(title), 'amendment'), {LATEST_SQL.format(c='title')} DESC, length(title), law_id) AS k FROM corpus_law) WHERE k = 1"""
)
def dedup_pick_best(spark, d):
    """The best law of each family: in force, not an amendment, latest, shortest title."""
    law = table(spark, d, "corpus_law").withColumn("family", T.law_key(F.col("title")))
    order = [F.desc(F.col("status") == "active"), F.lower("title").contains("amendment"), F.desc(T.latest_year(F.col("title"))), F.length("title"), "law_id"]
    return M.latest(law, ["economy", "family"], order).select("economy", "family", "law_id")


@query(f"WITH a AS (SELECT economy, {LAW_KEY_SQL.format(c='title')} AS family, law_id, CAST(status <> 'repealed' AS INT) AS alive FROM corpus_law) SELECT economy, family, law_id FROM (SELECT *, max(alive) OVER (PARTITION BY economy, family) AS m FROM a) WHERE alive = m")
def never_empty_guard(spark, d):
    """Laws not repealed; a family of repealed laws only stays whole."""
    law = table(spark, d, "corpus_law").select("economy", T.law_key(F.col("title")).alias("family"), "law_id", "status")
    return M.unless_empty(law, ["economy", "family"], F.col("status") != "repealed").select("economy", "family", "law_id")


@query(
    f"""WITH a AS (SELECT law_id, economy, {LAW_KEY_SQL.format(c='title')} AS family, {LATEST_SQL.format(c='title')} AS y, collection = 'amendment' AS amends FROM corpus_law), p AS (SELECT DISTINCT economy, family FROM a WHERE NOT amends)
    SELECT law_id, family, y FROM (SELECT a.*, row_number() OVER (PARTITION BY economy, family ORDER BY y DESC, law_id) AS k FROM a JOIN p USING (economy, family) WHERE amends) WHERE k = 1"""
)
def amendment_collapse(spark, d):
    """The newest amendment of each family whose principal law is there."""
    a = table(spark, d, "corpus_law").select("law_id", "economy", T.law_key(F.col("title")).alias("family"), T.latest_year(F.col("title")).alias("y"), (F.col("collection") == "amendment").alias("amends"))
    own = a.where("amends").join(a.where("not amends"), ["economy", "family"], "left_semi")
    return M.latest(own, ["economy", "family"], [F.desc("y"), F.col("law_id")]).select("law_id", "family", "y")


@query("SELECT doc_key, min(src) AS first_source, count(*) AS rows_ FROM (SELECT doc_id AS doc_key, 'provisions' AS src FROM provisions WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, 'ocr' FROM ocr_result WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, 'pages' FROM fetched_page WHERE doc_id IS NOT NULL) GROUP BY 1")
def union_first_wins(spark, d):
    """Documents of three sources, each with the source it is taken from."""
    one = lambda t, s: table(spark, d, t).where("doc_id is not null").select(F.col("doc_id").alias("doc_key"), F.lit(s).alias("src"))
    u = one("provisions", "provisions").unionByName(one("ocr_result", "ocr")).unionByName(one("fetched_page", "pages"))
    return u.groupBy("doc_key").agg(F.min("src").alias("first_source"), F.count("*").alias("rows_"))


@query("SELECT law_id FROM corpus_law WHERE economy = 'SG' INTERSECT SELECT law_id FROM corpus_version")
def set_intersection(spark, d):
    return table(spark, d, "corpus_law").where("economy = 'SG'").select("law_id").intersect(table(spark, d, "corpus_version").select("law_id"))


# ---- aggregates ---------------------------------------------------------------------------------------------------


@query("SELECT economy, state, count(*) AS n FROM corpus_version GROUP BY GROUPING SETS ((economy), (state), ())")
def store_stats_grouping_sets(spark, d):
    v = table(spark, d, "corpus_version").select("economy", "state")
    return v.groupingSets([[v.economy], [v.state], []], v.economy, v.state).agg(F.count("*").alias("n")).select("economy", "state", "n")


IND = ["P6-I1", "P6-I2", "P6-I3", "P6-I4", "P6-I5", "P7-I1", "P7-I2", "P7-I3", "P7-I4"]


@query("SELECT law_name, " + ", ".join(f"max(CASE WHEN indicator_id = '{i}' THEN scope END) AS \"{i}\"" for i in IND) + ", count(DISTINCT indicator_id) AS covered FROM doc_rank WHERE law_name IS NOT NULL GROUP BY 1")
def coverage_matrix(spark, d):
    """Laws by indicators: the largest scope in each cell; the indicators are a fixed list, so the pivot needs no extra pass."""
    r = table(spark, d, "doc_rank").where("law_name is not null")
    m = r.groupBy("law_name").pivot("indicator_id", IND).agg(F.max("scope"))
    return m.join(r.groupBy("law_name").agg(F.countDistinct("indicator_id").alias("covered")), "law_name")


@query(
    """WITH u AS (SELECT event_type AS engine, count(*) AS calls, sum(value) AS units FROM events GROUP BY 1), p AS (SELECT * FROM (VALUES ('click', 0.01), ('view', 0.0), ('purchase', 0.2)) t(engine, rate))
    SELECT engine, calls, round(units, 4) AS units, round(units * rate, 4) AS cost, rate IS NOT NULL AS priced FROM u LEFT JOIN p USING (engine)"""
)
def cost_report(spark, d):
    """Usage by engine with its cost; an engine without a rate has none, not zero."""
    u = table(spark, d, "events").groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("calls"), F.sum("value").alias("units"))
    p = spark.createDataFrame([("click", 0.01), ("view", 0.0), ("purchase", 0.2)], "engine string, rate double")
    return u.join(p, "engine", "left").select("engine", "calls", F.round("units", 4).alias("units"), F.round(F.col("units") * F.col("rate"), 4).alias("cost"), F.col("rate").isNotNull().alias("priced"))


TGT = "t AS (SELECT t.target_id, t.indicator_id, t.economy, min(r.p) AS place FROM trace_target t LEFT JOIN (SELECT economy, indicator_id, law_name, row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY semantic DESC NULLS LAST, doc_id, keyword DESC NULLS LAST) AS p FROM doc_rank) r ON t.economy = r.economy AND t.indicator_id = r.indicator_id AND t.law_label = r.law_name GROUP BY 1, 2, 3)"


def _targets(spark, d):
    w = Window.partitionBy("run_id", "indicator_id").orderBy(F.desc_nulls_last("semantic"), "doc_id", F.desc_nulls_last("keyword"))
    r = table(spark, d, "doc_rank").select("economy", "indicator_id", F.col("law_name").alias("law_label"), F.row_number().over(w).alias("p"))
    t = table(spark, d, "trace_target").select("target_id", "indicator_id", "economy", "law_label")
    return t.join(r, ["economy", "indicator_id", "law_label"], "left").groupBy("target_id", "indicator_id", "economy").agg(F.min("p").alias("place"))


@query(f"WITH {TGT} SELECT indicator_id, count(*) AS targets, round(avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, min(place) AS best, list_sort(list(place) FILTER (WHERE place IS NOT NULL))[CAST(floor(count(place) / 2) AS BIGINT) + 1] AS upper_median FROM t GROUP BY 1")
def retrieval_metrics(spark, d):
    """By indicator: share of targets among the first ten, best place and upper median of places."""
    # targets are counted by place first, so the window orders places, not targets
    n = _targets(spark, d).groupBy("indicator_id", "place").agg(F.count("*").alias("n"))
    g = n.groupBy("indicator_id").agg(F.sum("n").alias("targets"), F.round(F.sum(F.when(F.col("place") <= 10, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("recall_10"), F.min("place").alias("best"), F.floor(F.sum(F.when(F.col("place").isNotNull(), F.col("n"))) / 2).alias("half"))
    up_to = F.sum("n").over(Window.partitionBy("indicator_id").orderBy("place"))
    m = n.where("place is not null").withColumn("up_to", up_to).join(g, "indicator_id").where(F.col("up_to") > F.col("half")).groupBy("indicator_id").agg(F.min("place").alias("upper_median"))
    return g.join(m, "indicator_id", "left").select("indicator_id", "targets", "recall_10", "best", "upper_median")


@query(f"WITH {TGT} SELECT economy, count(*) AS targets, count(*) FILTER (WHERE place <= 1) AS at_1, count(*) FILTER (WHERE place <= 5) AS at_5, count(*) FILTER (WHERE place <= 20) AS at_20, count(place) AS found FROM t GROUP BY 1")
def recall_curve(spark, d):
    return _targets(spark, d).groupBy("economy").agg(F.count("*").alias("targets"), *(F.count_if(F.col("place") <= k).alias(f"at_{k}") for k in (1, 5, 20)), F.count("place").alias("found"))


@query(
    """WITH c AS (SELECT l.kind = 'provision' AS truth, l.raw_score >= 0.5 AS said FROM label_row l WHERE l.kind IS NOT NULL AND l.raw_score IS NOT NULL), n AS (SELECT count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, count(*) FILTER (WHERE NOT truth AND NOT said) AS tn FROM c)
    SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall_, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM n"""
)
def confusion_metrics(spark, d):
    c = table(spark, d, "label_row").where("kind is not null and raw_score is not null").select((F.col("kind") == "provision").alias("t"), (F.col("raw_score") >= 0.5).alias("s"))
    n = c.agg(F.count_if(F.col("t") & F.col("s")).alias("tp"), F.count_if(~F.col("t") & F.col("s")).alias("fp"), F.count_if(F.col("t") & ~F.col("s")).alias("fn"), F.count_if(~F.col("t") & ~F.col("s")).alias("tn"))
    r = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", r(tp, tp + fp).alias("precision_"), r(tp, tp + fn).alias("recall_"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), r(tp + tn, tp + fp + fn + tn).alias("accuracy"))


@query(
    """WITH x AS (SELECT run_id, indicator_id, scope >= 1 OR scope >= 100 AS pos, semantic AS s FROM doc_rank WHERE semantic IS NOT NULL AND scope IS NOT NULL), y AS (SELECT run_id, indicator_id, CASE WHEN pos THEN 1 ELSE 0 END AS pos, rank() OVER w + (count(*) OVER (PARTITION BY run_id, indicator_id, s) - 1) / 2.0 AS r FROM x WINDOW w AS (PARTITION BY run_id, indicator_id ORDER BY s))
    SELECT run_id, indicator_id, round((sum(CASE WHEN pos = 1 THEN r ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * (count(*) - sum(pos)), 0), 6) AS auc FROM y GROUP BY 1, 2"""
)
def auc_ranksum(spark, d):
    """Area under the curve of each ranking by the sum of ranks, ties at their middle; no pairs are formed."""
    x = table(spark, d, "doc_rank").where("semantic is not null and scope is not null").select("run_id", "indicator_id", ((F.col("scope") >= 1) | (F.col("scope") >= 100)).cast("int").alias("pos"), "semantic")
    w, t = Window.partitionBy("run_id", "indicator_id").orderBy("semantic"), Window.partitionBy("run_id", "indicator_id", "semantic")
    y = x.withColumn("r", F.rank().over(w) + (F.count("*").over(t) - 1) / 2.0)
    p, n = F.sum("pos"), F.count("*")
    return y.groupBy("run_id", "indicator_id").agg(F.round((F.sum(F.when(F.col("pos") == 1, F.col("r")).otherwise(0)) - p * (p + 1) / 2.0) / F.nullif(p * (n - p), F.lit(0)), 6).alias("auc"))


STAGES = ["DISCOVERY", "FETCH", "EXTRACTION", "RETRIEVAL", "GRADING", "SURVIVED"]


@query("SELECT economy, lost_at, count(*) AS n, count(DISTINCT indicator_id) AS indicators, bool_or(primary_section IS NOT NULL) AS has_section FROM trace_target WHERE lost_at IS NOT NULL GROUP BY 1, 2")
def funnel_first_loss(spark, d):
    return table(spark, d, "trace_target").where("lost_at is not null").groupBy("economy", "lost_at").agg(F.count("*").alias("n"), F.countDistinct("indicator_id").alias("indicators"), F.bool_or(F.col("primary_section").isNotNull()).alias("has_section"))


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT regexp_extract_all(lower(title), '([a-z]+)', 1) AS w FROM corpus_law)) GROUP BY 1 ORDER BY n DESC, gram LIMIT 30")
def ngram_top(spark, d):
    """The 30 most frequent pairs of words in titles."""
    w = table(spark, d, "corpus_law").select(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"), 1).alias("w")).where("size(w) > 1")
    g = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(30)


@query("WITH t AS (SELECT unnest(['register', 'tribunal', 'zebra', 'данные', 'the', '登记']) AS term), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), f AS (SELECT term, count(*) AS df FROM t JOIN documents ON contains(lower(text), term) GROUP BY 1) SELECT term, coalesce(df, 0) AS df, CASE WHEN coalesce(df, 0) = 0 THEN 'DEAD' WHEN df > 0.25 * n THEN 'NOISE' ELSE 'OK' END AS verdict FROM t LEFT JOIN f USING (term), n")
def term_audit(spark, d):
    """How many documents hold each search term: none, too many, or a useful number. One pass over the texts."""
    terms = ["register", "tribunal", "zebra", "данные", "the", "登记"]
    doc = table(spark, d, "documents").where("text is not null").select(F.lower("text").alias("t"))
    one = doc.agg(F.count("*").alias("n"), F.array(*(F.struct(F.lit(x).alias("term"), F.count_if(F.contains("t", F.lit(x))).alias("df")) for x in terms)).alias("a"))
    e = one.select("n", F.explode("a").alias("x")).select("n", "x.term", "x.df")
    return e.select("term", "df", F.when(F.col("df") == 0, "DEAD").when(F.col("df") > F.col("n") * 0.25, "NOISE").otherwise("OK").alias("verdict"))


@query("SELECT indicator_id, raw_score, count(*) AS n, count(DISTINCT law_name) AS laws FROM ref_row GROUP BY 1, 2")
def score_distribution(spark, d):
    return table(spark, d, "ref_row").groupBy("indicator_id", "raw_score").agg(F.count("*").alias("n"), F.countDistinct("law_name").alias("laws"))


@query("SELECT workbook_id, indicator_id, max(raw_score) AS most, min(raw_score) AS least_, count(*) FILTER (WHERE raw_score = 0.5) >= 2 OR max(raw_score) >= 1 AS strict FROM ref_row GROUP BY 1, 2")
def indicator_rollup(spark, d):
    """Scores of an indicator rolled up: the most, the least, and whether two halves make a whole."""
    s = F.col("raw_score")
    return table(spark, d, "ref_row").groupBy("workbook_id", "indicator_id").agg(F.max(s).alias("most"), F.min(s).alias("least_"), ((F.count_if(s == 0.5) >= 2) | (F.max(s) >= 1)).alias("strict"))


@query("SELECT label_id, CASE WHEN coalesce(len(sections), 0) > 0 THEN 'provision' WHEN regexp_matches(lower(impact), 'no |not |tidak|не |不得') THEN 'absence' ELSE 'unclear' END AS kind_ FROM label_row")
def absence_detection(spark, d):
    """A named section beats the wording of absence."""
    return table(spark, d, "label_row").select("label_id", F.when(F.coalesce(F.size("sections"), F.lit(0)) > 0, "provision").when(F.lower("impact").rlike("no |not |tidak|не |不得"), "absence").otherwise("unclear").alias("kind_"))


@query("SELECT economy, indicator_id, list_sort(list_distinct(flatten(list(sections)))) AS sections FROM label_row WHERE sections IS NOT NULL AND len(sections) > 0 GROUP BY 1, 2")
def targets_by_indicator(spark, d):
    s = table(spark, d, "label_row").select("economy", "indicator_id", F.explode("sections").alias("s"))
    return s.groupBy("economy", "indicator_id").agg(F.sort_array(F.collect_set("s")).alias("sections"))


@query("SELECT md5('seed' || doc_id) AS h, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('seed' || doc_id)) <= 5")
def stratified_sample(spark, d):
    """Five documents of each source, chosen by a seeded digest: the same on every run and any cluster."""
    h = table(spark, d, "documents").select("doc_id", "source", T.hash_order(F.col("doc_id"), "seed").alias("h"))
    return h.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("h"))).where("k <= 5").select("h", "doc_id")


# ---- kept tables --------------------------------------------------------------------------------------------------

INSTANT = "CAST(CASE WHEN regexp_matches(updated_at, '(Z|[+-][0-9]{2}(:?[0-9]{2})?)$') THEN updated_at ELSE updated_at || 'Z' END AS TIMESTAMPTZ)"


def _versions(spark, d):
    from lexloom.operators.incremental import instant

    return table(spark, d, "corpus_version").withColumn("t", instant(F.col("updated_at")))


@query(f"SELECT version_id, law_id, state, write_seq FROM corpus_version QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY {INSTANT} DESC, write_seq DESC) = 1")
def latest_per_key(spark, d):
    return M.latest(_versions(spark, d), ["version_id"], [F.desc("t"), F.desc("write_seq")]).select("version_id", "law_id", "state", "write_seq")


@query(
    f"""WITH v AS (SELECT version_id, law_id, max(struct_pack(t := {INSTANT}, s := write_seq)) AS m FROM corpus_version GROUP BY 1, 2) SELECT version_id, CASE WHEN first_value(version_id) OVER w <> version_id THEN first_value(version_id) OVER w END AS superseded_by FROM v WINDOW w AS (PARTITION BY law_id ORDER BY m.t DESC, m.s DESC, version_id)"""
)
def supersede_versions(spark, d):
    """Every version of a law but the newest points to the newest."""
    v = _versions(spark, d).groupBy("version_id", "law_id").agg(F.max(F.struct("t", "write_seq")).alias("m"))
    new = F.first("version_id").over(Window.partitionBy("law_id").orderBy(F.desc("m"), "version_id"))
    return v.withColumn("new", new).select("version_id", F.when(F.col("new") != F.col("version_id"), F.col("new")).alias("superseded_by"))


@query(
    """WITH n AS (SELECT law_id, economy, 'checked' AS status, '2026-01-01' AS first_seen FROM corpus_law WHERE economy IN ('SG', 'AU') UNION ALL SELECT 'new-' || law_id, economy, 'active', '2026-01-01' FROM corpus_law WHERE economy = 'LA')
    SELECT coalesce(o.law_id, n.law_id) AS law_id, coalesce(o.economy, n.economy) AS economy, CASE WHEN n.law_id IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(o.first_seen, n.first_seen) AS first_seen FROM corpus_law o FULL JOIN n ON o.law_id = n.law_id"""
)
def upsert_first_seen(spark, d):
    """An upsert that keeps when a law was first seen."""
    o = table(spark, d, "corpus_law").select("law_id", "economy", "status", "first_seen")
    n = o.where("economy in ('SG', 'AU')").withColumns({"status": F.lit("checked"), "first_seen": F.lit("2026-01-01")})
    n = n.unionByName(o.where("economy = 'LA'").withColumns({"law_id": F.concat(F.lit("new-"), "law_id"), "status": F.lit("active"), "first_seen": F.lit("2026-01-01")}))
    return M.upsert(o, n, ["law_id"], ["first_seen", "economy"])


@query("SELECT run_id, count(*) AS n FROM (SELECT run_id, doc_id FROM provisions WHERE doc_id NOT IN (SELECT doc_id FROM ocr_result WHERE doc_id IS NOT NULL) OR doc_id IS NULL UNION ALL SELECT 'rescan', doc_id FROM ocr_result WHERE doc_id IS NOT NULL) GROUP BY 1")
def replace_provisions(spark, d):
    """Provisions of rescanned documents replaced by the scans' rows."""
    old = table(spark, d, "provisions").select("run_id", "doc_id")
    new = table(spark, d, "ocr_result").where("doc_id is not null").select(F.lit("rescan").alias("run_id"), "doc_id")
    return M.replace_group(old, new, ["doc_id"]).groupBy("run_id").agg(F.count("*").alias("n"))


@query("SELECT run_id, count(*) AS n FROM provisions WHERE run_id IS NULL OR run_id NOT IN (SELECT run_id FROM (SELECT run_id, count(*) AS c FROM provisions WHERE run_id IS NOT NULL GROUP BY 1) WHERE c < 50) GROUP BY 1")
def cascade_delete(spark, d):
    """Runs of fewer than 50 provisions are deleted with all their rows."""
    p = table(spark, d, "provisions").select("run_id", "doc_id")
    dead = p.where("run_id is not null").groupBy("run_id").count().where("count < 50")
    return M.delete_where_in(p, dead, ["run_id"]).groupBy("run_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, i := event_id)) AS value FROM events GROUP BY 1, 2")
def review_fold(spark, d):
    """An append-only log folded to the last value of each key and field."""
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return M.fold(e, "user_id", "event_type", "value", "o")


@query("SELECT e.economy, count(*) FILTER (WHERE v.n IS NULL) AS unverified, count(*) FILTER (WHERE e.last_checked < '2025-02-01') AS stale, count(*) AS laws FROM corpus_law e LEFT JOIN (SELECT law_id, count(*) AS n FROM corpus_version GROUP BY 1) v USING (law_id) GROUP BY 1")
def freshness_check(spark, d):
    v = table(spark, d, "corpus_version").groupBy("law_id").agg(F.count("*").alias("n"))
    j = table(spark, d, "corpus_law").select("law_id", "economy", "last_checked").join(v, "law_id", "left")
    return j.groupBy("economy").agg(F.count_if(F.col("n").isNull()).alias("unverified"), F.count_if(F.col("last_checked") < "2025-02-01").alias("stale"), F.count("*").alias("laws"))


@query("WITH f AS (SELECT law_id FROM corpus_law WHERE hash(law_id) IS NOT NULL AND economy <> 'TH'), k AS (SELECT law_id FROM corpus_version) SELECT 'new' AS diff, count(*) AS n FROM f WHERE law_id NOT IN (SELECT law_id FROM k) UNION ALL SELECT 'missing', count(DISTINCT law_id) FROM k WHERE law_id NOT IN (SELECT law_id FROM f)")
def sweep_diff(spark, d):
    """What a sweep found that the store lacks, and what the store has that it did not find."""
    f = table(spark, d, "corpus_law").where("economy <> 'TH'").select("law_id")
    k = table(spark, d, "corpus_version").select("law_id")
    a = f.join(k, "law_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("new").alias("diff"), "n")
    return a.unionByName(k.join(f, "law_id", "left_anti").agg(F.countDistinct("law_id").alias("n")).select(F.lit("missing").alias("diff"), "n"))


# ---- windows over event logs --------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 600, false) AS too_soon FROM events")
def polite_gap(spark, d):
    """Seconds since the host's last request, and whether that is under its delay."""
    gap = F.timestamp_diff("SECOND", F.date_trunc("second", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))), F.date_trunc("second", "ts"))
    return table(spark, d, "events").select("user_id", "event_id", gap.alias("gap")).withColumn("too_soon", F.coalesce(F.col("gap") < 600, F.lit(False)))


@query(
    """WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) FILTER (WHERE event_type <> 'purchase') AS n FROM i GROUP BY 1, 2) GROUP BY 1"""
)
def circuit_breaker(spark, d):
    """The longest run of empty answers of each engine, reset by a success."""
    e = table(spark, d, "events").withColumn("island", F.sum((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id", "island").agg(F.count_if(F.col("event_type") != "purchase").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("SELECT user_id, event_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stage FROM events")
def stage_fold(spark, d):
    """The furthest stage that a log has reached at each entry; it never goes back."""
    s = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(0)
    return table(spark, d, "events").select("user_id", "event_id", F.max(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("stage"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, CAST(sid AS BIGINT) AS sid, count(*) AS events, min(ts) AS began FROM s GROUP BY 1, 2"""
)
def sessionize(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") > F.lag("ts").over(w) + F.expr("INTERVAL 30 MINUTES")).cast("int"), F.lit(0))
    s = table(spark, d, "events").withColumn("new", new).withColumn("sid", F.sum("new").over(w))
    return s.groupBy("user_id", "sid").agg(F.count("*").alias("events"), F.min("ts").alias("began"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_usage(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- access rules, crawls, reports --------------------------------------------------------------------------------

@query(f"SELECT economy, {CLEAN_SQL.format(c='title')} AS title, source_url, law_number, status FROM corpus_law WHERE status = 'active'")
def export_projection(spark, d):
    """The rows and columns of an export."""
    return table(spark, d, "corpus_law").where("status = 'active'").select("economy", T.clean_title(F.col("title")).alias("title"), "source_url", "law_number", "status")


@query("SELECT ref_id, row_number() OVER (ORDER BY economy NULLS LAST, indicator_id NULLS LAST, coalesce(law_name, '~'), ref_id) AS line FROM ref_row")
def master_order(spark, d):
    """The order of lines in a report; a missing name comes last. Numbers come from ranges, not from one sorted partition."""
    from lexloom.operators.ranking import running_total

    r = table(spark, d, "ref_row").select("ref_id", F.coalesce("economy", F.lit("￿")).alias("e"), F.coalesce("indicator_id", F.lit("￿")).alias("i"), F.coalesce("law_name", F.lit("~")).alias("l"), F.lit("all").alias("g"), F.lit(1).alias("one"))
    return running_total(r, ["g"], [F.col("e"), F.col("i"), F.col("l"), F.col("ref_id")], "one", "before").select("ref_id", (F.col("before") + 1).alias("line"))
