"""Queries that need Python: error rates of words, greedy choices, table functions, plug-in graders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import plugins as P
from lexloom.functions import text as T
from lexloom.operators.retrieval import top_k
from lexloom.plans.text_plans import ORACLE as TEXT_ORACLE
from lexloom.plans.text_plans import paired
from lexloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        ORACLE[f.__name__] = sql
    return f


WER_SQL = r"""WITH j AS (SELECT ref_id, target_id, list_filter(string_split_regex(law_name, '\s+'), lambda w: w <> '') AS r, list_filter(string_split_regex(law_label, '\s+'), lambda w: w <> '') AS h
    FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, indicator_id ORDER BY ref_id) AS place FROM ref_row WHERE law_name IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY workbook_id, indicator_id ORDER BY target_id) AS place FROM trace_target WHERE law_label IS NOT NULL) b USING (workbook_id, indicator_id, place)), k AS (SELECT *, list_concat(r, h) AS known FROM j),
  s AS (SELECT *, array_to_string(list_transform(r, lambda w: chr(CAST(32 + list_position(known, w) AS INT))), '') AS a, array_to_string(list_transform(h, lambda w: chr(CAST(32 + list_position(known, w) AS INT))), '') AS b FROM k)
SELECT ref_id, target_id, CASE WHEN r IS NULL OR h IS NULL THEN NULL WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(a, b) / len(r), 4) END AS wer FROM s"""


def word_error_rate(spark, d):
    """Word error rate of target labels against reference names, the k-th with the k-th of a workbook and indicator."""
    return paired(spark, d).select("ref_id", "target_id", P.word_error_rate(F.col("law_name"), F.col("law_label")).alias("wer"))


query(word_error_rate, WER_SQL)

# The names of economies and their codes.
ECONOMIES = {
    "Singapore": "SG", "Australia": "AU", "Malaysia": "MY", "China": "CN", "People's Republic of China": "CN", "India": "IN", "Republic of India": "IN", "Indonesia": "ID", "Republic of Indonesia": "ID",
    "Russia": "RU", "Russian Federation": "RU", "Viet Nam": "VN", "Vietnam": "VN", "Thailand": "TH", "Kingdom of Thailand": "TH", "Mongolia": "MN", "Kazakhstan": "KZ", "Lao PDR": "LA", "Laos": "LA", "Lao People's Democratic Republic": "LA",
}
ECONOMY_COLUMNS = ["corpus_law", "corpus_version", "provisions", "ref_row", "label_row", "trace_target", "doc_rank", "ocr_result", "documents", "fetched_page"]
_ALIASES_SQL = ", ".join("('{}', '{}')".format(k.lower().replace("'", "''"), v) for k, v in {**ECONOMIES, **{v: v for v in ECONOMIES.values()}}.items())
ECONOMY_SQL = f"""WITH a AS (SELECT * FROM (VALUES {_ALIASES_SQL}) t(alias, code)), e AS ({' UNION ALL '.join(f'SELECT economy AS name FROM {t}' for t in ECONOMY_COLUMNS)}), n AS (SELECT name, lower(trim(name)) AS k, count(*) AS n FROM e GROUP BY 1, 2)
SELECT name, code, n FROM n LEFT JOIN a ON n.k = a.alias"""


def economy_resolve(spark, d):
    """The economies of all tables, as they are written there, with their codes; a test has misspelt and longer names."""
    e = None
    for t in ECONOMY_COLUMNS:
        one = table(spark, d, t).select(F.col("economy").alias("name"))
        e = one if e is None else e.union(one)
    n = e.groupBy("name").agg(F.count("*").alias("n"))
    return n.select("name", P.resolve_alias(F.col("name"), {**ECONOMIES, **{v: v for v in ECONOMIES.values()}}).alias("code"), "n")


query(economy_resolve, ECONOMY_SQL)


@query
def same_law_dedup(spark, d):
    """Documents of one law that repeat another's sections."""
    p = table(spark, d, "provisions").where("law_name is not null and doc_id is not null and article_section is not null")
    s = p.groupBy("law_name", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list(T.article_spine(F.col("article_section"))))).alias("spine"), F.countDistinct("provision_id").alias("n"))
    return P.greedy_same_law(s, "law_name", "doc_id", "spine", "n")


@query
def udtf_split_provisions(spark, d):
    P.register(spark)
    table(spark, d, "body_file").select("body_path", "body").createOrReplaceTempView("bodies")
    return spark.sql(r"SELECT body_path, p.segment, p.label FROM bodies, LATERAL split_provisions(body, '^(?:PART|Section|Pasal|Điều|Статья) [0-9]+') p")


@query
def plugin_grader(spark, d):
    """Reference names graded against their rationale by the offline grader."""
    r = table(spark, d, "ref_row").select("ref_id", "law_name", "rationale")
    return P.grade(r, "law_name", "rationale").select("ref_id", "grade.relevant", "grade.score", "grade.failed")


@query
def json_repair(spark, d):
    """The last object of model-like answers made of the stored provision records."""
    p = table(spark, d, "provisions").where("prov_json is not null").select("provision_id", F.concat(F.lit("<think>{no}</think> answer {\"draft\": 1}\n```json\n"), "prov_json", F.lit("\n```")).alias("said"))
    return p.select("provision_id", F.md5(P.last_json_object(F.col("said"))).alias("object_md5")).distinct()


RETRIEVED = ["auto", "keyword", "semantic", "graph"]
_O = "o AS (SELECT run_id, indicator_id, doc_id, max(keyword) AS k, max(semantic) AS s FROM doc_rank WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT *, coalesce(k / CASE WHEN max(k) OVER w > 0 THEN max(k) OVER w ELSE 1 END, 0) AS kn, coalesce(s / CASE WHEN max(s) OVER w > 0 THEN max(s) OVER w ELSE 1 END, 0) AS sn FROM o WINDOW w AS (PARTITION BY run_id, indicator_id))"
CHOICE_SQL = f"""WITH {_O}, a AS (SELECT unnest(['auto', 'keyword', 'semantic', 'graph']) AS asked, * FROM n), z AS (SELECT *, CASE asked WHEN 'keyword' THEN 'keyword' WHEN 'semantic' THEN 'semantic' ELSE 'hybrid' END AS used,
  CASE asked WHEN 'keyword' THEN coalesce(k, 0) WHEN 'semantic' THEN coalesce(s, 0) ELSE 0.65 * kn + 0.35 * sn END AS score FROM a)
SELECT asked, used, run_id, indicator_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY asked, run_id, indicator_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM z) WHERE place <= 3"""


def retriever_choice(spark, d):
    """The three best candidates of each ranking by the retriever that each strategy gets: one that is not there falls back."""
    c = table(spark, d, "doc_rank").where("doc_id is not null").groupBy("run_id", "indicator_id", "doc_id").agg(F.max("keyword").alias("keyword"), F.max("semantic").alias("semantic"))
    out = None
    for asked in RETRIEVED:
        used, f = P.choose_retriever(asked)
        top = top_k(f(c), ["run_id", "indicator_id"], [F.desc(F.round("score", 9)), F.col("doc_id")], 3)
        one = top.select(F.lit(asked).alias("asked"), F.lit(used).alias("used"), "run_id", "indicator_id", "doc_id", F.col("rank").alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


query(retriever_choice, CHOICE_SQL)


def plugin_reader(spark, d):
    """Pages and confidences of every document by the reader that is registered as mock."""
    p = P.read_pages(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return p.select("doc_id", "page", F.length("text").alias("chars"), F.round("confidence", 4).alias("confidence"))


query(plugin_reader, TEXT_ORACLE["mock_ocr_pages"])
