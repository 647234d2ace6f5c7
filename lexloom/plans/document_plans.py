"""Queries on titles, tables and footers within documents, and on groups of name variants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.operators import structure as S
from lexloom.plans.structure_plans import LINES
from lexloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lines(spark, d):
    return S.lines(table(spark, d, "documents").select("doc_id", "text"))


@query(
    rf"""WITH {LINES}, r AS (SELECT *, contains(line, '|') AND row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) > 1 AS again, last_value(CASE WHEN regexp_matches(line, '\S') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM ln),
    x AS (SELECT doc_id, line_no FROM r WHERE again UNION SELECT doc_id, above FROM r WHERE again AND above IS NOT NULL) SELECT doc_id, count(*) AS dropped FROM x GROUP BY 1"""
)
def table_continuation(spark, d):
    """Rows of tables that repeat an earlier row, and the line above each, as continued tables have them: how many go."""
    before = F.last(F.when(F.col("line").rlike(r"\S"), F.col("line_no")), ignorenulls=True).over(S.in_document().rowsBetween(Window.unboundedPreceding, -1))
    k = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("line_no"))
    r = _lines(spark, d).withColumn("again", F.contains("line", F.lit("|")) & (k > 1)).withColumn("above", before).where("again")
    x = r.select("doc_id", F.explode(F.array_compact(F.array("line_no", "above"))).alias("line_no")).distinct()
    return x.groupBy("doc_id").agg(F.count("*").alias("dropped"))


@query(
    rf"""WITH {LINES}, w AS (SELECT l.doc_id, line_no, list_distinct(regexp_extract_all(lower(line), '([\p{{L}}]+)', 1)) AS a, list_distinct(regexp_extract_all(lower(title), '([\p{{L}}]+)', 1)) AS b FROM ln l JOIN documents d ON l.doc_id = d.doc_id WHERE title IS NOT NULL)
    SELECT doc_id, line_no FROM w WHERE len(a) >= 2 AND len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0"""
)
def edition_footer(spark, d):
    """Lines made of words of the document's title only."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), 1))
    title = table(spark, d, "documents").where("title is not null").select("doc_id", words("title").alias("b"))
    w = _lines(spark, d).select("doc_id", "line_no", words("line").alias("a")).where("size(a) >= 2").join(title, "doc_id")
    return w.where(F.size(F.array_except("a", "b")) == 0).select("doc_id", "line_no")


@query(
    rf"""WITH {LINES}, c AS (SELECT l.doc_id, line_no, trim(line) AS line FROM ln l JOIN documents d ON l.doc_id = d.doc_id WHERE title IS NOT NULL AND length(title) >= 12 AND starts_with(trim(line), substring(title, 1, 12)) AND length(trim(line)) >= length(title))
    SELECT doc_id, arg_min(line, line_no) AS full_title FROM c GROUP BY 1"""
)
def truncated_title(spark, d):
    """The first line that begins like the title and is at least as long: the title in full."""
    title = table(spark, d, "documents").where("title is not null and length(title) >= 12").select("doc_id", "title")
    c = _lines(spark, d).join(title, "doc_id").where(F.startswith(F.trim("line"), F.substring("title", 1, 12)) & (F.length(F.trim("line")) >= F.length("title")))
    return c.groupBy("doc_id").agg(F.min_by(F.trim("line"), "line_no").alias("full_title"))


@query(
    rf"""WITH {LINES}, s AS (SELECT doc_id, line_no, trim(line) AS line, CAST(regexp_matches(line, '(?:Act|Code|Rules|Regulations|Ordinance|Undang|Peraturan|Luật|Nghị|Закон|Положение|法|条例|办法)') AS INT) * 2 + CAST(regexp_matches(line, '(?:1[89]|20)[0-9][0-9]') AS INT) + CAST(length(trim(line)) BETWEEN 8 AND 90 AS INT) - CAST(regexp_matches(trim(line), '[.;:。]$') AS INT) * 2 AS score FROM ln)
    SELECT doc_id, arg_max(line, struct_pack(s := score, n := -line_no)) AS law_name FROM s WHERE score >= 3 GROUP BY 1"""
)
def law_name_recovery(spark, d):
    """The line of a document that looks most like the name of a law, the earlier of equals."""
    ln = _lines(spark, d).withColumn("t", F.trim("line"))
    n = lambda c: c.cast("int")
    score = n(F.col("line").rlike("(?:Act|Code|Rules|Regulations|Ordinance|Undang|Peraturan|Luật|Nghị|Закон|Положение|法|条例|办法)")) * 2 + n(F.col("line").rlike("(?:1[89]|20)[0-9][0-9]")) + n(F.length("t").between(8, 90)) - n(F.col("t").rlike("[.;:。]$")) * 2
    return ln.withColumn("score", score).where("score >= 3").groupBy("doc_id").agg(F.max_by("t", F.struct("score", -F.col("line_no"))).alias("law_name"))


@query("SELECT ocr_id, CASE WHEN len(string_split(text, chr(12))) = 2 * len(pages) + 1 THEN 'by page' ELSE 'whole' END AS split, coalesce(len(pages), 0) AS pages FROM ocr_result WHERE text IS NOT NULL")
def provider_page_split(spark, d):
    """Whether a whole text falls into its pages at its marks, or has to stay whole."""
    o = table(spark, d, "ocr_result").where("text is not null")
    fits = F.coalesce(F.size(F.split("text", "\f")) == F.size("pages") * 2 + 1, F.lit(False))
    return o.select("ocr_id", F.when(fits, "by page").otherwise("whole").alias("split"), F.coalesce(F.size("pages"), F.lit(0)).alias("pages"))


@query(
    r"""WITH m AS (SELECT economy, indicator_id, unnest(laws) AS law FROM label_row), k AS (SELECT economy, indicator_id, law, trim(regexp_replace(lower(law), '[^\p{L}\p{N}]+', ' ', 'g')) AS key_ FROM m WHERE law IS NOT NULL)
    SELECT economy, indicator_id, key_, count(*) AS mentions, count(DISTINCT law) AS variants FROM k GROUP BY 1, 2, 3"""
)
def answer_key_groups(spark, d):
    """Mentions of laws in the answer key by indicator, variants of punctuation and case together."""
    m = table(spark, d, "label_row").select("economy", "indicator_id", F.explode("laws").alias("law")).where("law is not null")
    key = F.trim(F.regexp_replace(F.lower("law"), r"[^\p{L}\p{N}]+", " "))
    return m.groupBy("economy", "indicator_id", key.alias("key_")).agg(F.count("*").alias("mentions"), F.countDistinct("law").alias("variants"))


@query(
    """WITH l AS (SELECT DISTINCT economy, upper(regexp_extract(s, '([0-9]+[A-Za-z]?)', 1)) AS k FROM (SELECT economy, unnest(sections) AS s FROM label_row) WHERE s IS NOT NULL), p AS (SELECT economy, upper(regexp_extract(article_section, '([0-9]+[A-Za-z]?)', 1)) AS k, count(*) AS n FROM provisions WHERE article_section IS NOT NULL GROUP BY 1, 2)
    SELECT l.economy, count(*) AS cited, count(p.k) AS present, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS provisions FROM l LEFT JOIN p ON l.economy = p.economy AND l.k = p.k WHERE l.k <> '' GROUP BY 1"""
)
def section_matches(spark, d):
    """Sections that labels cite and that provisions of the economy have."""
    key = lambda c: F.upper(F.regexp_extract(c, "([0-9]+[A-Za-z]?)", 1))
    cited = table(spark, d, "label_row").select("economy", F.explode("sections").alias("s")).where("s is not null").select("economy", key("s").alias("k")).where("k <> ''").distinct()
    p = table(spark, d, "provisions").where("article_section is not null").groupBy("economy", key("article_section").alias("k")).agg(F.count("*").alias("n"), F.lit(1).alias("there"))
    j = cited.join(p, ["economy", "k"], "left")
    return j.groupBy("economy").agg(F.count("*").alias("cited"), F.count("there").alias("present"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("provisions"))


@query("SELECT doc_id, round(avg(CASE WHEN regexp_matches(c, '\\p{Lu}') THEN 1.0 ELSE 0.0 END), 6) AS upper_share FROM (SELECT doc_id, unnest(regexp_extract_all(title, '(\\p{L})', 1)) AS c FROM documents WHERE title IS NOT NULL) GROUP BY 1")
def heading_glyphs(spark, d):
    """Share of capital glyphs in a title."""
    n = F.length(F.regexp_replace("title", r"\P{L}", ""))
    up = F.length(F.regexp_replace("title", r"\P{Lu}", ""))
    return table(spark, d, "documents").where("title is not null").where(n > 0).select("doc_id", F.round(up / n, 6).alias("upper_share"))
