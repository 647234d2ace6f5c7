"""Queries on documents as lines, pages and provisions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators import structure as S
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


LINES = """ln AS (SELECT doc_id, line, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL))"""


@query(rf"WITH {LINES} SELECT doc_id, line_no, CAST(start AS BIGINT) AS start FROM ln WHERE regexp_matches(line, '{S.BOUNDARY}')")
def boundary_detection(spark, d):
    """Where provisions begin: line number and offset in characters."""
    return _lines(spark, d).where(F.col("line").rlike(S.BOUNDARY)).select("doc_id", "line_no", "start")


@query(
    rf"""WITH {LINES}, m AS (SELECT *, CAST(regexp_matches(line, '{S.BOUNDARY}') AS INT) AS open FROM ln), s AS (SELECT *, sum(open) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM m)
    SELECT doc_id, CAST(segment AS BIGINT) AS segment, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5, arg_min_null(CASE WHEN open = 1 THEN trim(line) END, line_no) AS label FROM s GROUP BY 1, 2 HAVING length(trim(string_agg(line, chr(10) ORDER BY line_no))) >= 20"""
)
def provision_split(spark, d):
    return S.provisions(_lines(spark, d)).select("doc_id", "segment", F.md5("text").alias("text_md5"), "label")


@query(
    rf"""WITH {LINES}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS k FROM ln)
    SELECT doc_id, count(*) AS kept FROM n WHERE trim(line) = '' OR length(line) > 80 OR n < 4 OR k = 1 GROUP BY 1"""
)
def running_header_strip(spark, d):
    return S.strip_running_heads(_lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("kept"))


PAGES = "pg AS (SELECT ocr_id AS doc_id, p.page AS page, p.text AS text, p.confidence AS confidence FROM (SELECT ocr_id, unnest(pages) AS p FROM ocr_result))"


def _pages(spark, d):
    o = table(spark, d, "ocr_result").select(F.col("ocr_id").alias("doc_id"), F.explode("pages").alias("p"))
    return o.select("doc_id", "p.page", "p.text", "p.confidence")


@query(
    rf"""WITH {PAGES}, ln AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pg WHERE text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) AS b FROM ln WHERE trim(line) <> ''),
    m AS (SELECT DISTINCT doc_id, page, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS masked FROM r WHERE a <= 2 OR b <= 3), z AS (SELECT doc_id, count(DISTINCT page) AS n FROM pg GROUP BY 1 HAVING count(DISTINCT page) >= 3)
    SELECT doc_id, masked, count(*) AS pages FROM m JOIN z USING (doc_id) GROUP BY doc_id, masked, n HAVING count(*) >= greatest(3, 0.25 * n)"""
)
def page_band_chrome(spark, d):
    return S.page_bands(_pages(spark, d))


@query(
    r"""SELECT doc_id, md5(CASE WHEN p > 0 AND p < length(text) THEN substring(text, p) ELSE text END) AS text_md5 FROM (SELECT doc_id, text, coalesce(least(nullif(strpos(text, 'Section 1.'), 0), nullif(strpos(text, 'PART 1 -'), 0), nullif(strpos(text, '1. '), 0)), 0) AS p FROM documents WHERE text IS NOT NULL)"""
)
def toc_strip(spark, d):
    """Texts from the earliest of three anchors of the first provision on."""
    at = F.coalesce(F.least(*(F.nullif(F.locate(a, F.col("text")), F.lit(0)) for a in ("Section 1.", "PART 1 -", "1. "))), F.lit(0))
    doc = table(spark, d, "documents").where("text is not null").select("doc_id", "text", at.alias("p"))
    return doc.select("doc_id", F.md5(F.when((F.col("p") > 0) & (F.col("p") < F.length("text")), F.substring(F.col("text"), F.col("p"), F.length("text"))).otherwise(F.col("text"))).alias("text_md5"))


FURNITURE = r"^\s*(?:Page [0-9]+|- [0-9]+ -|\[[0-9]+\]|[0-9]+|tag: [^\n]*|#\S*)\s*$"


@query(rf"WITH {LINES}, l AS (SELECT *, max(CASE WHEN regexp_matches(line, '[^\s\p{{Z}}]') AND NOT regexp_matches(line, '{FURNITURE}') THEN line_no END) OVER (PARTITION BY doc_id) AS last FROM ln) SELECT doc_id, count(*) AS kept FROM l WHERE line_no <= last GROUP BY 1")
def trailing_trim(spark, d):
    return S.trim_trailing(_lines(spark, d), FURNITURE).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(
    rf"""WITH {LINES} SELECT doc_id, part, count(*) AS n FROM (SELECT doc_id, last_value(CASE WHEN regexp_matches(line, '^(?:PART|BAB|Chương|Глава) [0-9]+') THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM ln) WHERE part IS NOT NULL GROUP BY 1, 2"""
)
def forward_fill_section(spark, d):
    f = S.fill_forward(_lines(spark, d), r"^(?:PART|BAB|Chương|Глава) [0-9]+", "part")
    return f.where("part is not null").groupBy("doc_id", "part").agg(F.count("*").alias("n"))


@query(
    rf"""WITH {LINES}, b AS (SELECT doc_id, line_no, trim(line) AS mark, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM ln WHERE regexp_matches(line, '{S.BOUNDARY}')),
    t AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
    SELECT l.doc_id, l.line_no, CAST(l.start AS BIGINT) AS start, CAST(coalesce(lead(l.start) OVER (PARTITION BY l.doc_id ORDER BY l.line_no), t.n) AS BIGINT) AS "end" FROM (SELECT ln.* FROM ln JOIN b USING (doc_id, line_no)) l JOIN t ON t.doc_id = l.doc_id"""
)
def next_boundary(spark, d):
    """Spans of provisions: a provision ends where the next begins, or with its text."""
    b = _lines(spark, d).where(F.col("line").rlike(S.BOUNDARY))
    n = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"))
    return b.join(n, "doc_id").select("doc_id", "line_no", "start", F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("line_no")), F.col("n")).cast("long").alias("end"))


@query(
    rf"""WITH {LINES}, h AS (SELECT doc_id, line_no, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY line_no) AS above, line FROM ln)
    SELECT doc_id, line_no, above FROM h WHERE regexp_matches(line, '{S.BOUNDARY}') AND above <> '' AND length(above) <= 60 AND NOT regexp_matches(above, '[.;:,]$')"""
)
def heading_lookback(spark, d):
    """Marginal headings: a short line without end mark right above a boundary."""
    h = _lines(spark, d).withColumn("above", F.lag(F.trim("line")).over(S.in_document()))
    return h.where(F.col("line").rlike(S.BOUNDARY) & (F.col("above") != "") & (F.length("above") <= 60) & ~F.col("above").rlike("[.;:,]$")).select("doc_id", "line_no", "above")


@query(
    """WITH s AS (SELECT DISTINCT doc_id, provision_id, TRY_CAST(regexp_extract(article_section, '([0-9]+)', 1) AS INT) AS n, TRY_CAST(regexp_extract(provision_id, '#p([0-9]+)$', 1) AS INT) AS k FROM provisions WHERE regexp_matches(article_section, '[0-9]') AND provision_id IS NOT NULL),
    l AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY k, n) AS before FROM s WHERE k IS NOT NULL)
    SELECT doc_id, count(*) AS sections, count(*) FILTER (WHERE n < before - 5) AS jumps, count(*) FILTER (WHERE n < before - 5) > greatest(3, 0.05 * count(*)) AS flagged FROM l GROUP BY 1 HAVING count(*) >= 20"""
)
def section_sequence_audit(spark, d):
    """Documents whose section numbers jump back: more than max(3, 5 in 100) of at least 20."""
    p = table(spark, d, "provisions").where(F.col("article_section").rlike("[0-9]") & F.col("provision_id").isNotNull())
    s = p.select("doc_id", "provision_id", F.regexp_extract("article_section", "([0-9]+)", 1).try_cast("int").alias("n"), F.regexp_extract("provision_id", "#p([0-9]+)$", 1).try_cast("int").alias("k")).distinct().where("k is not null")
    back = F.col("n") < F.lag("n").over(Window.partitionBy("doc_id").orderBy("k", "n")) - 5
    g = s.withColumn("back", back).groupBy("doc_id").agg(F.count("*").alias("sections"), F.count_if("back").alias("jumps")).where("sections >= 20")
    return g.select("doc_id", "sections", "jumps", (F.col("jumps") > F.greatest(F.lit(3.0), F.col("sections") * 0.05)).alias("flagged"))


@query(
    """WITH u AS (SELECT DISTINCT doc_id, provision_id, article_section FROM provisions WHERE article_section IS NOT NULL AND provision_id IS NOT NULL), g AS (SELECT doc_id, article_section, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT doc_id, count(*) AS labels, CAST(sum(n) AS BIGINT) AS provisions FROM g GROUP BY 1"""
)
def duplicate_labels(spark, d):
    """Labels that several provisions of a document carry."""
    u = table(spark, d, "provisions").where("article_section is not null and provision_id is not null").select("doc_id", "provision_id", "article_section").distinct()
    g = u.groupBy("doc_id", "article_section").count().where("count > 1")
    return g.groupBy("doc_id").agg(F.count("*").alias("labels"), F.sum("count").alias("provisions"))


@query(
    """WITH v AS (SELECT law_id, max(chars) AS chars, max(bytes) AS bytes FROM corpus_version WHERE chars IS NOT NULL AND bytes > 0 GROUP BY 1), r AS (SELECT l.economy, v.chars / v.bytes AS ratio FROM v JOIN corpus_law l USING (law_id))
    SELECT economy, count(*) AS laws, round(median(ratio), 6) AS median_ratio, count(*) FILTER (WHERE ratio < 0.6) AS low FROM r GROUP BY 1"""
)
def text_coverage(spark, d):
    """Characters kept by bytes fetched, by economy: median and laws below 0.6."""
    v = table(spark, d, "corpus_version").where("chars is not null and bytes > 0").groupBy("law_id").agg(F.max("chars").alias("c"), F.max("bytes").alias("b"))
    r = v.join(table(spark, d, "corpus_law").select("law_id", "economy"), "law_id").withColumn("ratio", F.col("c") / F.col("b"))
    return r.groupBy("economy").agg(F.count("*").alias("laws"), F.round(F.percentile("ratio", F.lit(0.5)), 6).alias("median_ratio"), F.count_if(F.col("ratio") < 0.6).alias("low"))


@query(
    """WITH m AS (SELECT law_id, landed_at, write_seq AS last_write FROM corpus_version WHERE state = 'fetched' QUALIFY row_number() OVER (PARTITION BY law_id, landed_at ORDER BY write_seq DESC) = 1), e AS (SELECT DISTINCT law_id, version_id, write_seq, landed_at FROM corpus_version WHERE state = 'split')
    SELECT e.law_id, e.version_id, e.write_seq, m.last_write FROM e ASOF LEFT JOIN m ON e.law_id = m.law_id AND e.landed_at >= m.landed_at"""
)
def location_asof(spark, d):
    """Each split write with the last fetch of its law that had landed by then."""
    v = table(spark, d, "corpus_version").select("law_id", "version_id", "write_seq", "state", "landed_at")
    marks = v.where("state = 'fetched'").groupBy("law_id", "landed_at").agg(F.max("write_seq").alias("last_write"))
    return S.asof(v.where("state = 'split'").drop("state").distinct(), marks, "law_id", "landed_at", "last_write").select("law_id", "version_id", "write_seq", "last_write")


@query(rf"WITH {PAGES} SELECT doc_id, count(*) AS pages, md5(string_agg(chr(12) || page || chr(12) || chr(10) || coalesce(text, ''), '' ORDER BY page, text)) AS joined_md5 FROM pg GROUP BY 1")
def page_join(spark, d):
    """Pages as one text, each after its mark."""
    p = _pages(spark, d)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda s: F.concat(F.lit("\f"), s["page"].cast("string"), F.lit("\f\n"), s["t"])), "")
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.md5(whole).alias("joined_md5"))


@query(
    rf"""WITH {PAGES}, g AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) < 40) AS thin, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence < 0.6) AS low FROM pg GROUP BY 1)
    SELECT *, CASE WHEN thin = 0 THEN 'text' WHEN thin = pages THEN 'scanned' ELSE 'mixed' END AS kind FROM g"""
)
def page_triage(spark, d):
    """Pages too thin for text, kind of document, mean confidence and pages of low confidence."""
    g = _pages(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) < 40).alias("thin"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(F.col("confidence") < 0.6).alias("low")
    )
    return g.withColumn("kind", F.when(F.col("thin") == 0, "text").when(F.col("thin") == F.col("pages"), "scanned").otherwise("mixed"))


@query(
    rf"""WITH {PAGES}, a AS (SELECT doc_id, page, text FROM pg WHERE length(trim(coalesce(text, ''))) >= 40), o AS (SELECT doc_id, page, 'ocr:' || page AS text FROM pg WHERE confidence < 0.85)
    SELECT coalesce(a.doc_id, o.doc_id) AS doc_id, coalesce(a.page, o.page) AS page, md5(coalesce(o.text, a.text)) AS text_md5 FROM a FULL JOIN o ON a.doc_id = o.doc_id AND a.page = o.page"""
)
def hybrid_splice(spark, d):
    """Read pages spliced into text pages: a page read anew goes before its text layer."""
    p = _pages(spark, d)
    a = p.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 40).select("doc_id", "page", F.col("text").alias("layer"))
    o = p.where("confidence < 0.85").select("doc_id", "page", F.concat(F.lit("ocr:"), F.col("page").cast("string")).alias("read"))
    return a.join(o, ["doc_id", "page"], "full").select("doc_id", "page", F.md5(F.coalesce("read", "layer")).alias("text_md5"))


@query(
    r"""SELECT source, lang_, count(*) AS docs, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT source, CASE lower(substring(coalesce(lang, ''), 1, 2)) WHEN 'in' THEN 'id' WHEN 'vi' THEN 'vi' ELSE lower(substring(coalesce(lang, ''), 1, 2)) END AS lang_, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2"""
)
def lines_by_source(spark, d):
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2))
    t = table(spark, d, "documents").where("text is not null").select("source", F.when(lang == "in", "id").otherwise(lang).alias("lang_"), F.size(F.split("text", "\n")).alias("n"))
    return t.groupBy("source", "lang_").agg(F.count("*").alias("docs"), F.sum("n").alias("lines"))
