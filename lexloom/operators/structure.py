"""Documents as lines and provisions: boundaries, running heads, contents, fills. All by windows within a document.

Every function takes lines (doc_id, line_no, line) and partitions by document; a document's lines are the unit of
work. One exchange by doc_id serves all windows of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: A line that opens a provision, in the drafting conventions of the corpus. Java and RE2 read it alike.
BOUNDARY = r"^\s*(?:Section [0-9]+[A-Z]?\.?|PART [0-9]+|Pasal [0-9]+|BAB [0-9]+|Điều [0-9]+|Chương [0-9]+|Статья [0-9]+|Глава [0-9]+|第\s*[0-9一二三四五六七八九十百千零〇两]+\s*条|[0-9]{1,3}\s*(?:д[үу]г[эа]{0,2}р|дэх|дахь)\s+з[үу]йл|[0-9]{1,3}[.\t ] ?\S|Q[0-9]+:)"


def in_document() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 1, line, start): the lines of each text and where they start. Null texts have none."""
    split = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("i", "line"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(in_document().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return split.select("doc_id", (F.col("i") + 1).alias("line_no"), "line").withColumn("start", start)


def provisions(ln: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, segment, label, text): what lies from one boundary line to the next; segment 0 is what comes first.

    Segments shorter than `least` characters are dropped; a document without any boundary is one segment.
    """
    marked = ln.withColumn("open", F.col("line").rlike(BOUNDARY).cast("int"))
    seg = marked.withColumn("segment", F.sum("open").over(in_document().rowsBetween(Window.unboundedPreceding, 0)))
    whole = seg.groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"), F.min_by(F.when(F.col("open") == 1, F.trim("line")), "line_no").alias("label"))
    return whole.where(F.length(F.trim("text")) >= least).select("doc_id", "segment", "label", "text")


def strip_running_heads(ln: DataFrame, longest: int = 80, often: int = 4) -> DataFrame:
    """Lines without the later occurrences of those of at most `longest` characters that occur `often` times or more."""
    same = Window.partitionBy("doc_id", "line")
    n = ln.withColumn("n", F.count("*").over(same)).withColumn("k", F.row_number().over(same.orderBy("line_no")))
    return n.where((F.trim("line") == "") | (F.length("line") > longest) | (F.col("n") < often) | (F.col("k") == 1)).drop("n", "k")


def page_bands(pages: DataFrame, top: int = 2, bottom: int = 3, least: int = 3, share: float = 0.25) -> DataFrame:
    """(doc_id, masked, pages): lines, digits masked, that recur among the first or last of their pages.

    `pages` has doc_id, page and text. Documents of fewer than three pages have none; a line must recur on
    max(`least`, `share` of the pages).
    """
    ln = pages.where("text is not null").select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    w = Window.partitionBy("doc_id", "page")
    band = ln.withColumn("a", F.row_number().over(w.orderBy("i"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("i")))).where((F.col("a") <= top) | (F.col("b") <= bottom))
    masked = band.select("doc_id", "page", F.regexp_replace(F.trim("line"), "[0-9]+", "#").alias("masked")).distinct()
    size = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("all")).where("all >= 3")
    return masked.groupBy("doc_id", "masked").agg(F.count("*").alias("pages")).join(size, "doc_id").where(F.col("pages") >= F.greatest(F.lit(float(least)), F.col("all") * share)).select("doc_id", "masked", "pages")


def trim_trailing(ln: DataFrame, furniture: str) -> DataFrame:
    """Lines up to the last one that is neither blank nor furniture."""
    last = F.max(F.when(F.col("line").rlike(r"[^\s\p{Z}]") & ~F.col("line").rlike(furniture), F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return ln.withColumn("last", last).where(F.col("line_no") <= F.col("last")).drop("last")


def fill_forward(ln: DataFrame, pattern: str, name: str) -> DataFrame:
    """Adds the last line at or above that matches `pattern`."""
    return ln.withColumn(name, F.last(F.when(F.col("line").rlike(pattern), F.trim("line")), ignorenulls=True).over(in_document().rowsBetween(Window.unboundedPreceding, 0)))


def asof(events: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Events with the `value` of the last mark of their key at or before them, by one union and one window."""
    both = events.withColumn("_mark", F.lit(0)).withColumn("_v", F.lit(None).cast(marks.schema[value].dataType))
    other = marks.select(F.col(key), F.col(at), F.col(value).alias("_v")).withColumn("_mark", F.lit(-1))
    all_ = both.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    return all_.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_mark = 0").drop("_mark", "_v")
