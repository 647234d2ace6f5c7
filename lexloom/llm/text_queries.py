"""Queries on the shape of texts: p6, p7 and p10."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm.scans import line_findings, paragraphs
from lexloom.llm.spam import shape_groups, shape_pages, spam_pages
from lexloom.llm.splitting import split_oversized
from lexloom.sources.tables import table


def _oversized(spark, d):
    bodies = split_oversized(table(spark, d, "body_file"), "body_path", "body").select(F.lit("body").alias("source"), F.col("body_path").alias("item_id"), "forced", "pieces")
    own = table(spark, d, "provisions").select("provision_id", "prov_json").where(F.length("prov_json") > 3000).distinct()
    prov = split_oversized(own, "provision_id", "prov_json", json_field="verbatim_snippet")
    return bodies.unionByName(prov.select(F.lit("provision").alias("source"), F.col("provision_id").alias("item_id"), "forced", "pieces"))


def p6_found(spark, d):
    """The oversized items, and whether one has to be cut where there is no natural boundary."""
    return _oversized(spark, d).where("size(pieces) > 1 and item_id is not null").groupBy("source", "item_id").agg(F.max("forced").alias("forced"))


def p6_pieces(spark, d):
    """The pieces of every oversized item."""
    return _oversized(spark, d).select("source", "item_id", F.explode("pieces").alias("p")).select("source", "item_id", "p.*").distinct()


def p6_whole(spark, d):
    """Every oversized item put together again from its pieces: its length, a digest, the longest piece, and whether each piece begins with the last 200 characters before it."""
    p = _oversized(spark, d).where("item_id is not null")
    new = F.array_join(F.transform("pieces", lambda x: F.substring(x["text"], x["new_from"] - x["start"] + 1, F.lit(1 << 30))), "")
    longest = F.array_max(F.transform("pieces", lambda x: F.length(x["text"])))
    overlaps = F.forall("pieces", lambda x: x["start"] == F.greatest(F.lit(0), x["new_from"] - 200))
    return p.select("source", "item_id", F.length(new).alias("chars"), F.md5(new).alias("text_md5"), (longest <= 3000).alias("fits"), overlaps.alias("overlaps")).distinct()


def p7_found(spark, d):
    """Noisy lines of scanned texts by kind."""
    return line_findings(table(spark, d, "ocr_result"), "ocr_id")


def p7_paragraphs(spark, d):
    """The repaired text of every scan."""
    return paragraphs(table(spark, d, "ocr_result"), "ocr_id")


def p10_found(spark, d):
    """Documents that are for the greater part keyword spam, link lists or product tags."""
    return spam_pages(table(spark, d, "documents"), "doc_id", "text").select("doc_id").where("doc_id is not null").distinct()


def p10_shapes(spark, d):
    """The shapes of the corpus: how many pages, segments and characters have each, and the company each keeps."""
    return shape_groups(shape_pages(table(spark, d, "documents"), "doc_id", "text"))


QUERIES = {"p7_found": p7_found, "p7_paragraphs": p7_paragraphs, "p6_found": p6_found, "p6_pieces": p6_pieces, "p6_whole": p6_whole, "p10_found": p10_found, "p10_shapes": p10_shapes}
P6_ITEMS = r"""
WITH j AS (SELECT DISTINCT provision_id, prov_json FROM provisions WHERE prov_json IS NOT NULL AND json_valid(prov_json)),
o AS (SELECT provision_id, CASE json_type(prov_json) WHEN 'OBJECT' THEN prov_json WHEN 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(prov_json, '$')) THEN json_extract_string(prov_json, '$') END END AS rec FROM j),
t AS (SELECT 'body' AS source, body_path AS item_id, body AS text FROM body_file UNION ALL SELECT 'provision', provision_id, json_extract_string(rec, '$.verbatim_snippet') FROM o WHERE rec IS NOT NULL AND provision_id IS NOT NULL)"""
P6_SQL = P6_ITEMS + r"""
SELECT source, item_id, CAST(max(CASE WHEN list_max(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\v\f\x{85}\x{2028}\x{2029}]|[.!?]+\s|[。！？]+'), lambda s: length(s))) > 3000 THEN 1 ELSE 0 END) AS INT) AS forced FROM t WHERE length(text) > 3000 GROUP BY 1, 2
"""

P6_WHOLE_SQL = P6_ITEMS + " SELECT DISTINCT source, item_id, length(text) AS chars, md5(text) AS text_md5, true AS fits, true AS overlaps FROM t WHERE length(text) > 3000 AND item_id IS NOT NULL"

ORACLE: dict[str, str] = {"p6_found": P6_SQL, "p6_whole": P6_WHOLE_SQL}
