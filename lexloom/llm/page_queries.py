"""Queries on raw pages: p2."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm.markup import page_elements, page_parts, templates
from lexloom.sources.tables import table


def p2_found(spark, d):
    """The marked-up pages and their headings, list items, code blocks and formulas."""
    pages = page_elements(table(spark, d, "fetched_page")).where("fetch_id is not null")
    # the mark of the page stands before its parts, so that every page is parsed once
    mark = F.when(F.col("markup") != "plain", F.array(F.struct(F.lit("markup").alias("kind"), F.lit(0).alias("seq")))).otherwise(F.array().cast("array<struct<kind: string, seq: int>>"))
    parts = F.transform(F.filter("parts", lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["seq"].alias("seq")))
    return pages.select("fetch_id", F.explode(F.concat(mark, parts)).alias("p")).select("fetch_id", "p.kind", "p.seq").distinct()


def p2_text(spark, d):
    """The clean text of every page."""
    return page_parts(table(spark, d, "fetched_page")).select("fetch_id", "markup", "clean")


def p2_templates(spark, d):
    """The template of every host: its classes, the class and gap each is nested in, and in how many pages it is."""
    return templates(table(spark, d, "fetched_page"))


QUERIES = {"p2_found": p2_found, "p2_text": p2_text, "p2_templates": p2_templates}
ORACLE: dict[str, str] = {}
