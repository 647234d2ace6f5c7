"""Queries on names and rankings: p3, p4 and p5."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm.aggregate import aggregate_ranks
from lexloom.llm.lookalike import consistent_forms, same_look_pairs
from lexloom.llm.names import average_linkage, grams_of, link_names, similar_pairs
from lexloom.session import materialize
from lexloom.sources.tables import table

SCORES = ["keyword", "semantic", "cross", "scope"]


def p3_found(spark, d):
    """Reference rows and targets of one workbook whose names look the same but differ in their characters."""
    return same_look_pairs(table(spark, d, "ref_row"), table(spark, d, "trace_target"), "workbook_id", "ref_id", "law_name", "target_id", "law_label")


def p3_forms(spark, d):
    """Every name with its consistent form."""
    a = table(spark, d, "ref_row").select(F.col("law_name").alias("name"))
    return consistent_forms(a.unionByName(table(spark, d, "trace_target").select(F.col("law_label").alias("name"))), "name")


def p4_ranking(spark, d):
    """Every ranking of laws, all scores counting alike."""
    r = aggregate_ranks(table(spark, d, "doc_rank"), ["run_id", "indicator_id"], "doc_id", SCORES)
    return r.withColumn("rho", F.round("rho", 6))


def p4_found(spark, d):
    """The five laws that stand best in each ranking."""
    return aggregate_ranks(table(spark, d, "doc_rank"), ["run_id", "indicator_id"], "doc_id", SCORES, first=5).where("rho is not null").select("run_id", "indicator_id", "doc_id")


def _mentions(spark, d):
    ref = table(spark, d, "ref_row").select(
        F.lit("ref").alias("source"), F.col("ref_id").alias("row_id"), F.lit(0).alias("pos"), "economy", F.col("law_name").alias("mention"), F.concat_ws(" ", "law_name", "law_number").alias("name")
    )
    label = table(spark, d, "label_row").select(F.lit("label").alias("source"), F.col("label_id").alias("row_id"), F.posexplode("laws").alias("pos", "mention"), "economy")
    return ref.unionByName(label.select("source", "row_id", "pos", "economy", "mention", F.col("mention").alias("name"))).where("mention is not null")


def _catalogue(spark, d):
    law = table(spark, d, "corpus_law")
    aka = F.from_json("catalogue_json", "aka array<string>")["aka"]
    return law.select(F.col("law_id").alias("id"), F.col("economy").alias("scope"), "title", aka.alias("aliases"), F.col("law_number").alias("number"))


def p5_found(spark, d):
    """Mentions of laws as people typed them, linked to the catalogue's law, where they are not its very title."""
    m = _mentions(spark, d)
    links = link_names(m.select(F.col("economy").alias("scope"), "name"), _catalogue(spark, d))
    title = table(spark, d, "corpus_law").select("law_id", "title")
    linked = m.join(links.select(F.col("scope").alias("economy"), "name", F.col("id").alias("law_id")), ["economy", "name"]).join(title, "law_id")
    return linked.where("mention <> title").select("source", "row_id", "pos", "law_id").distinct()


def p5_clusters(spark, d):
    """Spellings that mean no law of the catalogue, grouped by average linkage: (economy, name, cluster)."""
    m = _mentions(spark, d).select(F.col("economy").alias("scope"), "name").where("scope is not null").distinct()
    links = link_names(m, _catalogue(spark, d)).select("scope", "name")
    rest = materialize(m.join(links, ["scope", "name"], "left_anti"), "p5-rest")
    node = F.concat("scope", F.lit(" "), "name")
    grams = grams_of(rest)
    groups = average_linkage(similar_pairs(grams, 0.6), 0.6, grams.select(node.alias("node"), "year"))
    joined = rest.withColumn("node", node).join(groups, "node", "left")
    return joined.select(F.col("scope").alias("economy"), "name", F.coalesce("cluster", "node").alias("cluster"))


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p4_ranking": p4_ranking}
P4_SQL = """
WITH one AS (SELECT run_id, indicator_id, doc_id, max(keyword) AS a, max(semantic) AS b, max("cross") AS c, max(scope) AS d FROM doc_rank GROUP BY 1, 2, 3),
long AS (SELECT run_id, indicator_id, doc_id, unnest([a, b, c, d]) AS v, unnest([0, 1, 2, 3]) AS i FROM one),
r AS (SELECT run_id, indicator_id, doc_id, (rank() OVER (PARTITION BY run_id, indicator_id, i ORDER BY v DESC) + (count(*) OVER (PARTITION BY run_id, indicator_id, i, v) - 1) / 2.0) / count(*) OVER (PARTITION BY run_id, indicator_id, i) AS r FROM long WHERE v IS NOT NULL),
g AS (SELECT run_id, indicator_id, doc_id, list(r) AS h FROM r GROUP BY 1, 2, 3),
f AS (SELECT *, list_sort(list_concat(h, list_transform(range(4 - len(h)), lambda q: list_avg(h)))) AS x FROM g),
p AS (SELECT *, list_sort([round(1 - (1 - x[1]) ** 4, 9), round(6 * x[2] ** 2 * (1 - x[2]) ** 2 + 4 * x[2] ** 3 * (1 - x[2]) + x[2] ** 4, 9), round(4 * x[3] ** 3 * (1 - x[3]) + x[3] ** 4, 9), round(x[4] ** 4, 9)]) AS p FROM f)
SELECT run_id, indicator_id, doc_id FROM p QUALIFY row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY p, doc_id) <= 5
"""

P4_ALL_SQL = P4_SQL.replace(
    "SELECT run_id, indicator_id, doc_id FROM p QUALIFY row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY p, doc_id) <= 5",
    """, e AS (SELECT one.run_id, one.indicator_id, one.doc_id, p.p FROM one LEFT JOIN p ON one.run_id = p.run_id AND one.indicator_id = p.indicator_id AND one.doc_id = p.doc_id)
SELECT run_id, indicator_id, doc_id, round(least(1.0, 4 * p[1]), 6) AS rho, CAST(row_number() OVER (PARTITION BY run_id, indicator_id ORDER BY p NULLS LAST, doc_id) AS INT) AS position FROM e""",
)
ORACLE: dict[str, str] = {"p4_found": P4_SQL, "p4_ranking": P4_ALL_SQL}
