"""Ranking provisions and documents against queries: BM25, vectors, fusion, shortlists.

Queries are few (one for each indicator); documents are many. Term statistics come from one explode and partial sums;
queries meet documents in an equi-join on terms, never pair by pair.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators.ranking import running_total
from lexloom.session import materialize, spread

K1, B = 1.5, 0.75  # fixed values of the ranking function


def term_hits(docs: DataFrame, id_col: str, tokens: Column, terms: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of the documents' tokens that occur in `terms`, written once; and for each document a row whose
    term is empty, so that lengths of documents without a hit are known.

    One narrow pass tokenises the texts; all other tokens drop out before anything is shuffled or written.
    """
    t = spread(docs).select(F.col(id_col), tokens.alias("tokens")).where(F.size("tokens") > 0)
    one = t.select(id_col, F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    kept = one.join(terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct(), "term", "left_semi")
    return materialize(kept.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf")), "hits")


def bm25(hits: DataFrame, id_col: str, queries: DataFrame, query_col: str = "indicator_id") -> DataFrame:
    """(query, id, bm25): sum over query terms, repeats counting, of ln(1 + (N - n + .5) / (n + .5)) · tf(k1 + 1) / (tf + k1(1 - b + b·dl/avgdl)).

    `hits` is as `term_hits` gives it, `queries` has the query, term and qtf.
    """
    stats = hits.where("term = ''").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    found = hits.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("n"))
    n_docs, avgdl = stats.select("n_docs").scalar(), stats.select("avgdl").scalar()
    idf = F.log(1 + (n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return found.join(df, "term").join(queries, "term").groupBy(query_col, id_col).agg(F.sum(part).alias("bm25"))


def max_norm(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Adds for each score its value by the largest of its group (`<score>_norm`); a largest of 0 or less counts as 1.

    The largest values are aggregates that are joined, so no task holds a group.
    """
    top = scores.groupBy(*(F.col(k).alias(f"_by_{k}") for k in by)).agg(*(F.max(c).alias(f"_{c}") for c in columns))
    joined = scores.join(top, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by)))
    norm = {f"{c}_norm": F.col(c) / F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return joined.withColumns(norm).drop(*(f"_{c}" for c in columns), *(f"_by_{k}" for k in by))


def places(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Adds `name`: the place of a row in its group, from 1, in an order without ties, for groups of any size."""
    return running_total(df.withColumn("_one", F.lit(1)), by, order, "_one", name).withColumn(name, F.col(name) + 1).drop("_one")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(rows: DataFrame, queries: DataFrame, k: int, row_block: int = 4096, query_block: int = 512) -> DataFrame:
    """(qid, vec_id, dense): for each of `queries` the `k` rows of the highest (cosine + 1) / 2, rounded to 7 places, itself aside, ties to the smaller id.

    Both have vec_id and embedding. They are dealt into blocks by their ids' hash, and each block of rows meets each
    block of queries in one task, which keeps its `k` best a query: what a task holds does not grow with the data.
    A null vector, or one without a length, has no cosine.
    """
    def blocks(df: DataFrame, size: int, ident: str, vector: str, block: str) -> tuple[DataFrame, int]:
        df = df.where("vec_id is not null and embedding is not null")
        n = max(1, -(-df.count() // size))
        return df.select(F.col("vec_id").alias(ident), F.col("embedding").alias(vector), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(block)), n

    (a, na), (b, nb) = blocks(rows, row_block, "vec_id", "m", "rb"), blocks(queries, query_block, "qid", "v", "qb2")
    a = a.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    b = b.withColumn("rb2", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            m, v = (np.array(c.tolist(), dtype="float64") for c in (x["m"], q["v"]))
            ids = x["vec_id"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (v @ m.T / np.sqrt(np.outer((v * v).sum(1), (m * m).sum(1))) + 1) / 2
            for qid, row in zip(q["qid"], s):
                use = np.flatnonzero((ids != qid) & np.isfinite(row))
                for i in use[np.lexsort((ids[use], -np.round(row[use], 7)))[:k]]:
                    out.append((qid, ids[i], row[i]))
        return pd.DataFrame(out, columns=["qid", "vec_id", "dense"])

    part = a.groupBy("rb", "qb").cogroup(b.groupBy("rb2", "qb2")).applyInPandas(best, "qid long, vec_id long, dense double")
    return top_k(part, ["qid"], [F.desc(F.round("dense", 7)), "vec_id"], k)


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first `k` rows of each group; plans as a group limit before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def rrf(df: DataFrame, by: list[str], item: str, signals: list[str], k: int = 60) -> DataFrame:
    """(by, item, rrf): sum over signals of 1 / (k + place), places from 1, higher values first, ties by item. A null value has no place."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals))).alias("x")
    long = df.select(*by, item, each).select(*by, item, "x.signal", "x.value").where("value is not null")
    placed = places(long, [*by, "signal"], [F.desc("value"), F.col(item)], "place")
    return placed.groupBy(*by, item).agg(F.sum(1 / (k + F.col("place"))).alias("rrf"))


def diverse(df: DataFrame, by: str, law: str, item: str, score: str, k: int, per_law: int) -> DataFrame:
    """(…, rank): first the `per_law` best of every law by rank in law and score, then the best of the rest, `k` in all.

    Both are limits by group that cut before the shuffle; the rest are what is not among the first.
    """
    order = [F.desc(score), F.col(item)]
    first = top_k(df, [by, law], order, per_law).withColumnRenamed("rank", "in_law")
    rest = top_k(df.join(first.select(by, law, item), [by, law, item], "left_anti"), [by], order, k).drop("rank").withColumn("in_law", F.lit(per_law + 1))
    return top_k(first.unionByName(rest), [by], [F.col("in_law"), *order], k)


def round_robin(df: DataFrame, bucket: str, order: list, item: str) -> DataFrame:
    """(item, turn, bucket): the buckets' lists interleaved, an item where it comes first."""
    turn = places(df, [bucket], order, "turn")
    return turn.groupBy(item).agg(F.min(F.struct("turn", bucket)).alias("m")).select(item, "m.turn", f"m.{bucket}")
