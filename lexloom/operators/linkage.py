"""Record linkage: names by shared words, citations by shared numbers, addresses; always by equi-joins on parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, lid: str, rid: str, words: str, least: float, by: str = "shorter") -> DataFrame:
    """(key, lid, rid, shared, overlap): pairs of one key that share words for at least `least` of the shorter, longer, left or right side.

    Exact, without joining on every common word: a side that has to share k of its n words shares one of its n - k + 1
    rarest, so only these are joined with the other side's words (with its rarest where both sides are bound). `words`
    are arrays of distinct strings; ids are unique within a side.
    """
    a = left.select(key, lid, F.col(words).alias("wa")).where(F.size("wa") > 0)
    b = right.select(key, rid, F.col(words).alias("wb")).where(F.size("wb") > 0)
    each_a, each_b = a.select(key, lid, F.size("wa").alias("n"), F.explode("wa").alias("w")), b.select(key, rid, F.size("wb").alias("n"), F.explode("wb").alias("w"))
    often = each_a.select(key, "w").union(each_b.select(key, "w")).groupBy(key, "w").agg(F.count("*").alias("df"))

    def rarest(each: DataFrame, ident: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key, ident).orderBy("df", "w"))
        return each.join(often, [key, "w"]).withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(key, ident, "w")

    all_a, all_b = each_a.select(key, lid, "w"), each_b.select(key, rid, "w")
    sides = {"left": [(True, False)], "right": [(False, True)], "longer": [(True, True)], "shorter": [(True, False), (False, True)]}[by]
    met = None
    for of_a, of_b in sides:
        one = (rarest(each_a, lid) if of_a else all_a).join(rarest(each_b, rid) if of_b else all_b, [key, "w"]).select(key, lid, rid)
        met = one if met is None else met.union(one)
    pairs = met.distinct().join(a, [key, lid]).join(b, [key, rid]).withColumn("shared", F.size(F.array_intersect("wa", "wb")).cast("long"))
    na, nb = F.size("wa"), F.size("wb")
    base = {"shorter": F.least(na, nb), "longer": F.greatest(na, nb), "left": na, "right": nb}[by]
    return pairs.withColumn("overlap", F.col("shared") / base).where(F.col("overlap") >= least).drop("wa", "wb")


def best_link(pairs: DataFrame, lid: str, rid: str, score: Column, margin: float) -> DataFrame:
    """(lid, rid, score): the best partner of each left row, if it leads the second by at least `margin`."""
    w = Window.partitionBy(lid).orderBy(F.desc("score"), rid)
    r = pairs.withColumn("score", F.round(score, 9)).withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return r.where((F.col("k") == 1) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))).select(lid, rid, "score")
