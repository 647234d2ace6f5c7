"""One ranking from several scores of different scales: robust rank aggregation."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators.ranking import running_total


def order_statistics(ranks: Column, m: int) -> Column:
    """For sorted normalised ranks r1 <= ... <= rm, the probabilities that the k-th of m uniform numbers is at most rk.

    That is the beta distribution (k, m - k + 1), here as its binomial sum.
    """
    out = []
    for k in range(1, m + 1):
        r = ranks[k - 1]
        out.append(sum((comb(m, j) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(k, m + 1)), F.lit(0.0)))
    return F.array(*out)


def aggregate_ranks(df: DataFrame, keys: list[str], item: str, scores: list[str], first: int | None = None) -> DataFrame:
    """(keys, item, rho, position): the items of each ranking by the significance of their places, best first.

    Each score counts by its place alone: the normalised rank of a value is the middle of the places that equal values
    share, divided by the number of values, higher values first. A null score says nothing: its place is taken as the
    mean of the item's other places, so that it neither helps nor harms. rho is the smallest order-statistic
    probability times the number of scores, at most 1. Items of equal rho are ordered by the next smallest
    probability, and so on, then by item. Exact duplicate rows count once; of several rows of one item, the largest
    value of each score counts. NaN is null. Items without any score have rho null and stand last; rows with a null
    item or key are kept as a group of their own. An empty table gives an empty ranking.

    Equal values are counted before ranking, and ranks come from running totals over ranges, so a ranking may hold
    any share of all rows. So does the last numbering; with `first` only so many items of each ranking are given, which
    are cut before the shuffle.
    """
    value = lambda s: F.when(~F.isnan(F.col(f"`{s}`").cast("double")), F.col(f"`{s}`").cast("double"))
    one = df.groupBy(*keys, item).agg(*(F.max(value(s)).alias(f"_s{i}") for i, s in enumerate(scores)))
    named = one.withColumn("_g", F.to_json(F.struct(*keys))).withColumnRenamed(item, "_item")
    by = ["_g", "_score"]
    each = F.array(*(F.struct(F.lit(i).alias("_score"), F.col(f"_s{i}").alias("_v")) for i in range(len(scores))))
    long = named.select("_g", "_item", F.explode(each).alias("_x")).select("_g", "_item", "_x.*").where("_v is not null")
    values = long.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    sized = values.join(values.groupBy(*by).agg(F.sum("_n").alias("_all")), by)
    placed = running_total(sized, by, [F.desc("_v")], "_n", "_above").withColumn("_r", (F.col("_above") + (F.col("_n") + 1) / 2) / F.col("_all"))
    ranks = long.join(placed.select(*by, "_v", "_r"), [*by, "_v"]).groupBy("_g", "_item").agg(F.collect_list("_r").alias("_have"))
    m = len(scores)
    mean = F.aggregate("_have", F.lit(0.0), lambda a, x: a + x) / F.size("_have")
    full = F.sort_array(F.concat("_have", F.array_repeat(mean, m - F.size("_have"))))
    scored = ranks.withColumn("_full", full).withColumn("_p", F.sort_array(F.transform(order_statistics(F.col("_full"), m), lambda p: F.round(p, 9))))
    rho = F.least(F.lit(1.0), m * F.col("_p")[0])
    flat = named.alias("e").join(scored.alias("s"), (F.col("e._g") == F.col("s._g")) & F.col("e._item").eqNullSafe(F.col("s._item")), "left").select(*(f"e.`{k}`" for k in keys), "e._g", "e._item", "s._p")
    order = [F.asc_nulls_last("_p"), F.asc_nulls_last("_item")]
    if first is not None:
        placed = flat.withColumn("position", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).where(F.col("position") <= first)
    else:
        placed = running_total(flat.withColumn("_one", F.lit(1)), ["_g"], order, "_one", "_before").withColumn("position", (F.col("_before") + 1).cast("int"))
    return placed.select(*keys, F.col("_item").alias(item), F.when(F.col("_p").isNotNull(), rho).alias("rho"), "position")
