"""Ranks and running totals that survive one group holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.session import materialize


def running_total(df: DataFrame, keys: list[str], order, amount: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows of equal keys that come before a row in `order`, without it.

    `order` is a list of sort expressions without ties. Rows are cut into ranges of (keys, order); each range counts on
    its own and starts where the ranges before it end, so no task ever holds a whole group. The ranges are written to
    the shared folder first: a lost executor can't change them.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_own", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return own.join(starts, [*keys, "_range"]).withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")
