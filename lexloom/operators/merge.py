"""Keeping tables: upserts, transitions, replacements, folds. Plain Parquet has no MERGE, so each is a rewrite by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in `order` (give a total order)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Old rows replaced by new ones of equal keys; columns in `keep` stay as they were first seen."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keys or c in keep else F.when(F.col(f"n.{keys[0]}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return o.join(n, on, "full").select(*(pick(c).alias(c) for c in old.columns))


def replace_group(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Old rows of every group that `new` has are replaced by the new rows."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def delete_where_in(df: DataFrame, dead: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(dead.select(*keys).distinct(), keys, "left_anti")


def fold(log: DataFrame, key: str, field: str, value: str, order: str) -> DataFrame:
    """(key, field, value): the last value of each field in an append-only log."""
    return log.groupBy(key, field).agg(F.max_by(value, order).alias(value))


def unless_empty(df: DataFrame, by: list[str], alive: Column) -> DataFrame:
    """Rows that are alive; a group without any keeps all its rows."""
    a = df.withColumn("_a", alive.cast("int"))
    return a.withColumn("_m", F.max("_a").over(Window.partitionBy(*by))).where(F.col("_a") == F.col("_m")).drop("_a", "_m")
