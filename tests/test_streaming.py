"""Streams in several batches give what batch queries give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexloom.streaming import events as E


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rnd = random.Random(3)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=40 * i + rnd.randint(0, 30)), rnd.randint(1, 4), rnd.choice(["view", "click", "purchase"]), float(rnd.randint(1, 9)), "{}") for i in range(600)]
    root = tmp_path_factory.mktemp("ev")
    for b in range(3):
        spark.createDataFrame(rows[b * 200 : (b + 1) * 200], E.SCHEMA).coalesce(1).write.parquet(f"{root}/{b}/events.parquet")
    return rows, root


def stream(spark, root):
    return spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/*/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_usage(spark, data):
    rows, root = data
    got = E.collect_stream(E.usage_by_hour(stream(spark, root)), "complete")
    assert got.agg(F.sum("n"), F.sum("total")).collect()[0] == (600, sum(r[4] for r in rows))


def test_breaker_over_batches(spark, data):
    rows, root = data
    last = {}
    for r in E.collect_stream(E.breaker(stream(spark, root), "purchase"), "update").collect():
        last[r["user_id"]] = max(last.get(r["user_id"], 0), r["longest"])
    want = {}
    for u in {r[2] for r in rows}:
        run = best = 0
        for r in sorted((r for r in rows if r[2] == u), key=lambda r: (r[1], r[0])):
            run = 0 if r[3] == "purchase" else run + 1
            best = max(best, run)
        want[u] = best
    assert last == want


def test_waits_keep_the_gap(spark, data):
    rows, root = data
    got = {r["event_id"]: r["wait"] for r in E.collect_stream(E.earliest_starts(stream(spark, root), 60)).collect()}
    for u in {r[2] for r in rows}:
        starts = [(r[1] - dt.datetime(2024, 1, 1)).total_seconds() + got[r[0]] for r in sorted((r for r in rows if r[2] == u), key=lambda r: (r[1], r[0]))]
        assert all(b - a > 59.99 for a, b in zip(starts, starts[1:]))


def test_dedup_and_empty(spark, data, tmp_path):
    _, root = data
    assert E.collect_stream(E.first_within(stream(spark, root), ["user_id"], "2 days")).count() == 4
    spark.createDataFrame([], E.SCHEMA).write.parquet(f"{tmp_path}/0/events.parquet")
    assert E.collect_stream(E.usage_by_hour(stream(spark, tmp_path)), "complete").count() == 0
