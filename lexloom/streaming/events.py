"""Structured Streaming forms of the incremental behaviours, over the stream of events.

Each function takes a stream (event_id, ts TIMESTAMP, user_id, event_type, value) and gives a stream; `collect_stream`
runs one to its present end and gives what it wrote. State is bounded by watermarks; that of keys is dropped when nothing
of theirs came for a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.session import shared_dir

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    s = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def arrivals(events: DataFrame, batches: int, late_share: int = 10, late_hours: int = 6) -> DataFrame:
    """Events of a table with the batch (from 0) they arrive in: by their time, cut into equal stretches, but one in
    `late_share`, by its id, comes `late_hours` later."""
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    came = ts + F.when(F.pmod("event_id", F.lit(late_share)) == 0, late_hours * 3600).otherwise(0)
    span = events.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    step = F.ceil((span.select("b").scalar() + late_hours * 3600 + 1 - span.select("a").scalar()) / batches)
    return events.withColumn("batch", F.floor((came - span.select("a").scalar()) / step).cast("int"))


def arriving(spark: SparkSession, sf_dir: str, batches: int = 6, late_hours: int = 6) -> DataFrame:
    """The table of events as a stream of `batches` batches in order of arrival, late ones among them."""
    root = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex[:12]}"
    every = arrivals(spark.read.schema(SCHEMA).parquet(f"{sf_dir}/events.parquet"), batches, late_hours=late_hours)
    for b in range(batches):  # one file each, written in turn: the source takes the oldest first
        every.where(F.col("batch") == b).drop("batch").coalesce(1).write.parquet(f"{root}/batch={b}")
    s = spark.readStream.schema(SCHEMA + ", batch int").option("maxFilesPerTrigger", 1).parquet(root)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def collect_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote. In mode complete the last batch replaces the others."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    out, schema = f"{root}/out", stream.schema

    def write(batch: DataFrame, n: int) -> None:
        # a batch that is tried again overwrites its own folder, so nothing appears twice
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def usage_by_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events and their value by hour and type; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour_"), "event_type", "n", "total")


def first_within(events: DataFrame, keys: list[str], ttl: str = "24 hours") -> DataFrame:
    """The first row of each key within the time to live; state is dropped with the watermark."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("began"), "events")


def with_static(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Events with the columns of a table that does not stream; the table is read anew for each batch."""
    return events.join(static, key, "left")


def _due(state: GroupState, keep_hours: float) -> None:
    """Lets a key's state go when the watermark passes the last event by so many hours."""
    state.setTimeoutTimestamp(int(state.getCurrentWatermarkMs() + keep_hours * 3_600_000) if state.getCurrentWatermarkMs() > 0 else int(keep_hours * 3_600_000))


def breaker(events: DataFrame, success: str, soft: int = 2, hard: int = 6, late: str = "2 hours", keep_hours: float = 24 * 40) -> DataFrame:
    """(user_id, longest, state): the longest run of answers that were no success, by key, and what the breaker says.

    State is two numbers for each key; a key without events for `keep_hours` starts anew. Within a batch a key's rows
    are put in order of time; a batch is as large as its trigger's files.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, longest = state.get if state.exists else (0, 0)
        rows = pd.concat([f[["ts", "event_id", "event_type"]] for f in frames]).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            run = 0 if kind == success else run + 1
            longest = max(longest, run)
        state.update((run, longest))
        _due(state, keep_hours)
        verdict = "open" if longest >= hard else "fallback" if longest >= soft else "closed"
        yield pd.DataFrame({"user_id": [key[0]], "longest": [longest], "state": [verdict]})

    slim = events.select("user_id", "ts", "event_id", "event_type").withWatermark("ts", late)
    return slim.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, longest bigint, state string", "run bigint, longest bigint", "update", GroupStateTimeout.EventTimeTimeout)


def earliest_starts(events: DataFrame, delay_seconds: int = 600, late: str = "2 hours", keep_hours: float = 24 * 40) -> DataFrame:
    """(user_id, event_id, wait): seconds each request has to wait so that its host is asked at most once every delay.

    State is one number for each host and goes when nothing came for `keep_hours`, which is more than any delay.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        free = state.get[0] if state.exists else 0.0
        rows = pd.concat([f[["ts", "event_id"]] for f in frames]).sort_values(["ts", "event_id"])
        waits = []
        for t in rows["ts"].astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[getattr(rows["ts"].dt, "unit", "ns")]:
            at = max(t, free)
            waits.append(at - t)
            free = at + delay_seconds
        state.update((free,))
        _due(state, keep_hours)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "wait": waits})

    slim = events.select("user_id", "ts", "event_id").withWatermark("ts", late)
    return slim.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, wait double", "free double", "append", GroupStateTimeout.EventTimeTimeout)
