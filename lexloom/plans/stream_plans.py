"""Queries that run streams to the end of their input; batch SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.sources.tables import table
from lexloom.streaming import events as E

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


BATCHES, LATE = 6, 200  # batches in which the events arrive, and hours that one in ten is late: more than a batch spans
ARRIVALS = f"""e AS (SELECT *, floor(epoch(ts)) AS s FROM events), span AS (SELECT min(s) AS a, max(s) AS b FROM e),
  arr AS (SELECT e.*, CAST(floor((s + CASE WHEN event_id % 10 = 0 THEN {LATE * 3600} ELSE 0 END - a) / ceil((b + {LATE * 3600} + 1 - a) / {BATCHES})) AS INT) AS batch FROM e, span),
  wm AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 2 HOUR AS mark FROM arr GROUP BY batch)"""


@query(
    f"WITH {ARRIVALS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_, event_type, count(*) AS n, round(sum(value), 4) AS total FROM arr JOIN wm USING (batch) WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark GROUP BY 1, 2"
)
def stream_usage(spark, d):
    """Usage by hour and type from events that arrive in six batches; what comes when the watermark of the batch before has passed its hour is dropped."""
    out = E.collect_stream(E.usage_by_hour(E.arriving(spark, d, BATCHES, LATE)), "update")
    last = out.groupBy("hour_", "event_type").agg(F.max(F.struct("n", "total")).alias("m"))
    return last.select(F.to_timestamp_ntz(F.date_format("hour_", "yyyy-MM-dd HH:mm:ss")).alias("hour_"), "event_type", "m.n", F.round("m.total", 4).alias("total"))


@query(f"WITH {ARRIVALS} SELECT CAST(count(*) AS BIGINT) AS late FROM arr JOIN wm USING (batch) WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark")
def stream_late_rows(spark, d):
    """How many rows came too late to count: all rows less those that the stream counted."""
    n = table(spark, d, "events").agg(F.count("*").alias("all"))
    return stream_usage(spark, d).agg(F.sum("n").alias("n")).select((n.select("all").scalar() - F.col("n")).alias("late"))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, count(DISTINCT sid) AS sessions, count(*) AS events FROM s GROUP BY 1"""
)
def stream_sessions(spark, d):
    out = E.collect_stream(E.sessions(E.read_events(spark, d)), "complete")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day_, count(DISTINCT (user_id, event_type)) AS keys FROM events GROUP BY 1")
def stream_dedup_ttl(spark, d):
    """The first event of each user and type a day, from six batches; keys are forgotten when the watermark is 24 hours past them."""
    e = E.arriving(spark, d, BATCHES, 6).withColumn("day_", F.date_format("ts", "yyyy-MM-dd"))
    return E.collect_stream(E.first_within(e, ["user_id", "event_type", "day_"], "24 hours")).groupBy("day_").agg(F.count("*").alias("keys"))


@query("SELECT rate, count(*) AS n FROM events LEFT JOIN (SELECT * FROM (VALUES ('click', 2), ('view', 1)) t(event_type, rate)) USING (event_type) GROUP BY 1")
def stream_static_join(spark, d):
    rates = spark.createDataFrame([("click", 2), ("view", 1)], "event_type string, rate int")
    return E.collect_stream(E.with_static(E.read_events(spark, d), rates, "event_type").select("rate")).groupBy("rate").agg(F.count("*").alias("n"))


@query(
    """WITH i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), r AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, island, count(*) FILTER (WHERE event_type <> 'purchase') AS n FROM i GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, longest, CASE WHEN longest >= 6 THEN 'open' WHEN longest >= 2 THEN 'fallback' ELSE 'closed' END AS state FROM r"""
)
def stream_breaker(spark, d):
    return E.collect_stream(E.breaker(E.read_events(spark, d), "purchase"), "update")


@query()
def stream_polite_waits(spark, d):
    """Waits follow from all earlier ones of a host, which plain SQL does not express; a test holds them against a loop."""
    out = E.collect_stream(E.earliest_starts(E.read_events(spark, d)))
    return out.groupBy("user_id").agg(F.count("*").alias("requests"), F.round(F.max("wait"), 3).alias("longest_wait"))


STAGES = ("view", "click", "signup", "purchase")  # how far an event brings its user


@query("SELECT user_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS stage FROM events GROUP BY 1")
def stream_stage_fold(spark, d):
    """How far each user has come, from events in six batches; late ones never take a stage back."""
    stage = F.lit(0)
    for i, name in enumerate(STAGES):
        stage = F.when(F.col("event_type") == name, i + 1).otherwise(stage)
    out = E.collect_stream(E.arriving(spark, d, BATCHES, LATE).groupBy("user_id").agg(F.max(stage).alias("stage")), "update")
    return out.groupBy("user_id").agg(F.max("stage").alias("stage"))


@query("SELECT user_id, count(DISTINCT time_bucket(INTERVAL 1 HOUR, ts)) AS reads FROM events GROUP BY 1")
def stream_rule_reads(spark, d):
    """How often each host's rules are read anew, being kept for the hour: once for each hour with a request, however late requests come."""
    e = E.arriving(spark, d, BATCHES, 6).withColumn("hour_", F.date_trunc("hour", "ts"))
    return E.collect_stream(E.first_within(e, ["user_id", "hour_"], "12 hours")).groupBy("user_id").agg(F.count("*").alias("reads"))
