"""The ledger: replay against brute force, leases, fencing, hostile input."""

import datetime as dt
import random

import pytest

from lexloom.operators.incremental import LedgerStore, StaleToken, changed_records, replay_ledger, replay_runs

W = "version_id string, state string, updated_at string, write_seq long, landed_at timestamp_ntz"
R = "run_id string, run_no int, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string"
DAY = dt.datetime(2025, 1, 1)


def at(h):
    return DAY + dt.timedelta(hours=h)


def run(n, h, outcome):
    return (f"r{n}", n, at(h), None, outcome)


def brute(writes, runs):
    out, before = set(), {}
    for r in sorted((r for r in runs if r[4] == "succeeded"), key=lambda r: r[2]):
        now = {}
        for w in writes:
            if w[0] is not None and w[4] is not None and w[4] <= r[2]:
                k = (w[2] or "", w[3] or -1)
                if w[0] not in now or k > now[w[0]][0]:
                    now[w[0]] = (k, w[1])
        for v, (_, body) in now.items():
            if v not in before or before[v] != body:
                out.add((r[0], v))
        before = {v: b for v, (_, b) in now.items()}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    runs = [run(n, n * 7 + rnd.randint(0, 5), rnd.choice(["succeeded", "succeeded", "failed", None])) for n in range(12)]
    writes = []
    for i in range(300):
        v = "hot" if rnd.random() < 0.35 else f"v{rnd.randint(0, 20)}"
        writes.append((v, rnd.choice(["a", "b", None]), f"2025-01-0{rnd.randint(1, 5)}T0{rnd.randint(0, 9)}:00:00Z", i, at(rnd.randint(-5, 95))))
    writes += writes[:40]
    got = changed_records(spark.createDataFrame(writes, W), spark.createDataFrame(runs, R)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(writes, runs)


def test_time_is_an_instant(spark):
    writes = [("v", "old", "2025-01-01T10:00:00+08:00", 2, at(1)), ("v", "new", "2025-01-01T03:00:00Z", 1, at(1))]
    later = [("v", "same", "2025-01-01 02:30:00", 9, at(5))]  # earlier than the current write: nothing changes
    got = changed_records(spark.createDataFrame(writes + later, W), spark.createDataFrame([run(1, 2, "succeeded"), run(2, 6, "succeeded")], R)).collect()
    assert [tuple(r) for r in got] == [("r1", "v")]


def test_nulls_and_empty(spark):
    w = spark.createDataFrame([(None, "a", None, None, at(1)), ("v", None, None, None, at(1)), ("x", "a", "never", 1, None)], W)
    runs = spark.createDataFrame([run(1, 2, "succeeded"), (None, 2, at(3), None, "succeeded"), ("r3", 3, None, None, "succeeded")], R)
    assert [tuple(r) for r in changed_records(w, runs).collect()] == [("r1", "v")]
    assert changed_records(w.limit(0), runs).count() == 0
    assert changed_records(w, runs.limit(0)).count() == 0
    states = {r["ledger_state"] for r in replay_ledger(w.where("landed_at is not null"), runs.limit(0)).collect()}
    assert states <= {"pending"}


def test_extra_columns_with_clashing_names(spark):
    w = spark.createDataFrame([("v", "a", "2025-01-01T00:00:00Z", 1, at(1), "run", 7)], W + ", run_id string, token int")
    assert [tuple(r) for r in changed_records(w, spark.createDataFrame([run(1, 2, "succeeded")], R)).collect()] == [("r1", "v")]


def test_leases_count_the_failed_runs(spark):
    w = spark.createDataFrame([("v", "a", "2025-01-01T00:00:00Z", 1, at(1))], W)
    runs = spark.createDataFrame([run(1, 2, "failed"), run(2, 3, None), run(3, 30, "succeeded")], R)
    (r,) = replay_ledger(w, runs).collect()
    assert (r["done_run"], r["leases"], r["ledger_state"]) == ("r3", 3, "done")


def test_store_leases_expire_and_fence(spark, tmp_path):
    clock = [0.0]
    ledger = LedgerStore(spark, f"file://{tmp_path}/ledger", lease_seconds=10, clock=lambda: clock[0])
    assert ledger.add("day-1") and not ledger.add("day-1")
    first = ledger.lease("day-1", "a")
    assert ledger.state("day-1") == "leased" and ledger.lease("day-1", "b") is None
    clock[0] = 11
    assert ledger.pending() == ["day-1"]
    second = ledger.lease("day-1", "b")
    assert second > first
    with pytest.raises(StaleToken):
        ledger.finish("day-1", first)
    ledger.finish("day-1", second)
    assert ledger.state("day-1") == "done" and ledger.pending() == []
    with pytest.raises(StaleToken):
        ledger.finish("day-1", second)


def test_store_retry_repeats_nothing(spark, tmp_path):
    clock = [0.0]
    ledger = LedgerStore(spark, f"file://{tmp_path}/ledger", lease_seconds=10, clock=lambda: clock[0])
    ledger.add("x")

    def broken(path):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        ledger.run("x", "a", broken)
    clock[0] = 20
    assert ledger.run("x", "b", lambda path: spark.range(5))
    assert not ledger.run("x", "c", lambda path: spark.range(7))
    assert spark.read.parquet(*ledger.results()).count() == 5


def test_replay_takes_leases_through_expiry_and_tokens():
    log = [("a", 0.0, 600.0, "succeeded"), ("b", 7000.0, None, None), ("c", 7100.0, 7200.0, "failed"), ("d", 20000.0, 20600.0, "succeeded"), ("e", 30000.0, None, None)]
    items = replay_runs(log, 3600.0)
    assert [(i["run"], i["token"], i["leases"]) for i in items] == [("a", 1, 1), ("d", 4, 3), ("d", 4, 2), ("d", 4, 1), (None, None, 1)]
    assert replay_runs([], 1.0) == []


def test_killed_run_and_stale_writer_end_to_end(spark, tmp_path):
    """A driver dies after it wrote, another takes over, and the first comes back: every record is in the results once."""
    clock = [0.0]
    root = f"file://{tmp_path}/ledger"
    ledger = LedgerStore(spark, root, lease_seconds=10, clock=lambda: clock[0])
    source = spark.range(100).selectExpr("id", "concat('day-', id % 4) AS day")
    for i in range(4):
        ledger.add(f"day-{i}")
    make = lambda item: source.where(f"day = '{item}'")
    assert ledger.run("day-0", "first", make)
    token = ledger.lease("day-1", "first")
    make("day-1").limit(3).write.parquet(ledger.output_path("day-1", token))  # killed half-way
    clock[0] = 20
    other = LedgerStore(spark, root, lease_seconds=10, clock=lambda: clock[0])
    assert other.pending() == ["day-1", "day-2", "day-3"]
    assert all(other.run(i, "second", make) for i in other.pending())
    make("day-1").write.mode("overwrite").parquet(ledger.output_path("day-1", token))
    with pytest.raises(StaleToken):
        ledger.finish("day-1", token)
    got = spark.read.parquet(*other.results())
    assert got.count() == 100 and got.select("id").distinct().count() == 100
