"""Processing only new or changed records, by a ledger of work items.

One set of rules (`Ledger`): items are pending, leased (with an expiry and a fencing token) or done. A lease whose time is
over returns to pending; a writer that holds an older token than the newest lease is rejected; outputs lie at paths that
follow from item and token, so a retry overwrites nothing and repeats nothing. It keeps its entries in two ways:

* `MemoryLedger` replays the log of runs: `replay_ledger` takes every run of it through leases, expiries and tokens, and
  gives each record what became of its item; `changed_records` reads the records each succeeded run has to take from that.
* `LedgerStore` keeps the ledger of a live job as files in a shared folder.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONED = r"(?i)(Z|[+-]\d\d(:?\d\d)?)$"


def instant(c) -> F.Column:
    """An ISO 8601 time in any of its writings as an instant; without a zone it is UTC; unreadable or null: null."""
    t = F.trim(c)
    return F.when(t.rlike(ZONED), t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp")


def content_digest(columns: list[str]) -> F.Column:
    """A digest of the named columns in which null equals null and differs from every value."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns)))), 256)


def replay_runs(log: list[tuple[str, float, float | None, str | None]], lease_seconds: float) -> list[dict]:
    """What became of each work item of a log of runs (run_id, start, end, outcome) in order of their starts.

    Item k is what became readable since the start of run k - 1 and until that of run k. Every run enters its item and
    leases all that are pending; a run that succeeded finishes them with its tokens. The lease of a run that failed
    ends with the run, that of a run that never ended expires after `lease_seconds`; where a later run was started
    before that, the lease was given up by then, and its token is stale.
    """
    now = 0.0
    ledger = MemoryLedger(lease_seconds, lambda: now)
    out: list[dict] = []
    open_items: list[int] = []
    for k, (run, start, end, outcome) in enumerate(log):
        now = start
        ledger.add(f"{k}")
        out.append({"at": start, "run": None, "done_at": None, "token": None, "leases": 0})
        open_items.append(k)
        ends = [start + lease_seconds, *([log[k + 1][1]] if k + 1 < len(log) else []), *([end] if outcome == "failed" and end is not None else [])]
        held = [(i, token) for i in open_items if (token := ledger.lease(f"{i}", run, min(ends))) is not None]
        for i, token in held:
            out[i]["leases"] = token
            if outcome == "succeeded":
                ledger.finish(f"{i}", token)
                out[i] |= {"run": run, "done_at": start, "token": k + 1}
        open_items = [i for i in open_items if ledger.state(f"{i}") != "done"]
    return out


def replay_ledger(writes: DataFrame, runs: DataFrame, landed: str = "landed_at", lease_seconds: float = 3600.0) -> DataFrame:
    """Adds to each write the ledger's columns, as the log of runs leaves them (`replay_runs`).

    `runs` has run_id, started_at, finished_at (may be missing) and outcome; the log, a row a run, is replayed on the
    driver. Adds `done_run` (run_id of the run that finished the write's item), `done_at` (started_at of that run),
    `token` (its place among all runs), `leases` (times the item was leased until it was done) and `ledger_state` ('done', 'leased'
    after only runs that did not succeed, 'pending' before any run).

    No range join: a calendar with a row for each day of the log is joined by day, and holds the day's few items and
    the next. Runs with null run_id or started_at do not count. Empty inputs give an empty result or 'pending' for every
    write.
    """
    spark = writes.sparkSession
    ended = (F.col("finished_at") if "finished_at" in runs.columns else F.lit(None)).cast("timestamp_ntz")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    log = runs.where("run_id is not null and started_at is not null").select(F.col("run_id").alias("run"), seconds(F.col("started_at")).alias("a"), seconds(ended).alias("b"), "outcome", F.col("started_at").cast("timestamp_ntz").alias("at"))
    rows = log.orderBy("a", "run").collect()
    items = [i | {"at": r["at"], "done_at": next_at} for i, r, next_at in _with_times(replay_runs([tuple(r)[:4] for r in rows], lease_seconds), rows)]
    day: dict[dt.date, list[dict]] = {}
    for i in items:
        day.setdefault(i["at"].date(), []).append(i)
    calendar, after = [], None
    if items:
        for n in range((items[-1]["at"].date() - items[0]["at"].date()).days, -1, -1):
            d = items[0]["at"].date() + dt.timedelta(days=n)
            calendar.append((d, day.get(d, []), after))
            after = day[d][0] if d in day else after
    item = "struct<at: timestamp_ntz, run: string, done_at: timestamp_ntz, token: int, leases: int>"
    # as an Arrow table its size is known, so a log that is small enough is broadcast without a shuffle first
    stamp = pa.timestamp("us")
    arrow = pa.struct([("at", stamp), ("run", pa.string()), ("done_at", stamp), ("token", pa.int32()), ("leases", pa.int32())])
    rows_ = pa.Table.from_pylist([{"_day": x, "_items": y, "_after": z} for x, y, z in calendar], pa.schema([("_day", pa.date32()), ("_items", pa.list_(arrow)), ("_after", arrow)]))
    days = spark.createDataFrame(rows_, f"_day date, _items array<{item}>, _after {item}")
    at = F.col(f"`{landed}`").cast("timestamp_ntz")
    first = F.lit(items[0]["at"].date() if items else None).cast("date")
    mine = F.element_at(F.filter("_items", lambda r: r["at"] >= at), 1)
    due = F.when(F.size(F.filter("_items", lambda r: r["at"] >= at)) > 0, mine).otherwise(F.col("_after"))
    joined = writes.withColumn("_day", F.greatest(F.to_date(at), first)).join(days, "_day", "left").withColumn("_item", F.when(at.isNotNull(), due))
    done = F.col("_item.run").isNotNull()
    return (
        joined.withColumn("done_run", F.col("_item.run"))
        .withColumn("done_at", F.col("_item.done_at"))
        .withColumn("token", F.col("_item.token"))
        .withColumn("leases", F.when(done, F.col("_item.leases")))
        .withColumn("ledger_state", F.when(done, "done").when(F.col("_item").isNotNull(), "leased").otherwise("pending"))
        .drop("_day", "_items", "_after", "_item")
    )


def _with_times(items: list[dict], rows: list) -> list[tuple[dict, dict, object]]:
    """Items with their run of the log and the time of the run that finished them."""
    return [(i, r, rows[i["token"] - 1]["at"] if i["token"] else None) for i, r in zip(items, rows)]


def changed_records(
    writes: DataFrame, runs: DataFrame, key: str = "version_id", updated: str = "updated_at", seq: str = "write_seq", landed: str = "landed_at"
) -> DataFrame:
    """(run_id, key): the records each succeeded run takes, none skipped and none repeated.

    A record's current write at a run is, of its writes finished by then in the ledger, the one with the latest
    `updated` as an instant, then the largest `seq`; of equal ones the one with the larger digest. The run takes the
    record if the current write is the first, or differs in any column but `updated`, `seq`, `landed` from the one at
    the preceding succeeded run. Null keys name no record and are left out; an unreadable time counts as the earliest;
    a null landing time never becomes readable. Writes are reduced to one for each record and run before they are
    ordered, so a record with a third of all writes is as small as the log of runs.
    """
    body = [c for c in writes.columns if c not in (key, updated, seq, landed)]
    slim = writes.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{landed}`").isNotNull()).select(
        F.col(f"`{key}`").alias("_key"),
        F.col(f"`{landed}`").alias("_landed"),
        F.struct(instant(F.col(f"`{updated}`")).alias("t"), F.col(f"`{seq}`").alias("s"), content_digest(body).alias("d")).alias("_w"),
    )
    done = replay_ledger(slim, runs, "_landed").where("ledger_state = 'done'")
    per_run = done.groupBy("_key", "token", "done_run").agg(F.max("_w").alias("_w"))
    so_far = Window.partitionBy("_key").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    in_turn = Window.partitionBy("_key").orderBy("token")
    current = per_run.withColumn("_now", F.max("_w").over(so_far)["d"])
    return (
        current.withColumn("_before", F.lag("_now").over(in_turn))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("_now")))
        .select(F.col("done_run").alias("run_id"), F.col("_key").alias(key))
    )


class StaleToken(RuntimeError):
    """A writer came back after its lease had been given to another."""


class Ledger:
    """The rules of leases; how entries are kept is left to `_names`, `_has`, `_create` (only if there is none) and `_read`.

    Entries: items/<item>, leases/<item>/<token> (whoever creates it has the token), done/<item> (the token whose
    output counts).
    """

    def __init__(self, lease_seconds: float, clock: Callable[[], float]):
        self.lease_seconds, self.clock = lease_seconds, clock

    def add(self, item: str) -> bool:
        """Enters an item as pending; False if the ledger has it already."""
        return self._create(f"items/{item}", {})

    def _newest(self, item: str) -> int:
        return max(map(int, self._names(f"leases/{item}")), default=0)

    def state(self, item: str) -> str:
        if self._has(f"done/{item}"):
            return "done"
        token = self._newest(item)
        return "leased" if token and self._read(f"leases/{item}/{token:09d}").get("expires", 0) > self.clock() else "pending"

    def lease(self, item: str, owner: str, expires: float | None = None) -> int | None:
        """A new fencing token for a pending item, or None if it is done, leased or lost to another owner."""
        if self.state(item) != "pending":
            return None
        token = self._newest(item) + 1
        ok = self._create(f"leases/{item}/{token:09d}", {"owner": owner, "expires": self.clock() + self.lease_seconds if expires is None else expires})
        return token if ok else None

    def finish(self, item: str, token: int) -> None:
        """Marks the item done with this token's output; a token that is no longer the newest raises StaleToken."""
        newest = self._newest(item)
        if newest != token:
            raise StaleToken(f"{item}: token {token}, newest {newest or None}")
        if not self._create(f"done/{item}", {"token": token}):
            raise StaleToken(f"{item} is done already")

    def pending(self) -> list[str]:
        """The items to be leased; what is done is listed once, leases are read of the others only."""
        done = set(self._names("done"))
        return [i for i in self._names("items") if i not in done and self.state(i) == "pending"]


class MemoryLedger(Ledger):
    """A ledger in memory, for replays."""

    def __init__(self, lease_seconds: float, clock: Callable[[], float]):
        super().__init__(lease_seconds, clock)
        self._entries: dict[str, dict[str, dict]] = {}

    def _names(self, sub: str) -> list[str]:
        return sorted(self._entries.get(sub, ()))

    def _has(self, sub: str) -> bool:
        folder, name = sub.rsplit("/", 1)
        return name in self._entries.get(folder, ())

    def _create(self, sub: str, value: dict) -> bool:
        folder, name = sub.rsplit("/", 1)
        return self._entries.setdefault(folder, {}).setdefault(name, value) is value

    def _read(self, sub: str) -> dict:
        folder, name = sub.rsplit("/", 1)
        return self._entries[folder][name]


class LedgerStore(Ledger):
    """The ledger of a live job in a shared folder, safe with several drivers.

    The folder must be on a file system that creates files exclusively (HDFS, NFS, local; an object store only behind
    a connector that does). Only item names and tokens pass through the driver, never records.
    """

    def __init__(self, spark: SparkSession, root: str, lease_seconds: float = 600.0, clock: Callable[[], float] = time.time):
        super().__init__(lease_seconds, clock)
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        p = self._path(f"{self.root}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _has(self, sub: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{sub}"))

    def _create(self, sub: str, value: dict) -> bool:
        """Creates a file only if there is none; the file system makes it exclusive."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{sub}"), False)
        except Exception as e:  # FileAlreadyExistsException, wrapped by py4j
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        return True

    def _read(self, sub: str) -> dict:
        p = self._path(f"{self.root}/{sub}")
        n = self._fs.getFileStatus(p).getLen()
        src = self._fs.open(p)
        try:
            data = bytes(b & 0xFF for b in self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src)) if n else b"{}"
        finally:
            src.close()
        return json.loads(data or b"{}")

    def output_path(self, item: str, token: int) -> str:
        return f"{self.root}/out/{item}/{token:09d}"

    def run(self, item: str, owner: str, make: Callable[[str], DataFrame]) -> bool:
        """Leases the item, writes `make(item)` to the token's path and finishes it; False if it was not to be had."""
        token = self.lease(item, owner)
        if token is None:
            return False
        make(item).write.mode("overwrite").parquet(self.output_path(item, token))
        self.finish(item, token)
        return True

    def results(self) -> list[str]:
        """The paths of all finished outputs, one for each done item."""
        return [self.output_path(i, self._read(f"done/{i}")["token"]) for i in self._names("done")]
