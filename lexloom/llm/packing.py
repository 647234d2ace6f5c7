"""Filling containers of fixed capacity with items, by classes of lengths that each have a fixed count per container.

Harmonic packing puts the lengths in (C/(k+1), C/k] into class k and k of them into a container, so that a worker
that knows an item's class and its place in the class knows its container. That alone leaves a third and more of the
space empty (README has figures). The planner here keeps the principle and refines the classes to single lengths:
from the histogram of lengths, which has at most C entries whatever the number of items, it lays out kinds of
container, each with a fixed number of items of each length, and a multiplicity. Items find their container from
their length and their place among the items of that length, independently across workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def harmonic_plan(histogram: dict[int, int], capacity: int, classes: int = 16) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first place, end place, first container, items of this length per container), harmonic classes only.

    The places of class k run through its lengths from the longest; lengths up to capacity/classes share the last
    class, of which a container takes as many as fit for the longest of them.
    """
    slots, base = [], 0
    for k in range(1, classes + 1):
        own = [s for s in sorted(histogram, reverse=True) if 0 < s <= capacity // k and (s > capacity // (k + 1) or k == classes)]
        if not own:
            continue
        per, at = (capacity // own[0] if k == classes else k), 0
        for s in own:
            slots.append((s, 0, histogram[s], base, per, at))
            at += histogram[s]
        base += -(-at // per)
    return slots


def pattern_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(slots, containers) by best fit of the lengths in falling order onto kinds of container.

    A slot (length, first place, end place, first container, per) says: items of this length with places in
    [first, end) fill containers from `first container` on, `per` each. Work is by kinds, not by items: at most a few
    for each length.
    """
    spans: dict[int, list[tuple[int, int]]] = {}  # room left -> spans of containers [first, end)
    slots, used = [], 0
    for s in sorted((x for x in histogram if x > 0), reverse=True):
        left, place = histogram[s], 0
        while left:
            room = min((r for r in spans if r >= s), default=None)
            if room is None:
                per = capacity // s
                full, rest = divmod(left, per)
                if full:
                    spans.setdefault(capacity - per * s, []).append((used, used + full))
                    slots.append((s, place, place + full * per, used, per))
                    used, place = used + full, place + full * per
                if rest:
                    spans.setdefault(capacity - rest * s, []).append((used, used + 1))
                    slots.append((s, place, place + rest, used, rest))
                    used += 1
                break
            a, b = spans[room].pop()
            if not spans[room]:
                del spans[room]
            per = room // s
            full = min(b - a, left // per)
            if full == 0:  # fewer items than one container of this kind takes
                per, full = left, 1
            spans.setdefault(room - per * s, []).append((a, a + full))
            if a + full < b:
                spans.setdefault(room, []).append((a + full, b))
            slots.append((s, place, place + full * per, a, per))
            place, left = place + full * per, left - full * per
    return slots, used


#: Rows that one group counts at most, on average, when places are given.
GROUP_ROWS = 100_000


def places(items: DataFrame, by: str, order: list[str], salts: int = 64) -> DataFrame:
    """Adds `place`: 0, 1, ... among the rows of equal `by`, in no order of meaning but the same every time.

    A value of `by` with a third of all rows is spread over `salts` groups that count on their own; the groups'
    starts come from their sizes. The caller knows how many rows a value has and salts accordingly.
    """
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(by, "_salt").count()
    starts = sizes.withColumn("_start", F.sum("count").over(Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select(
        by, "_salt", F.coalesce("_start", F.lit(0)).alias("_start")
    )
    inner = F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_n", inner).join(starts, [by, "_salt"]).withColumn("place", F.col("_start") + F.col("_n")).drop("_salt", "_n", "_start")


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 2048, method: str = "pattern") -> DataFrame:
    """(container BIGINT, id, part INT, size INT): every item in containers of at most `capacity`.

    An item larger than the capacity is split into parts of the capacity and a rest (part 0, 1, ...); no other item
    is. Items of size 0 need no room and join the containers in turn (container 0 if there is no other). A null size
    counts as 0. Repeated rows are items of their own. `method` is 'pattern' or 'harmonic' (see above).
    The driver sees only the histogram of sizes, at most `capacity` + 1 numbers.
    """
    n = F.coalesce(F.col(f"`{size_col}`").cast("int"), F.lit(0))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0))))
    parts = items.select(F.col(f"`{id_col}`"), n.alias("_n"), part.alias("part")).select(
        F.col(f"`{id_col}`"), "part", F.least(F.col("_n") - F.col("part") * capacity, F.lit(capacity)).alias("size")
    )
    spark = items.sparkSession
    histogram = {r["size"]: r["count"] for r in parts.groupBy("size").count().collect()}  # at most capacity + 1 rows
    if method == "harmonic":
        slots = harmonic_plan(histogram, capacity)
        used = max((base + -(-(at + end) // per) for _, _, end, base, per, at in slots), default=0)
    else:
        plan, used = pattern_plan(histogram, capacity)
        slots = [(*s, 0) for s in plan]
    schema = "size int, _a bigint, _b bigint, _first bigint, _per int, _shift bigint"
    table = spark.createDataFrame(slots, schema).groupBy("size").agg(F.collect_list(F.struct("_a", "_b", "_first", "_per", "_shift")).alias("_slots"))
    placed = places(parts, "size", [id_col, "part"], max(64, -(-max(histogram.values(), default=0) // GROUP_ROWS)))
    slot = F.element_at(F.filter("_slots", lambda s: (s["_a"] <= F.col("place")) & (F.col("place") < s["_b"])), 1)
    box = F.col("_slot._first") + F.floor((F.col("place") - F.col("_slot._a") + F.col("_slot._shift")) / F.col("_slot._per"))
    return (
        placed.join(table, "size", "left")
        .withColumn("_slot", F.when(F.col("_slots").isNotNull(), slot))
        .select(F.when(F.col("size") > 0, box).otherwise(F.pmod(F.col("place"), F.lit(max(used, 1)))).cast("bigint").alias("container"), F.col(f"`{id_col}`"), "part", "size")
    )
