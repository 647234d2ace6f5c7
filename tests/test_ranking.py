import random

from pyspark.sql import functions as F

from lexloom.operators.ranking import running_total


def test_running_total_of_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else f"k{i % 5}", i, rnd.randint(1, 9)) for i in range(2000)]
    got = running_total(spark.createDataFrame(rows, "k string, v int, n int"), ["k"], [F.desc("v")], "n", "above").collect()
    want, seen = {}, {}
    for k, v, n in sorted(rows, key=lambda r: -r[1]):
        want[k, v] = seen.get(k, 0)
        seen[k] = want[k, v] + n
    assert {(r["k"], r["v"]): r["above"] for r in got} == want


def test_running_total_empty(spark):
    assert running_total(spark.createDataFrame([], "k string, v int, n int"), ["k"], [F.desc("v")], "n", "above").count() == 0
