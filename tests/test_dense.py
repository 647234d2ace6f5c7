"""Every vector whose id is divisible by 20 is searched for among all."""

import random
from math import sqrt

from pyspark.sql import functions as F

from lexloom.operators.retrieval import nearest
from lexloom.plans import retrieval_plans as P


def brute(vecs, k=10):
    norm = {i: sqrt(sum(x * x for x in v)) for i, v in vecs.items()}
    out = {}
    for q in vecs:
        if q % 20 == 0 and norm[q]:
            s = sorted((-round((sum(x * y for x, y in zip(vecs[q], v)) / norm[q] / norm[i] + 1) / 2, 7), i) for i, v in vecs.items() if i != q and norm[i])
            out |= {(q, n): i for n, (_, i) in enumerate(s[:k], 1)}
    return out


def test_all_queries_against_all_rows(spark, tmp_path):
    rnd = random.Random(3)
    vecs = {i: [float(rnd.randint(-3, 3)) for _ in range(6)] for i in range(300)} | {301: [0.0] * 6, 340: [0.0] * 6}
    rows = [(i, v, i % 10) for i, v in vecs.items()]
    df = spark.createDataFrame([*rows, (400, None, 1)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(vecs)
    assert len(want) == 150
    assert {(r["qid"], r["rank"]): r["vec_id"] for r in P.dense_cosine_topk(spark, str(tmp_path)).collect()} == want
    blocks = nearest(df, df.where(F.col("vec_id") % 20 == 0), 10, row_block=50, query_block=4)
    assert {(r["qid"], r["rank"]): r["vec_id"] for r in blocks.collect()} == want
