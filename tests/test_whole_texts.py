"""Retrieval counts the terms of whole texts."""

from collections import Counter
from math import log

from lexloom.functions import text as T
from lexloom.plans import retrieval_plans as P

FILL = "meadow " * 400  # 2,800 characters
DOCS = [(1, "Alpha", FILL + "harbour custody"), (2, "Beta", "harbour " + FILL), (3, "Gamma", "meadow"), (4, None, None), (5, "Delta", FILL + FILL + "custody custody harbour")]
REFS = [("6-1", "Harbour Custody"), ("6-2", "Harbour"), ("7-1", "Meadow"), (None, "Harbour"), ("7-1", None)]


def data(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(REFS, "indicator_id string, law_name string").write.parquet(f"{tmp_path}/ref_row.parquet")
    return str(tmp_path)


def words(spark, rows):
    df = spark.createDataFrame(rows, "id string, t string")
    return {r["id"]: Counter(r["w"]) for r in df.select("id", T.tokens(df["t"]).alias("w")).collect()}


def brute(spark):
    docs = {int(k): v for k, v in words(spark, [(str(i), " ".join(x for x in (a, b) if x)) for i, a, b in DOCS]).items() if v}
    out, avg = {}, sum(sum(v.values()) for v in docs.values()) / len(docs)
    for q, terms in words(spark, [r for r in REFS if None not in r]).items():
        for d, tf in docs.items():
            s = 0.0
            for t in terms:
                n = sum(t in v for v in docs.values())
                if t in tf:
                    s += terms[t] * log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * sum(tf.values()) / avg))
            if s:
                out[q, d] = s
    return out


def test_bm25_counts_terms_at_the_end_of_long_texts(spark, tmp_path):
    d, want = data(spark, tmp_path), brute(spark)
    assert {("6-1", 1), ("6-1", 5)} <= set(want)
    assert {(r["indicator_id"], r["doc_id"]): r["bm25"] for r in P.bm25_topk(spark, d).collect()} == {k: round(v, 4) for k, v in want.items()}
    top = {q: max(v for (p, _), v in want.items() if p == q) for q, _ in want}
    assert {(r["indicator_id"], r["doc_id"]): r["norm"] for r in P.bm25_maxnorm(spark, d).collect()} == {k: round(v / top[k[0]], 5) for k, v in want.items()}


def test_sibling_penalty_counts_terms_at_the_end_of_long_texts(spark, tmp_path):
    got = {(r["indicator_id"], r["doc_id"]): r["penalty"] for r in P.sibling_penalty(spark, data(spark, tmp_path)).collect()}
    assert got == {("6-1", 1): 0.0, ("6-2", 1): 0.07, ("6-1", 2): 0.0, ("6-2", 2): 0.0, ("6-1", 5): 0.0, ("6-2", 5): 0.07}
