"""Token ids against the library's encoder, and packings against their invariants."""

import base64
import random

import pytest
import tiktoken

from lexloom.llm.bpe import default_vocabulary, encode_corpus
from lexloom.llm.packing import harmonic_plan, pack, pattern_plan, places

TEXTS = [None, "", " ", "\n\n  \t", "Hello  world", "<|endoftext|> is text", "a" * 5000, "ab" * 2000, "法" * 900, "Điều 5 «О связи» 第5条", "e\u0301\u200d🏳️‍🌈", "x" * 30 + " " * 100 + "y", "12345678 1,000.00 'll 've"]


@pytest.fixture(scope="module")
def tk():
    path, pattern = default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(spark, tk):
    rnd = random.Random(2)
    texts = TEXTS + ["".join(rnd.choice("aeiou tnrs\n0123é日本ж.,<|>") for _ in range(rnd.randint(0, 300))) for _ in range(150)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "x"), (0, "again", "x")]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tk.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want


def test_sizes_and_empty_table(spark, tk):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in encode_corpus(df, "doc_id", "text", only_sizes=True).collect()} == {i: len(tk.encode_ordinary(t)) if t else 0 for i, t in enumerate(TEXTS)}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("method", ["pattern", "harmonic"])
def test_pack_keeps_everything_and_fits(spark, method):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 7, 50, 50, 50, 333, 1000, 1025, 2048, 2049, 5000])) for i in range(1500)] + [(None, 12), (3, 12), (3, 12), (9999, None)]
    got = pack(spark.createDataFrame(rows, "id long, n int"), "id", "n", 2048, method).collect()
    boxes, back = {}, {}
    for r in got:
        boxes[r["container"]] = boxes.get(r["container"], 0) + r["size"]
        back[r["id"]] = back.get(r["id"], 0) + r["size"]
    assert max(boxes.values()) <= 2048
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert back == want
    per = {}
    for r in got:
        per.setdefault(r["id"], []).append(r["part"])
    assert all(len(per[i]) == -(-n // 2048) for i, n in rows if n and n > 2048 and i is not None)
    if method == "pattern":
        assert sum(boxes.values()) / (2048 * len([b for b in boxes.values() if b])) > 0.97


def test_pack_empty_and_zeros(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert pack(df, "id", "n").count() == 0
    got = pack(spark.createDataFrame([(1, 0), (2, 0)], "id long, n int"), "id", "n").collect()
    assert {(r["id"], r["container"]) for r in got} == {(1, 0), (2, 0)}


def test_plans_do_not_depend_on_the_number_of_items():
    slots, used = pattern_plan({700: 10**9, 600: 10**9, 48: 10**9}, 2048)
    assert len(slots) < 20 and used < 10**9
    assert sum(s[2] - s[1] for s in slots) == 3 * 10**9
    assert len(harmonic_plan({700: 10**9, 48: 10**9}, 2048)) == 2


def test_places_of_one_hot_value(spark):
    got = places(spark.range(5000).selectExpr("id", "1 as size"), "size", ["id"]).collect()
    assert sorted(r["place"] for r in got) == list(range(5000))
