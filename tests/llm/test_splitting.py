import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm.splitting import has_long_stretch, split_oversized, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\f!。#", max_size=1500), st.integers(60, 200))
def test_round_trip_and_limits(text, limit):
    pieces = split_text(text, limit, 20)
    assert "".join(text[n:e] for _, n, e, _ in pieces) == text
    assert all(e - s <= limit for s, _, e, _ in pieces)
    for (_, _, end, _), (s, n, _, _) in zip(pieces, pieces[1:]):
        assert n == end and s == max(0, end - 20)


def test_cuts_are_natural_where_they_can_be():
    text = "".join(f"{k}. Title\nSentence one of {k}. Sentence two of it.\n\n" for k in range(200))
    assert not any(f for *_, f in split_text(text, 3000, 200))
    assert all(text[e - 1] in "\n" for _, _, e, _ in split_text(text, 3000, 200)[:-1])


def test_forced():
    assert has_long_stretch("x" * 3001, 3000) and not has_long_stretch("x" * 3000, 3000)
    assert not has_long_stretch("x" * 2000 + "\r" + "y" * 2000, 3000)
    assert has_long_stretch("3.14" * 1000, 3000) and not has_long_stretch("word. " * 1000, 3000)


def test_items(spark):
    rnd = random.Random(1)
    long = " ".join(rnd.choice("abc") * 5 for _ in range(900)) + "."
    rows = [
        ("a", json.dumps({"verbatim_snippet": long})), ("b", json.dumps(json.dumps({"verbatim_snippet": "é" * 3500}))), ("c", json.dumps({"verbatim_snippet": long})[:-5]),
        ("d", None), ("e", ""), ("f", json.dumps({"verbatim_snippet": "short", "pad": "x" * 4000})), ("g", json.dumps([1] * 3000)), ("h", json.dumps({"verbatim_snippet": None, "p": "x" * 4000})), ("a", json.dumps({"verbatim_snippet": long})),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, j string, forced int")
    got = split_oversized(df, "id", "j", json_field="verbatim_snippet").collect()
    assert sorted((r["id"], r["forced"]) for r in got) == [("a", 1), ("a", 1), ("b", 1)]
    assert all(len(p["text"]) <= 3000 for r in got for p in r["pieces"])
    assert split_oversized(df.limit(0), "id", "j").count() == 0


def test_siblings_are_merged_and_only_oversized_nodes_entered():
    from lexloom.llm.splitting import Tree

    part = lambda p, n: f"PART {p}\n" + "".join(f"Section {p}{k}\n" + "A rule stands here. " * n + "\n" for k in range(3))
    text = part(1, 5) + part(2, 40) + part(3, 5)
    cuts = [text[e:].split("\n")[0] for _, _, e, _ in split_text(text, 1200, 200)[:-1]]
    assert cuts[0] == "PART 2"  # the first part fits and stays whole
    assert all(c.startswith(("PART", "Section")) for c in cuts)
    listed = "Intro.\n" + "".join(f"- item {i}\n" + "".join(f"  - sub {i}.{k} " + "x" * 20 + "\n" for k in range(4)) for i in range(30))
    assert all(listed[e:].startswith("- item") for _, _, e, _ in split_text(listed, 500, 100)[:-1])
    deep = "".join(" " * k + f"- level {k}\n" for k in range(2000))
    assert all(e - s <= 3000 for s, _, e, _ in split_text(deep, 3000, 200))
    assert Tree("").pack(10) == [] and Tree("ab. " * 3).longest_stretch() == 2
