import json

from pyspark.sql import functions as F

from lexloom.functions import plugins as P
from lexloom.functions import text as T
from lexloom.operators import merge as M
from lexloom.operators import retrieval as R
from lexloom.operators import structure as S
from lexloom.sources import files


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", name\nwith a line', None), (2, "", "12.10")]
    df = spark.createDataFrame(rows, "id int, name string, code string")
    files.write_csv(df, str(tmp_path / "csv"), ["id", "name", "code"])
    back = files.read_csv(spark, str(tmp_path / "csv")).collect()
    assert {(r["id"], r["name"], r["code"]) for r in back} == {("1", rows[0][1], None), ("2", None, "12.10")}
    text = files.csv_text(df.where("id = 2"), ["id", "code"])
    assert text == '﻿"id","code"\r\n"2","12.10"\r\n'


def test_columns_by_keyword(spark):
    df = spark.createDataFrame([("SG", "Act", "x")], "`Country.name` string, `Title of law` string, other string")
    assert files.pick_columns(df, {"economy": ["country"], "law": ["law", "act"], "url": ["link"]}).collect()[0].asDict() == {"economy": "SG", "law": "Act", "url": None}


def test_documents_and_partitions(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.bin").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "d/b.bin").write_text("<html><p>x</p></html>")
    (tmp_path / "d/c.bin").write_text("plain")
    got = {r["path"][-5:]: (r["kind"], r["text"]) for r in files.read_documents(spark, str(tmp_path / "d")).collect()}
    assert got["a.bin"] == ("pdf", None) and got["b.bin"][0] == "html" and got["c.bin"] == ("text", "plain")
    files.write_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), str(tmp_path / "p"), ["k"])
    files.write_partitions(spark.createDataFrame([("b", 3)], "k string, v int"), str(tmp_path / "p"), ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("a", 1), ("b", 3)}


def test_catalogue_source(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": str(i), "title": f"Law {i}", "in_force": i % 2 == 0}) for i in range(25)))
    spark.dataSource.register(files.CatalogueSource)
    df = spark.read.format("catalogue").option("path", str(tmp_path / "c.jsonl")).option("page_size", "10").load()
    assert df.count() == 25 and df.where("in_force").count() == 13 and df.rdd.getNumPartitions() == 3


def test_robots(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y # fine\nCrawl-delay: 5\n\nUser-agent: *\nDisallow:\n"
    got = {tuple(r) for r in files.robots_rules(spark.createDataFrame([("h", body)], "host string, body string")).collect()}
    assert got == {("h", "a", "/x", False, 5.0), ("h", "a", "/x/y", True, 5.0), ("h", "b", "/x", False, 5.0), ("h", "b", "/x/y", True, 5.0), ("h", "*", None, None, None)}


def test_han_numbers(spark):
    want = {"〇": 0, "九": 9, "十": 10, "十一": 11, "二十": 20, "九十九": 99, "一百零一": 101, "一百一十": 110, "九百九十九": 999, "一千零一": 1001, "两千三百": 2300, "abc": None, "": None}
    got = spark.createDataFrame([(k,) for k in want], "n string").select("n", T.han_to_int(F.col("n")).alias("v")).collect()
    assert {r["n"]: r["v"] for r in got} == want


def test_tokens_and_spines(spark):
    df = spark.createDataFrame([("Act é 个人信息 х Я", "s. 26(1), 20.1.5 and 7A")], "t string, c string")
    r = df.select(T.tokens(F.col("t")).alias("t"), T.article_spine(F.col("c")).alias("s")).collect()[0]
    assert r["t"] == ["act", "é", "个人", "人信", "信息", "х", "я"] and r["s"] == sorted(["26(1)", "26", "20.1.5", "20", "7a"])


def test_wer_json_alias(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", ""), ("", "x"), (None, "x")], "r string, h string")
    assert [x["w"] for x in df.select(P.word_error_rate(F.col("r"), F.col("h")).alias("w")).collect()] == [0.6667, 0.0, 1.0, None]
    said = spark.createDataFrame([('<think>{"a":1}</think>{"b": "}"} x {"c": {"d": 2}} {bad}',), ("none",), (None,)], "s string")
    assert [x["o"] for x in said.select(P.last_json_object(F.col("s")).alias("o")).collect()] == ['{"c": {"d": 2}}', None, None]
    names = spark.createDataFrame([("singapore",), ("Rep. of Singapore",), ("Singapor",), ("Mars",), (None,)], "n string")
    assert [x["c"] for x in names.select(P.resolve_alias(F.col("n"), {"Singapore": "SG", "Malaysia": "MY"}).alias("c")).collect()] == ["SG", "SG", "SG", None, None]


def test_greedy_same_law_and_grader(spark):
    df = spark.createDataFrame([("L", "a", list("12345678"), 8), ("L", "b", list("123"), 3), ("L", "c", list("xyz"), 3), ("M", "d", None, 0)], "law string, doc string, spine array<string>, n int")
    assert {(r["doc"], r["kept"]) for r in P.greedy_same_law(df, "law", "doc", "spine", "n").collect()} == {("a", True), ("b", False), ("c", True), ("d", True)}

    def broken(q, t):
        raise RuntimeError

    P.GRADERS["broken"] = broken
    g = spark.createDataFrame([("data law", "data"), (None, None)], "q string, t string")
    assert {r["grade"]["failed"] for r in P.grade(g, "q", "t", "broken").collect()} == {True}
    assert [r["grade"]["score"] for r in P.grade(g, "q", "t").collect()] == [0.5, 0.0]


def test_structure_edges(spark):
    doc = spark.createDataFrame([(1, "x\nSection 1. A\n" + "y" * 30 + "\nSection 2. B\nz"), (2, "no boundary at all here"), (3, None), (4, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["segment"], r["label"]) for r in S.provisions(S.lines(doc), 10).collect()}
    assert got == {(1, 1, "Section 1. A"), (1, 2, "Section 2. B"), (2, 0, None)}
    assert S.provisions(S.lines(doc.limit(0))).count() == 0


def test_partitions_do_not_matter(spark):
    rows = [("q", f"law{i % 7}", f"d{i}", float(i % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "q string, law string, doc string, s double")
    a, b = ({tuple(r) for r in R.diverse(df.repartition(n), "q", "law", "doc", "s", 20, 2).select("doc", "rank").collect()} for n in (1, 8))
    assert a == b and len(a) == 20


def test_upsert_and_guards(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "k int, v string, first string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", "y")], "k int, v string, first string")
    assert {tuple(r) for r in M.upsert(old, new, ["k"], ["first"]).collect()} == {(1, "a", "x"), (2, None, "x"), (3, "c", "y")}
    g = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0)], "g string, ok int")
    assert {tuple(r) for r in M.unless_empty(g, ["g"], F.col("ok") == 1).collect()} == {("a", 1), ("b", 0)}
