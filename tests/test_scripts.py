"""Tokens and citations of all scripts, by literal cases."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.plugins import word_error_rate


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(f(F.col("t")).alias("x"), "i").orderBy("i").select("x").collect()]


TOKENS = {
    "Section 26(1) of the Act": ["section", "26", "1", "of", "the", "act"],
    "个人信息": ["个人", "人信", "信息"],
    "法": ["法"],
    "Закон о данных": ["закон", "о", "данных"],
    "dữ liệu được chuyển": ["dữ", "liệu", "được", "chuyển"],
    "proteção 1.º": ["proteção", "1"],
    "กฎหมายข้อมูล": [a + b for a, b in zip("กฎหมายข้อมูล", "กฎหมายข้อมูล"[1:])],
    "ກົດໝາຍ": [a + b for a, b in zip("ກົດໝາຍ", "ກົດໝາຍ"[1:])],
    "データ法": ["デー", "ータ", "タ法"],
    "हिन्दी text": ["हिन्दी", "text"],
    "": [],
}


def test_tokens(spark):
    assert dict(zip(TOKENS, one(spark, T.tokens, *TOKENS))) == TOKENS
    assert one(spark, T.tokens, None) == [None]


SPINES = {
    "Section 199; Section 4": {"199", "4"}, "s. 26(1)": {"26(1)", "26"}, "Article 20.1.5": {"20.1.5", "20"}, "第四十条": {"40"}, "14 дүгээр зүйл": {"14"}, "APP 8": {"app8"}, "第一百零一条": {"101"},
    "第二十一条": {"21"}, "第十条": {"10"}, "第3条": {"3"}, "第 五 章": {"5"}, "12B": {"12b"}, "Sections 5 and 6": {"5", "6"}, "Regulation 45(2)(a)(i)": {"45(2)(a)(i)", "45"}, "7 дахь зүйл": {"7"}, "whole Act": set(), "": set(),
}


def test_article_spine(spark):
    assert {k: set(v) for k, v in zip(SPINES, one(spark, T.article_spine, *SPINES))} == SPINES


def test_labels(spark):
    want = {"APP 8": "APP 8", "Australian Privacy Principle 8.1": "APP 8.1", "principle 3": "APP 3", "26a": "Section 26A", "sec. 5": "Section 5", "pasal 3": "Pasal 3"}
    assert dict(zip(want, one(spark, T.label, *want))) == want


@pytest.mark.parametrize("numeral,n", [("十", 10), ("二十一", 21), ("一百零一", 101), ("两千三百", 2300), ("九百九十九", 999), ("〇", 0), ("x", None)])
def test_han(spark, numeral, n):
    assert one(spark, T.han_to_int, numeral) == [n]


def test_word_error_rate(spark):
    def brute(a, b):
        r, h = a.split(), b.split()
        if not r:
            return float(bool(h))
        row = list(range(len(h) + 1))
        for i, x in enumerate(r, 1):
            old, row = row, [i]
            for j, y in enumerate(h, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return round(row[-1] / len(r), 4)

    texts = ["a b c d", "a c d", "", "  ", "d c b a", "Закон о лесах", "Закон лесах о", "a a a a b", " ".join(map(str, range(300)))]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    got = [r[0] for r in df.select(word_error_rate(F.col("a"), F.col("b"))).collect()]
    assert got[:-2] == [brute(*p) for p in pairs] and got[-2:] == [None, None]
