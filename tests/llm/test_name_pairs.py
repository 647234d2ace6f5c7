import random
from collections import Counter
from math import log, sqrt

from pyspark.sql import functions as F

from lexloom.llm.names import average_linkage, grams_of, similar_pairs

LEAST = 0.6


def brute(rows):
    """All pairs of one scope and of years that agree, by the cosine of all their n-grams."""
    out = {}
    for scope in {r["scope"] for r in rows}:
        own = [r for r in rows if r["scope"] == scope]
        df = Counter(g for r in own for g in set(r["grams"]))
        vec = {}
        for r in own:
            v = {g: (1 + log(n)) * (log((len(own) + 1) / df[g]) + 0.1) for g, n in Counter(r["grams"]).items()}
            norm = sqrt(sum(x * x for x in v.values()))
            vec[f"{scope} {r['name']}"] = r["year"], {g: x / norm for g, x in v.items()}
        for a, (ya, va) in vec.items():
            for b, (yb, vb) in vec.items():
                s = sum(x * vb.get(g, 0) for g, x in va.items())
                if a < b and s >= LEAST and (0 in (ya, yb) or ya == yb or (ya < 0 < yb and yb % 100 == -ya - 1) or (yb < 0 < ya and ya % 100 == -yb - 1)):
                    out[a, b] = round(s, 6)
    return out


def check(spark, names):
    g = grams_of(spark.createDataFrame(names, "scope string, name string"))
    got = {(r["a"], r["b"]): round(r["s"], 6) for r in similar_pairs(g, LEAST).collect()}
    assert got == brute(g.collect())
    return got


def test_spellings_of_one_name_in_a_small_block(spark):
    names = [("A", n) for n in ("Harbour Custody Act 1975", "HARBOUR CUSTODY ACT 1975", "Harbour Custody Act, 1975", "Act Harbour Custody 1975", "Forest Code 1975")]
    assert len(check(spark, names)) == 6


def test_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(5)
    words = "harbour custody forest ledger notice record water audit".split()
    names = {("A", " ".join(rnd.sample(words, rnd.randint(1, 4))) + rnd.choice(["", " 1975", " 1999", " '99"])) for _ in range(60)}
    names |= {("A", f"Harbour Custody Act{'.' * i} 1999") for i in range(30)} | {("B", "Harbour Custody Act"), ("A", "§")}
    assert check(spark, sorted(names))


def test_names_without_a_year_meet_those_with_one_and_join_no_two_years(spark):
    names = [("A", n) for n in ("Harbour Custody Act 1975", "Harbour Custody Act 1999", "Harbour Custody Act", "Harbour custody act", "HARBOUR CUSTODY ACT", "Forest Code 1975", "Water Rules 1980")]
    g = grams_of(spark.createDataFrame(names, "scope string, name string"))
    got = average_linkage(similar_pairs(g, LEAST), LEAST, g.select(F.concat_ws(" ", "scope", "name").alias("node"), "year"))
    c = {r["node"][2:]: r["cluster"] for r in got.collect()}
    assert c["Harbour Custody Act 1975"] != c["Harbour Custody Act 1999"]
    assert len({c[n] for n in ("Harbour Custody Act", "Harbour custody act", "HARBOUR CUSTODY ACT")} | {c["Harbour Custody Act 1975"]}) == 1


def test_linkage_goes_on_until_no_merge_is_left(spark):
    n = 34  # each pair's similarity is more than the last one's, so that a round merges one pair only
    nodes = [f"n{i:02d}" for i in range(n)]
    pairs = [(a, b, 1 - 0.01 * j) for j, b in enumerate(nodes) for a in nodes[:j]]
    got = average_linkage(spark.createDataFrame(pairs, "a string, b string, s double"), 0.4)
    assert got.select("cluster").distinct().count() == 1


def test_a_name_means_the_title_of_its_group(spark):
    from lexloom.llm.names import Name, link_names, soft_cosine

    known = {"data", "custody", "act", "code", "rules"}
    assert soft_cosine(Name("Dta Cust. Act"), Name("Data Custody Act"), known)[0] == 1.0
    assert soft_cosine(Name("Data Custody"), Name("Data Custody Act"), known)[0] < 0.95
    assert soft_cosine(Name("Data Custody Code"), Name("Data Custody Act"), known)[0] < 0.95
    laws = [("a", "X", "Data Custody Act 1990", None, None), ("b", "X", "Data Custody Act 2001", None, None), ("c", "X", "Harbour Rules 1980", ["PORT LAW"], "Act 7")]
    catalogue = spark.createDataFrame(laws, "id string, scope string, title string, aliases array<string>, number string")
    names = ["Dta Cust. Act '90", "Data Custody Act", "2001 Act on Data Custody", "port law", "H.R. (1980)", "Harbuor Rules", "Harbour Code 1980", "", None]
    mentions = spark.createDataFrame([("X", n) for n in names] * 2 + [("Y", names[0]), (None, names[0])], "scope string, name string")
    got = {(r["name"], r["id"]) for r in link_names(mentions, catalogue).collect()}
    assert got == {("Dta Cust. Act '90", "a"), ("2001 Act on Data Custody", "b"), ("port law", "c"), ("H.R. (1980)", "c"), ("Harbuor Rules", "c")}
    assert link_names(mentions.limit(0), catalogue).count() == 0 and link_names(mentions, catalogue.limit(0)).count() == 0
