"""Access rules, workbooks, catalogues by byte ranges, retrievers and readers."""

import json
import zipfile

import pytest

from lexloom.functions import plugins as P
from lexloom.sources.files import CatalogueSource, decide, read_workbooks, robots_rules

FILE = """# rules
User-agent: goodbot
User-agent: otherbot
Disallow: /private
Allow: /private/open

User-agent: *
Disallow: /
Allow: /*.pdf$
Disallow: /a/*/c
Crawl-delay: 3
"""


def decisions(spark, agent, paths, body=FILE):
    files = spark.createDataFrame([("h.example", body)], "host string, body string")
    pages = spark.createDataFrame([(f"https://h.example{p}",) for p in paths] + [("https://unread.example/x",), ("https://agreed.example/x",)], "url string")
    out = decide(pages, robots_rules(files), files.select("host"), spark.createDataFrame([("agreed.example",)], "host string"), agent).collect()
    return {r["url"].replace("https://h.example", ""): (r["allowed"], r["reason"]) for r in out}


def test_most_specific_agent_longest_pattern_and_ties(spark):
    got = decisions(spark, "GoodBot/2.0", ["/", "/private/x", "/private/open/y", "/x.pdf"])
    assert got["/"] == (True, "") and got["/private/x"] == (False, "disallowed") and got["/private/open/y"] == (True, "") and got["/x.pdf"] == (True, "")
    got = decisions(spark, "stranger/1", ["/", "/x.pdf", "/x.pdf?v=1", "/a/b/c", "/a/c"])
    assert [got[p][0] for p in ("/", "/x.pdf", "/x.pdf?v=1", "/a/b/c")] == [False, True, False, False]
    assert got["https://unread.example/x"] == (False, "unreadable") and got["https://agreed.example/x"] == (True, "exception")
    tie = decisions(spark, "x", ["/same"], "User-agent: *\nDisallow: /same\nAllow: /same\n")
    assert tie["/same"] == (True, "")
    assert decisions(spark, "x", ["/y"], "User-agent: *\nDisallow:\n")["/y"] == (True, "")
    assert decisions(spark, "x", ["/y"], "User-agent: otherbot\nDisallow: /\n")["/y"] == (True, "")
    dollar = decisions(spark, "x", ["/a$b", "/a$bc"], "User-agent: *\nDisallow: /a$b$\n")
    assert dollar["/a$b"][0] is False and dollar["/a$bc"][0] is True


def test_workbooks(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Key" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Act</t></si><si><r><t>Sec</t></r><r><t>tion</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="AA3"><v>4.5</v></c><c r="AB3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    rows = {(r["sheet"], r["row"]): r["cells"] for r in read_workbooks(spark, str(tmp_path)).collect()}
    assert rows[("Key", 1)] == ["Act", None, "Section"] and rows[("Key", 3)] == [None] * 26 + ["4.5", "x"] and rows[(None, None)] is None


def test_catalogue_pages_read_their_own_bytes(spark, tmp_path):
    path = tmp_path / "laws.jsonl"
    path.write_text("".join(json.dumps({"id": str(i), "title": "Закон " * (i % 7), "url": "u"}, ensure_ascii=False) + "\n" + "\n" * (i % 3 == 0) for i in range(500)), encoding="utf-8")
    spark.dataSource.register(CatalogueSource)
    for size in ("97", "1000", "10000000"):
        got = [r["id"] for r in spark.read.format("catalogue").option("path", str(path)).option("page_bytes", size).load().collect()]
        assert sorted(map(int, got)) == list(range(500))


def test_retrievers_fall_back(spark):
    assert P.choose_retriever("auto")[0] == "hybrid" and P.choose_retriever("graph")[0] == "hybrid" and P.choose_retriever("semantic")[0] == "semantic"
    assert P.choose_retriever("auto", lambda n: n != "hybrid")[0] == "keyword"
    with pytest.raises(LookupError):
        P.choose_retriever("auto", lambda n: False)
    assert P.availability({"a": ["k"], "b": []}, {"k": " "}) == {"a": False, "b": True}


def test_readers_fail_by_row(spark):
    P.OCR_ENGINES["picky"] = lambda t: [(t, 1.0)] if t != "bad" else 1 / 0
    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id int, t string")
    got = {r["id"]: (r["page"], r["failed"]) for r in P.read_pages(df, "id", "t", "picky").collect()}
    assert got == {1: (1, False), 2: (None, True)}
    assert P.read_pages(df.limit(0), "id", "t").count() == 0
