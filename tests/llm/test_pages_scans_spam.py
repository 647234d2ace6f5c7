import pytest

from lexloom.llm.markup import decode, formulas, page_parts, parse, sniff, templates
from lexloom.llm.scans import line_findings, paragraphs
from lexloom.llm.spam import page_shapes, spam_pages


def kinds(text):
    return [k for k, _, _ in parse(text)[1] if k != "text"]


HTML = """<html><head><title>t</title><!-- <h2>no</h2> --><script>"<li>no</li>"</script></head><body><nav><ul><li>Home</li></ul></nav>
<h1>A <code>b</code></h1><div role="heading" aria-level="2">B</div><ul><li>one<ul><li>two</li></ul></li><li>three</ul>
<pre><code>* no\n<h2>&lt;li&gt;</code></pre><p>$x_1$ costs $5 to $70, \\[y\\]</p><math><mi>z</mi></math><footer><h4>Map</h4></footer></body></html>"""
MD = "# A #\n\nB\n---\n\n- one\n  * two\n1) three\n\n```\n# no\n- no\n```\n\n$$\nx\n$$\n\n`$no$` and $y$ at \\$5\n\n| a | b |\n|---|---|\n| c | d |\n"
WIKI = "== A ==\n=== B ===\n* one\n** two\n# three\n<syntaxhighlight lang=\"x\">\n== no ==\n* no\n</syntaxhighlight>\n: <math>x</math>\n{|\n|-\n| a || 1\n|}\nSee <math>y</math>.<ref>n</ref>"
TEX = "\\documentclass{a}\n\\begin{document}\n\\section{A $q$}\n\\paragraph*{B}\n\\begin{itemize}\\item one\n\\begin{enumerate}\\item two\\end{enumerate}\\item[--] three\\end{itemize}\n% \\item no\n\\begin{verbatim}\n\\item no $no$\n\\end{verbatim}\n\\begin{align*}x\\end{align*} and \\(y\\) for \\$5.\n\\end{document}\\item no"


@pytest.mark.parametrize(
    "text,kind,want",
    [
        (HTML, "html", {"heading": 2, "list_item": 3, "code": 1, "formula": 3}), (MD, "markdown", {"heading": 2, "list_item": 3, "code": 1, "formula": 2}),
        (WIKI, "wiki", {"heading": 2, "list_item": 3, "code": 1, "formula": 2}), (TEX, "latex", {"heading": 2, "list_item": 3, "code": 1, "formula": 3}),
        ("Plain. Fees run from $5 to $70, a < b and c > d.\n[1] note*", "plain", {}), ("", "plain", {}), (None, "plain", {}),
    ],
)
def test_elements(text, kind, want):
    assert parse(text)[0] == kind
    have = {}
    for k in kinds(text):
        have[k] = have.get(k, 0) + 1
    assert have == want


def test_escaped_page_and_bad_markup():
    import html

    assert sniff(html.escape(HTML))[0] == "html" and kinds(html.escape(HTML)) == kinds(HTML)
    assert kinds("<h2>never closed<p>x</b></i><li>") == ["heading", "list_item"]
    assert formulas("$ 5 and 6 $") == [] and formulas("\\(a\\) $b$") == ["a", "b"]


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "cp1251"])
def test_decode(name):
    text = "Закон о связи и хранении сведений"
    assert decode(text.encode(name), "text/html; charset=ISO-8859-1") == text
    assert decode(None, None) is None and decode(b"", None) == ""


PAGES = "fetch_id long, url string, final_url string, html string, body binary, content_type string, kind string"


def test_template_of_a_host_is_left_out(spark):
    page = lambda i: f'<html><body><div class="top"><ul><li>Start</li><li>Search</li></ul></div><h1>Law {i}</h1><ul><li>{"same" if i % 2 else "other"} {i % 3}</li></ul><div><p>Imprint</p></div></body></html>'
    rows = [(i, f"https://a.example/{i}", None, page(i), None, "text/html", "x") for i in range(12)] + [(99, None, None, None, None, None, None), (98, "u", None, None, b"", None, None), (97, "https://b.example", None, page(1), None, None, None)]
    df = spark.createDataFrame(rows, PAGES)
    got = {r["fetch_id"]: r for r in page_parts(df).collect()}
    assert len(got) == len(rows)
    assert all([p["kind"] for p in got[i]["parts"]].count("list_item") == 1 for i in range(12))
    assert all("Start" not in got[i]["clean"] and "Imprint" not in got[i]["clean"] and f"# Law {i}" in got[i]["clean"] for i in range(12))
    assert [p["kind"] for p in got[97]["parts"]].count("list_item") == 3  # one page is no template
    assert got[99]["markup"] == "plain" and got[98]["parts"] == []
    assert page_parts(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "https://c.example/x", None, page(1), None, None, None) for i in range(9)], PAGES)
    assert templates(copies).count() == 0


BODY = ["The licensed carrier must keep the register of permits in the ter-", "ritory of the state. A sub-", "section of the law may exempt cross-border flows from it.", "The office must keep the register of permits in the territory and the", "carrier may keep cross-border flows in the sub-section register of it."]
OCR = "ocr_id long, text string, pages array<struct<page: int, text: string, confidence: double>>, page int"


def scan_rows():
    page = lambda n, body: {"page": n, "text": "\n".join(["Relay Storage Act 1975", "", *body, f"- {n} -"]), "confidence": None}
    clean = [{"page": 1, "text": "\n".join(BODY[3:] * 3), "confidence": 0.9}]
    return [(1, "", [page(1, BODY), page(2, BODY[3:] + ["The licensed carrier rnust keep the rcgister of permits at 24/7 in 1A(3)."]), page(3, BODY), {"page": 4, "text": None, "confidence": 0.1}], 7), *[(i, None, clean, 7) for i in range(2, 8)], (20, None, None, 7), (21, "", [], 7), (None, "Some text.", None, 7)]


def test_scans(spark):
    df = spark.createDataFrame(scan_rows(), OCR)
    got = {tuple(r) for r in line_findings(df, "ocr_id").collect()}
    one = {r[1:] for r in got if r[0] == 1}
    assert {(p, 1, "header") for p in (1, 2, 3)} <= one and {(1, 8, "page_no"), (2, 6, "page_no"), (3, 8, "page_no")} <= one
    assert {(1, 3, "hyphen"), (3, 3, "hyphen")} <= one and not {x for x in one if x[2] == "hyphen"} - {(1, 3, "hyphen"), (3, 3, "hyphen")}
    assert (2, 5, "misread") in one and len([x for x in one if x[2] == "misread"]) == 1
    assert not [r for r in got if r[0] != 1]
    text = " ".join(r["text"] for r in paragraphs(df, "ocr_id").where("ocr_id = 1").orderBy("paragraph").collect())
    assert "territory of the state" in text and "must keep the register" in text and "Storage Act" not in text and "- 2 -" not in text
    assert line_findings(df.limit(0), "ocr_id").count() == 0


SPAM = [
    "\n".join(f"tag: {w}" for w in ["cheap", "law", "fast", "pdf"] * 12), " ".join(["audit cheap law online free pdf"] * 20), "\n".join(f"http://a{i}.example/x-{i}" for i in range(20)),
    "\n".join(f"[best] https://b{i}.example/q?id={i}" for i in range(15)), "\n".join(f"desk lamp red sku {i} $12.{i}" for i in range(10, 30)),
    "\n".join(["Looking for lawyer pdf in Taldane?", "Our lawyer pdf team in Taldane offers lawyer pdf and audit.", "Why choose lawyer pdf? Because lawyer pdf in Taldane means server."] * 4),
]
REAL = [
    "Act 1990\n" + "\n".join(f"{i}. {'Fees' if i % 2 else 'Notice of breach'} ........ {i}" for i in range(1, 30)), "Index\n" + "\n".join(f"{w} of the register, {i}, {i + 40}" for i, w in enumerate("abcdefgh")),
    "\n".join(f"{i}/1999 | the carrier | Norvale | within {i} days" for i in range(100, 120)), "\n".join(f"({i}) A person who contravenes section {i} is liable to a fine." for i in range(1, 20)),
    "The office must keep the register. A carrier may appeal to the Tribunal within ten days, unless a court directs otherwise. See https://a.example/x for forms.", "", None, "x",
]


def test_spam(spark):
    assert all(page_shapes(t)[0] > 0.5 for t in SPAM) and all(page_shapes(t)[0] <= 0.5 for t in REAL)
    rows = [(i, t, 1.0) for i, t in enumerate(SPAM + REAL)] + [(None, SPAM[0], 0.0), (0, SPAM[0], 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, share double")
    assert sorted(str(r["doc_id"]) for r in spam_pages(df, "doc_id", "text").collect()) == sorted([*map(str, range(len(SPAM))), "0", "None"])
    assert spam_pages(df.limit(0), "doc_id", "text").count() == 0


def test_shapes_are_judged_by_the_company_they_keep(spark):
    """Short capitalised lines without an end are headings beside sentences, and spam where pages hold nothing else."""
    from lexloom.llm.spam import shape_groups, shape_pages

    said = ["Fees payable", "Fees due", "Fees waived", "Fees late"]
    rules = ["The office must keep the register of permits in the territory.", "Every carrier may appeal to the Tribunal within ten days.", "Nobody shall copy sealed archives unless a court so directs.", "Data custodians tell their depositors about every transfer abroad."]
    head = lambda i: "\n".join(f"{h}\n{r}" for h, r in zip(said, rules[i % 4 :] + rules[: i % 4]))
    tags = lambda i: " | ".join(f"cheap {w} fast" for w in ["law", "pdf", "form", "audit"] * 8)
    df = spark.createDataFrame([(i, head(i)) for i in range(20)] + [(100 + i, tags(i)) for i in range(5)], "doc_id long, text string")
    groups = {(r["form"], r["shape"]): r["company"] for r in shape_groups(shape_pages(df, "doc_id", "text")).collect()}
    assert any(f == "keyword" and c > 0.7 for (f, _), c in groups.items()) and any(f == "keyword" and c == 0.0 for (f, _), c in groups.items())
    assert {r["doc_id"] for r in spam_pages(df, "doc_id", "text").collect()} == {100 + i for i in range(5)}
    assert spam_pages(df, "doc_id", "text", company=0.0).count() == 0  # no shape is in worse company
