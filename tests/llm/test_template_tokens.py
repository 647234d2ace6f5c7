from lexloom.llm.markup import html_tokens, nest, page_parts, parse, parse_html, templates

STOCK = "This notice is given to all readers of the register under the rules of the office that keeps it"  # over 80 characters


def test_texts_of_one_opening_are_different_tokens():
    a, b = (set(html_tokens(f"<body><p>{STOCK}{end}</p></body>")) for end in (".", ", and section 5 is repealed."))
    assert len(a ^ b) == 2


def test_content_that_begins_like_a_template_text_stays():
    page = f"<body><ul><li>{STOCK}, and section 5 is repealed.</li></ul></body>"
    template = {t for t in html_tokens(f"<body><ul><li>{STOCK}.</li></ul></body>") if STOCK[:80] in t}
    assert template and [k for k, _, _ in parse_html(page, template)] == ["list_item"]
    assert parse_html(f"<body><ul><li>{STOCK}.</li></ul></body>", template) == []


def test_long_stock_text_with_a_link_is_still_known():
    page = f"<body><p>{STOCK}, <a href='x'>see</a> below.</p></body>"
    assert parse_html(page, set(html_tokens(page))) == []


PAGES = "fetch_id long, url string, final_url string, html string, body binary, content_type string"


def fetched(spark, pages):
    return spark.createDataFrame([(i, f"https://d.example/{i}", None, t, None, "text/html") for i, t in enumerate(pages)], PAGES)


def test_template_of_plain_blocks_that_varies_from_page_to_page(spark):
    """No element or role tells that the menu is the site's own, its entries come as often as a page has sections, and its foot differs by page."""

    def page(i):
        menu = "".join(f"<div class=m><ul><li>Laws</li><li>Courts</li></ul>{'<b>*</b>' * (i % 3)}</div>" for _ in range(1 + i % 2))
        foot = "<div><ul><li>Imprint</li><li>Contact</li></ul></div>" if i % 3 else "<div><p>Old site</p><h4>Links</h4></div>"
        return f"<html><body>{menu}<h1>Law {i}</h1><ul><li>rule {i}</li><li>Courts</li></ul>{foot}</body></html>"

    got = page_parts(fetched(spark, [page(i) for i in range(150)])).collect()
    assert len(got) == 150
    for r in got:
        shown = [(p["kind"], p["text"]) for p in r["parts"]]
        assert ("heading", f"Law {r['fetch_id']}") in shown and ("list_item", f"rule {r['fetch_id']}") in shown
        assert not {"Laws", "Imprint", "Contact", "Links", "Old site"} & {t for _, t in shown}


def test_content_that_versions_of_one_law_share_is_no_template(spark):
    hot = lambda i: f"<html><head><title>Hot Act</title></head><body><div><ul><li>Start</li><li>Search</li></ul></div><h1>Hot Act</h1><h2>Fees</h2><ul><li>first duty</li><li>second duty</li></ul><p>as of day {i}</p></body></html>"
    other = lambda i: f"<html><head><title>Act {i}</title></head><body><div><ul><li>Start</li><li>Search</li></ul></div><h1>Act {i}</h1><p>text {i}</p></body></html>"
    rows = fetched(spark, [hot(i) for i in range(40)] + [other(i) for i in range(150)])
    for r in page_parts(rows).collect():
        texts = [p["text"] for p in r["parts"]]
        assert "Start" not in texts and "Search" not in texts
        assert ("first duty" in texts and "Fees" in texts) == (r["fetch_id"] < 40)
    assert templates(rows).count() == 1


def test_classes_nest():
    A, B = 1, 2  # classes; A is around B
    whole = nest([(0, 10, A), (1, 20, B), (2, 21, B), (3, 11, A)])
    assert [whole[c][1] for c in (A, B)] == [True, True] and whole[B][2:4] == (A, 1) and whole[A][2:4] == (0, 0) and whole[B][4] == [1, 2]
    crossing = nest([(0, 10, A), (1, 20, B), (2, 11, A), (3, 21, B)])
    assert crossing[A][1] and not crossing[B][1]
    assert not nest([(0, 10, A), (1, 11, A), (2, 11, A), (3, 10, A)])[A][1]  # no one order
    assert nest([(0, 10, A), (1, 11, A), (2, 10, A), (3, 11, A)])[A][1]
    assert not nest([(0, 20, B), (1, 21, B), (2, 10, A), (3, 20, B), (4, 21, B), (5, 11, A)])[B][1]  # once within A, once outside


def test_small_hosts_leave_out_site_elements(spark):
    got = page_parts(fetched(spark, ["<body><nav><ul><li>Home</li></ul></nav><h1>Act</h1></body>"])).first()
    assert [p["kind"] for p in got["parts"]] == ["heading"]


def test_tags_of_any_length_and_depth_go():
    long = f"a <span title='{'x' * 200}'>b</span> c"
    assert parse(f"# T\n\n{long}\n")[1][1][2] == "a b c"
    wiki = "== T ==\nx {{a|{{b|{{c|{{d|{{e}}}}}}}}}} y"
    assert parse(wiki)[1][1][2] == "x y"
    assert "}" not in parse("\\section{T}\nx \\a{\\b{\\c{\\d{\\e{y}}}}} z")[1][1][2]
