import json

import pytest
from pyspark.sql import functions as F

from cardmill.operators.dom import flatten_dom, visible_text
from cardmill.operators.extract import count_cards, extract_cards, listing_frame
from cardmill.operators.selectors import MATCH_COLUMNS, Specs, compile_selectors, control_specs, match_selectors, needed, next_control, selector_report
from cardmill.plans.rate import rate_ranked
from cardmill.plans.scrape import extract_pages, scrape
from cardmill.sources.sites import SITE_SCHEMA, with_defaults
from pages_html import LISTING_SITE, listing


def page_table(spark, *htmls, slug="ferry", **more):
    rows = [(i, f"https://ferry.test/list?leaf={i}", h, slug, i) for i, h in enumerate(htmls, 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, slug string, page_no int")


def sites_of(spark, *docs):
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "d string")
    return with_defaults(df.select(F.from_json("d", SITE_SCHEMA).alias("s")).select("s.*"))


def nodes_of(spark, html, atom_attrs=None):
    carry = ["page_id", "url", "slug", "page_no"]
    return flatten_dom(page_table(spark, html), atom_attrs=atom_attrs, carry=carry)


def tags(spark, html):
    return [(r.tag, r.depth) for r in nodes_of(spark, html).orderBy("node_id").collect()]


def test_implied_end_tags(spark):
    assert tags(spark, "<ul><li>a<li>b<ul><li>c</ul></ul>") == [("ul", 0), ("li", 1), ("li", 1), ("ul", 2), ("li", 3)]
    assert tags(spark, "<div><p>a<p>b<br>c<div>d</div></div>") == [("div", 0), ("p", 1), ("p", 1), ("br", 2), ("div", 1)]
    assert tags(spark, "<table><tr><td>a<td>b<tr><th>c</table>") == [
        ("table", 0), ("tbody", 1), ("tr", 2), ("td", 3), ("td", 3), ("tr", 2), ("th", 3),
    ]
    assert tags(spark, "<table><thead><td>a<tbody><tr><td>b</table>") == [
        ("table", 0), ("thead", 1), ("tr", 2), ("td", 3), ("tbody", 1), ("tr", 2), ("td", 3),
    ]
    assert tags(spark, "<div/><i class='icon'/>x<svg><path/><g/></svg>") == [("div", 0), ("i", 1), ("svg", 2), ("path", 3), ("g", 3)]
    assert tags(spark, "<b>x</i>y</b><img><a>z") == [("b", 0), ("img", 0), ("a", 0)]
    assert tags(spark, "") == []


def test_bad_pages_go_on(spark):
    """Unknown marked sections are comments; whatever the parser fails on ends its page only."""
    assert tags(spark, "<p>a<![foo bar]>b</p><p>c") == [("p", 0), ("p", 0)]
    assert tags(spark, "<p>a<![if !x]><b>b</b><![endif]></p>") == [("p", 0), ("b", 1)]
    assert tags(spark, "<p>a<![CDATA[x]]><i>y</i><![") == [("p", 0), ("i", 1)]


def test_deep_pages_give_output_in_proportion(spark):
    """An element of a deep page is no larger than one of a flat page, and selectors match on both."""
    size = {}
    for n in (200, 20_000):
        page = page_table(spark, "<font class=a>" * n + "<b class=leaf>x")
        nodes = flatten_dom(page, [*MATCH_COLUMNS, "n_leaves", "grand_id"], carry=["page_id", "slug"]).cache()
        row = nodes.agg(F.max("depth").alias("d"), F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
        assert (row.d, row.n) == (n, n + 1)
        size[n] = row["size"] / n
        specs = Specs.of(spark.createDataFrame([("ferry", k, s) for k, s in enumerate(["font > b.leaf", "font font > b", ".a .a", "b b"])], "slug string, rank int, selector string"))
        found = match_selectors(nodes, specs).groupBy("rank").count().collect()
        assert {r["rank"]: r["count"] for r in found} == {0: 1, 1: 1, 2: n - 1}
        nodes.unpersist()
    assert size[20_000] < 1.5 * size[200]


def test_matches_do_not_depend_on_how_many_selectors_there_are(spark):
    html = '<div><img src="x" style="y" data:k="v"><a srcset="z" onclick="f">t</a></div>'
    asked = ["[src=x]", "[style=y]", r'[data\:k="v"]', "a[srcset]", "[onclick=f]"]
    more = [f"div.c{k}" for k in range(300)]
    found = []
    for selectors in (asked, asked + more):
        specs = Specs.of(spark.createDataFrame([("ferry", i, s) for i, s in enumerate(selectors)], "slug string, rank int, selector string"))
        nodes = flatten_dom(page_table(spark, html), MATCH_COLUMNS, carry=["page_id", "slug"], **needed(specs))
        found.append(sorted((r["rank"], r.node_id) for r in match_selectors(nodes, specs).collect()))
    assert found[0] == found[1] == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_text_selectors_need_the_text(spark):
    specs = Specs.of(spark.createDataFrame([("ferry", 0, 'a:text-is("2")')], "slug string, rank int, selector string"))
    with pytest.raises(ValueError):
        match_selectors(flatten_dom(page_table(spark, "<a>1</a><a>2</a>"), MATCH_COLUMNS, carry=["slug"]), specs)


def test_node_columns(spark):
    html = """<html><body><div id=main class="a b a" DATA-X='1' data-x=2><p>one</p><p hidden>two <a href="/x">go</a></p></div></body></html>"""
    rows = {r.node_id: r for r in nodes_of(spark, html).collect()}
    div, p1, p2, a = rows[2], rows[3], rows[4], rows[5]
    assert (div.tag, div.id, div.classes, div.attrs["data-x"]) == ("div", "main", ["a", "b"], "1")
    assert (div.parent_id, div.grand_id, div.subtree_end, div.nth_of_type) == (1, 0, 5, 1)
    assert div.atoms == ["#main", ".a", ".b", "[id]", "[id=main]", "[class]", "[class=a b a]", "[data-x]", "[data-x=1]", ":1"]
    assert (p1.parent_tag, p1.parent_atoms, p1.parent_classes) == ("div", div.atoms, ["a", "b"])
    assert (div.n_leaves, p2.n_leaves, rows[0].parent_tag) == (1, 0, None)  # hidden text is no leaf
    assert (p1.own_text, p2.own_text, p2.nth_of_type, p2.visible, a.visible) == ("one", "two", 2, False, False)
    assert (div.text, p2.text, a.link, div.inner_link, div.link) == ("one", "two go", "/x", "/x", None)


def test_text_breaks_icons_and_hidden_parts(spark):
    html = """<style>.gone{display:none}</style><div>A  b<br>c <p>d</p>e<script>no</script><span style="display: none">no</span>
      <i class=gone>no</i></div><section><i class="fa-pin">place</i> <b>Pune</b></section>"""
    rows = {r.tag: r for r in nodes_of(spark, html).collect()}
    assert rows["div"].text == "A b\nc\nd\ne"
    assert rows["section"].text == "Pune"


SELECTORS = {
    "ul > li": 3, "ul li": 3, "div > li": 0, "div li.x": 2, "li:nth-of-type(2)": 1, "#top": 1, ".x.y": 1, '[data-k="a b"]': 1,
    "[data-k='a b']": 1, "li[data-k]": 2, "*": 9, r".w\:1": 1, r".w\3a 1": 1, 'a:text-is("Two words")': 1, 'a:text-is("Two")': 0,
    "xpath=/html[1]/body[1]/div[1]/ul[1]/li[2]": 1, "body div ul > li a": 1, "div > ul > li": 3, "body > li": 0,
    "li:hover": None, "li + li": None, "li, a": None, "li >": None, "": None, "> li": None, "xpath=//li": None,
}


def test_selectors(spark):
    html = """<html><body><div id="top"><ul><li class="x y" data-k="a b">1<li class="x w:1">2<li data-k="">
              <a>Two  words</a></ul></div><p></p></body></html>"""
    specs = spark.createDataFrame([("ferry", i, s) for i, s in enumerate(SELECTORS)], "slug string, rank int, selector string")
    compiled = Specs.of(specs)
    assert {r.selector for r in compiled.table.collect()} == {s for s, n in SELECTORS.items() if n is not None}
    counts = match_selectors(nodes_of(spark, html), compiled).groupBy("selector").count().collect()
    assert {r["selector"]: r["count"] for r in counts} == {s: n for s, n in SELECTORS.items() if n}


def test_specs_are_compiled_once(spark):
    """What ``Specs.of`` writes is what compiling gives."""
    specs = spark.createDataFrame([("ferry", i, s) for i, s in enumerate(SELECTORS)], "slug string, rank int, selector string")
    local = Specs.of(specs).table.collect()
    assert sorted(map(tuple, compile_selectors(specs).collect()), key=str) == sorted(map(tuple, local), key=str)


def test_descendant_chains_backtrack(spark):
    html = "<div class=a><section><div class=b><div class=a><div class=b><div class=c>x</div></div></div></div></section></div>"
    specs = [".a > .b .c", ".a > .b > .c", ".a .a > .b > .c", ".b > .b", "section > .a", ".a section .a .c", ".c .c"]
    df = spark.createDataFrame([("ferry", i, s) for i, s in enumerate(specs)], "slug string, rank int, selector string")
    hits = match_selectors(nodes_of(spark, html), Specs.of(df)).groupBy("rank").count().collect()
    assert {r["rank"] for r in hits} == {0, 1, 2, 5}


def test_extract_rules(spark):
    html = """<html><head><base href="/deep/"></head><body data-co="Ferry"><a href="wrap"><ul><li data-id="7" class="c">
      <h2></h2><h3>Dev</h3><span><a href="in?x=1">go</a></span><em class="z">z1</em><div><em>z2</em></div></li></ul></a>
      <ul><li class="c" hidden><h3>Hidden</h3></li><li class="c"><h3>No id</h3></li><li class="c"><p>no title</p></li></ul></body></html>"""
    site = {
        "name": "Ferry", "slug": "ferry", "start_url": "x",
        "dom": {
            "card": {"candidates": ["li.none", "li.c", "li"]},
            "fields": {
                "title": {"selectors": ["h9", "h3", "h2"]},
                "location": {"selectors": ["h2", "h3"]},
                "apply_url": {"selectors": ["h3"], "attr": "href"},
                "job_id": {"selectors": [], "attr": "data-id"},
                "company": {"selectors": ["nope", "body"], "closest": True, "attr": "data-co"},
                "direct": {"selectors": [":scope > em"]},
                "any": {"selectors": [":scope em"]},
                "inner": {"selectors": ["span"], "attr": "href"},
            },
            "apply_url_template": "https://t/{job_id}",
        },
    }
    rows = extract_cards(nodes_of(spark, html), sites_of(spark, site)).orderBy("pos").collect()
    assert [r.title for r in rows] == ["Dev", "No id"]
    first = rows[0]
    assert first.location is None  # h2 matches but is empty, h3 is not tried
    assert first.apply_url == "https://ferry.test/deep/wrap"
    assert (first.job_id, first.company) == ("7", "Ferry")
    assert first.extras == {"direct": "z1", "any": "z1", "inner": "https://ferry.test/deep/wrap"}
    assert rows[1].apply_url is None and rows[1].extras == {}
    counted = count_cards(nodes_of(spark, html), sites_of(spark, site), page_table(spark, html)).first()
    assert counted.n_cards == 4


def test_template_fills_missing_links(spark):
    html = "<ul><li data-id=5><b>A</b></li><li><b>B</b></li></ul>"
    site = {"name": "Ferry", "slug": "ferry", "start_url": "x", "dom": {"card": {"candidates": ["li"]},
            "fields": {"title": {"selectors": ["b"]}, "job_id": {"selectors": [], "attr": "data-id"}}, "apply_url_template": "https://t/{job_id}"}}
    rows = extract_pages(page_table(spark, html), sites_of(spark, site)).orderBy("pos").collect()
    assert [(r.title, r.apply_url) for r in rows] == [("A", "https://t/5"), ("B", None)]


def test_nested_cards_and_large_page(spark):
    """A page with very many cards, and cards inside cards, give every row."""
    html = "<div class=c><b>outer</b>" + "".join(f"<div class=c><b>t{i}</b></div>" for i in range(3000)) + "</div>"
    site = {"name": "Ferry", "slug": "ferry", "start_url": "x", "dom": {"card": {"candidates": ["div.c"]}, "fields": {"title": {"selectors": ["b"]}}}}
    rows = extract_pages(page_table(spark, html, "<p>none</p>"), sites_of(spark, site)).select("title").collect()
    assert sorted(r.title for r in rows) == sorted(["outer"] + [f"t{i}" for i in range(3000)])


def test_next_control_and_report(spark):
    sites = sites_of(spark, LISTING_SITE)
    pages = page_table(spark, listing(1, 2), listing(2, 2), "<p>empty</p>")
    nodes = flatten_dom(pages, carry=["page_id", "url", "slug", "page_no"]).cache()
    specs = control_specs(sites)
    assert [r.page_id for r in next_control(nodes, specs).collect()] == [1]
    report = {r.page_id: r.report for r in selector_report(nodes, pages, specs).collect()}
    assert report == {1: "button.onward → 1 match, visible", 2: "button.onward → 1 match, visible, disabled", 3: "button.onward → 0 matches"}
    numbered = dict(LISTING_SITE, pagination={"type": "page_number", "page_number_template": 'button[name="turn"]:text-is("{page}")'})
    assert [r.page_id for r in next_control(nodes, control_specs(sites_of(spark, numbered))).collect()] == [1]


def test_scrape_three_pages(spark):
    pages = page_table(spark, listing(1, 3), listing(2, 3), listing(3, 3), listing(3, 3)).withColumn("status", F.lit(200))
    blocked = page_table(spark, "<title>Just a moment...</title>", slug="beta").withColumns({"status": F.lit(403), "page_id": F.lit(99)})
    beta = dict(LISTING_SITE, name="Beta", slug="beta")
    run = scrape(pages.unionByName(blocked), sites_of(spark, LISTING_SITE, beta), "r1")
    assert run.raw.count() == 25 and run.ranked.count() == 25
    first = run.ranked.first()
    assert (first.title, first.company, first.location) == ("Tide Engineer 0", "Ferry", "Ghent, Belgium")
    status = {r.slug: (r.status, r.n_jobs, r.pages, r.error) for r in run.runs.collect()}
    # page 3 has no enabled control, so page 4 is never reached
    assert status == {"ferry": ("ok", 25, 3, None), "beta": ("blocked", 0, 0, "challenge page (just a moment...)")}
    two = scrape(pages, sites_of(spark, LISTING_SITE), "r2", max_pages=2)
    assert two.raw.count() == 20


def test_rate_ranked_rates_the_best_rows(spark):
    pages = page_table(spark, listing(1, 2)).withColumn("status", F.lit(200))
    ranked = scrape(pages, sites_of(spark, LISTING_SITE), "r1").ranked
    rated = rate_ranked(ranked, lambda prompts: ['{"fit": "Maybe", "score": 4, "reason": "r"}' for _ in prompts], limit=3).collect()
    assert [(r.title, r.ai_score) for r in rated[:4]] == [("Tide Engineer 0", 4), ("Tide Engineer 1", 4), ("Tide Engineer 2", 4), ("Tide Engineer 3", None)]
    assert len(rated) == 10 and rate_ranked(ranked, None) is ranked


def test_listing_frame(spark):
    rows = [("v", 0, "https://main"), ("v", 1, "https://ads"), ("v", 2, "https://embed/ferry"), ("v", 3, "https://embed/ferry2"),
            ("w", 0, "https://main"), ("w", 1, "https://ads")]
    df = spark.createDataFrame(rows, "view_id string, frame_no int, frame_url string")
    pick = lambda m: {r.view_id: r.frame_no for r in listing_frame(df, F.lit(m).cast("string")).collect()}
    assert pick("embed/") == {"v": 2, "w": 0} and pick(None) == {"v": 0, "w": 0}


def test_visible_text(evaluate):
    assert evaluate(visible_text, [(" a\n\tb ",)]) == ["a b"]
