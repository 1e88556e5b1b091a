import re
from urllib.parse import parse_qsl, urljoin, urlparse

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardmill import fixed
from cardmill.functions import urls
from cardmill.operators.frontier import id_url_template, page_frontier
from cardmill.sources.sites import SITE_SCHEMA, with_defaults

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
query_text = st.text("ab=&+%20*~é/ ", max_size=14).map(lambda q: q.replace("%", "%2") if q.endswith("%") else q)
made_urls = st.builds(
    lambda s, h, p, q, f: f"{s}://{h}{p}" + (f"?{q}" if q else "") + (f"#{f}" if f else ""),
    st.sampled_from(["http", "https", "HTTPS"]),
    st.sampled_from(["x.com", "X.com:8080", "a.b"]),
    st.sampled_from(["", "/", "/jobs", "/jobs/", "/a/;v=1", "/a;v/b//", "/2/page/3"]),
    st.one_of(query_text, st.sampled_from(["utm_source=a&b=1", "ref=1", "REF=1&Src=2&x", "trkid=1&y=%zz&a+b=c%2Fd", "page=2&q="])),
    st.sampled_from(["", "top"]),
)


def test_canonical_url(evaluate):
    cases = {
        "https://Ex.test/a/b/?utm_source=n&k=1&ref=z#part": "https://Ex.test/a/b?k=1",
        "HTTP://ex.test": "http://ex.test/",
        "https://ex.test//": "https://ex.test/",
        "https://ex.test/p;v=2/?b=2&a=1&b=": "https://ex.test/p;v=2?b=2&a=1&b=",
        "https://ex.test/?q=a+b%20c&trk=9": "https://ex.test/?q=a+b+c",
        "https://ex.test/s?UTM_medium=x&page=3": "https://ex.test/s?page=3",
        "https://ex.test/s?x=%C3%A9": "https://ex.test/s?x=%C3%A9",
    }
    assert evaluate(urls.canonical_url, [(u,) for u in cases]) == list(cases.values())


@few
@given(st.lists(made_urls, min_size=1, max_size=40))
def test_canonical_url_properties(evaluate, values):
    """Stable when repeated, without fragment and tracking names, other parameters in their order."""
    once = evaluate(urls.canonical_url, [(v,) for v in values])
    assert evaluate(urls.canonical_url, [(v,) for v in once]) == once
    for before, after in zip(values, once, strict=True):
        assert "#" not in after and not after.split("?")[0].endswith("//")
        names = [k for k, _ in parse_qsl(urlparse(after).query, keep_blank_values=True)]
        assert not any(re.match(fixed.TRACKING_PARAMS, k, re.I) for k in names)
        rest = iter(k for k, _ in parse_qsl(urlparse(before.strip()).query, keep_blank_values=True))
        assert all(k in rest for k in names)


def test_canonical_url_passes_through(evaluate):
    rows = [("/relative",), (" x ",), ("",), (None,), ("mailto:a@b",)]
    assert evaluate(urls.canonical_url, rows) == ["/relative", "x", None, None, "mailto:a@b"]


def test_absolute_url_like_a_browser(evaluate):
    base = "http://Ex.com:80/a/b/c.html?x=1#f"
    cases = {
        "/für": "http://ex.com/f%C3%BCr",
        "../x y?q=ü z": "http://ex.com/a/x%20y?q=%C3%BC%20z",
        "?p=2": "http://ex.com/a/b/c.html?p=2",
        "#top": "http://ex.com/a/b/c.html?x=1#top",
        "//O.org/a/../b": "http://o.org/b",
        "https://Q.com": "https://q.com/",
        "mailto:x@y": "mailto:x@y",
        "d/./e/..": "http://ex.com/a/b/d/",
        "": None,
        "x\\y": "http://ex.com/a/b/x/y",
        "/../../up": "http://ex.com/up",
    }
    assert evaluate(urls.absolute_url, [(h, base) for h in cases]) == list(cases.values())


@few
@given(st.lists(st.sampled_from(["a", "/a/b", "../c", "./d/", "?q=1", "x/../y", "..", "../../..", "a/./b?c#d", "//h.com/z"]), min_size=1))
def test_absolute_url_agrees_with_urljoin(evaluate, hrefs):
    base = "https://x.com/one/two/three"
    assert evaluate(urls.absolute_url, [(h, base) for h in hrefs]) == [urljoin(base, h) for h in hrefs]


def test_fill_template(spark):
    df = spark.createDataFrame(
        [("https://x.com/{job_id}/{t}", {"job_id": "9", "t": "{job_id}"}), ("https://x.com/{job_id}", {"job_id": ""}), ("plain", {})],
        "t string, row map<string,string>",
    )
    got = [r[0] for r in df.select(urls.fill_template(F.col("t"), F.col("row"))).collect()]
    assert got == ["https://x.com/9/{job_id}", None, "plain"]


words = st.lists(st.from_regex(r"[a-z]{2,6}", fullmatch=True), min_size=1, max_size=3)


@few
@given(st.lists(st.tuples(words, st.sampled_from(["s?k={}", "s?x=1&k={}", "s?k={}&k=again", "s?k={}&empty=", "in/{}", "in/{}/all?k=0#top"])), min_size=1, max_size=20))
def test_query_url_template_gives_back_the_url(evaluate, cases):
    """Filling a learned template with the query gives the url that it was learned from, without its fragment."""
    queries = [" ".join(w) for w, _ in cases]
    joined = ["+".join(w) if "k={}" in shape else "-".join(w) for w, shape in cases]
    visited = ["https://h.test/" + shape.format(w) for w, (_, shape) in zip(joined, cases, strict=True)]
    templates = evaluate(urls.query_url_template, list(zip(visited, queries, strict=True)))
    for url, text, template in zip(visited, joined, templates, strict=True):
        assert template is not None and template.count("{query}") == 1 and "#" not in template
        assert template.replace("{query}", text) == url.partition("#")[0]


def test_query_url_template_needs_the_query(evaluate):
    rows = [("https://h.test/find", "Deck Hand"), ("https://h.test/find?k=", "Deck Hand"), ("https://h.test/?k=a", ""), ("https://h.test/?k=a", None), (None, "a")]
    assert evaluate(urls.query_url_template, rows) == [None] * 5


@few
@given(st.lists(st.tuples(st.sampled_from(["page", "p", "pg"]), st.sampled_from(["", "q=a&", "q=&q=b&"])), min_size=1, max_size=20))
def test_page_url_template_counts_on(evaluate, cases):
    """The second page of a learned template is the url that was visited second."""
    steps = [(f"https://h.test/l?{rest}".rstrip("?&"), f"https://h.test/l?{rest}{name}=2") for name, rest in cases]
    for (_, second), template in zip(steps, evaluate(urls.page_url_template, steps), strict=True):
        assert template is not None and template.replace("{page}", "2") == second


def test_page_url_template_needs_one_step(evaluate):
    rows = [("https://h.test/l", "https://h.test/l"), ("https://h.test/l", "https://o.test/l?page=2"), ("", "https://h.test/?page=2"), ("https://h.test/l", None)]
    assert evaluate(urls.page_url_template, rows) == [None] * 4
    # offsets count rows, and a path may count as well
    assert evaluate(urls.page_url_template, [("https://h.test/l?offset=30", "https://h.test/l?offset=60"), ("https://h.test/l/", "https://h.test/l/page/2")]) == [
        "https://h.test/l?offset={offset}", "https://h.test/l/page/{page}"]


def test_id_url_template(spark):
    details = spark.createDataFrame(
        [(1, "https://ex.test/show?berth=83114#map"), (2, "https://ex.test/b/qz-77/plan"), (3, "https://ex.test/64")], "page_id int, detail_url string"
    )
    rows = [(1, 0, "class", "berth"), (1, 1, "data-no", "83114"), (1, 2, "data-href", "berth=83114"), (2, 0, "data-no", "qz-77"), (3, 0, "data-no", "64")]
    attrs = spark.createDataFrame(rows, "page_id int, ord int, attr string, value string").withColumn("selectors", F.array().cast("array<string>"))
    got = {r.page_id: (r.template, r.attr) for r in id_url_template(details, attrs).collect()}
    # the longest value is tried first; two characters are too few
    assert got == {1: ("https://ex.test/show?{job_id}", "data-href"), 2: ("https://ex.test/b/{job_id}/plan", "data-no")}


def test_search_url_and_frontier(spark):
    doc = """{"name":"A","slug":"a","start_url":"https://a.com/","dom":{"card":{"candidates":["li"]},"fields":{}},
      "search":{"query":"c++ dev","results_url":"https://a.com/s?q={query}"},
      "pagination":{"type":"next","url_template":"https://a.com/s?page={page}","max_pages":3}}"""
    other = """{"name":"B","slug":"b","start_url":"https://b.com/","dom":{"card":{"candidates":["li"]},"fields":{}},
      "pagination":{"type":"page_number","url_template":"https://b.com/?s={offset}"}}"""
    df = spark.createDataFrame([(doc,), (other,)], "d string").select(F.from_json("d", SITE_SCHEMA).alias("s")).select("s.*")
    sites = with_defaults(df)
    got = {(r.slug, r.page_no): r.url for r in page_frontier(sites).collect()}
    assert got == {
        ("a", 1): "https://a.com/s?q=c%2B%2B+dev", ("a", 2): "https://a.com/s?page=2", ("a", 3): "https://a.com/s?page=3",
        ("b", 1): "https://b.com/",
    }
    assert page_frontier(sites, max_pages=1).count() == 2
