import pytest
from pyspark.sql import functions as F

from cardmill.functions import elements
from cardmill.operators import infer
from cardmill.plans import onboard
from cardmill.plans.scrape import extract_pages, scrape
from cardmill.sources.sites import read_site_configs, write_site_configs
from pages_html import BERTHS, ICONS, NO_LINKS, ROLES, TABLE, listing


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://t.com/list", TABLE), (2, "https://i.com/list", ICONS), (3, "https://n.com/list", NO_LINKS),
            (4, "https://l.com/list", listing(1, 3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({"slug": F.concat(F.lit("s"), "page_id"), "name": F.concat(F.lit("Site "), "page_id")})


@pytest.fixture(scope="module")
def nodes(pages):
    return infer.prepare_nodes(pages)


@pytest.fixture(scope="module")
def targets(nodes):
    second = F.sort_array(F.collect_list("node_id"))[1]
    titles = nodes.filter("(page_id in (1, 4) and tag = 'a') or tag in ('h4', 'dt')")
    return titles.groupBy("page_id").agg(second.alias("node_id")).withColumn("target_id", F.lit(0))


@pytest.fixture(scope="module")
def learned(nodes, targets):
    cards, members = infer.infer_cards(nodes, targets)
    fields = infer.infer_fields(nodes, cards, members)
    return cards, members, {r.page_id: r.fields for r in fields.collect()}


def test_cards(learned):
    cards, members, _ = learned
    got = {r.page_id: (r["count"], r.candidates) for r in cards.collect()}
    assert got == {
        1: (6, ["tbody > tr", "tr", "table tbody > tr"]),
        2: (3, ["div.board > article", "article", "main div.board > article"]),
        3: (4, ["dl > div", "div", "body dl > div"]),
        4: (10, ["div.openings > section.opening", "section.opening", "body div.openings > section.opening"]),
    }
    assert members.count() == 23


def test_large_groups_are_learned_whole(spark):
    """Neither the number of cards nor the depth of a page is limited."""
    many = "".join(f'<li><a href="/x/{k}">Pilot {k}</a><i>Remote</i></li>' for k in range(1500))
    deep = "<div>" * 40 + "".join(f'<li><a href="/y/{k}">Mate {k}</a><i>Remote</i></li>' for k in range(4)) + "</div>" * 40
    pages = spark.createDataFrame([(1, f"<ul>{many}</ul>"), (2, deep)], "page_id long, html string")
    nodes = infer.prepare_nodes(pages)
    cards, members = infer.infer_cards(nodes, infer.default_targets(nodes))
    assert {r.page_id: r["count"] for r in cards.collect()} == {1: 1500, 2: 4}
    assert members.groupBy("page_id").count().count() == 2


def test_fields(learned):
    fields = learned[2]
    selectors = {p: {f: s.selectors for f, s in found.items()} for p, found in fields.items()}
    assert selectors[1]["location"][-1] == ":scope > td:nth-of-type(1)"
    assert selectors[1]["department"] == [":scope > td:nth-of-type(3)"]
    assert selectors[2]["title"][0] == "h4" and "job_id" not in selectors[2]
    assert selectors[3] == {"title": ["dt", ":scope > dt"], "location": ["dd", ":scope > dd"], "job_id": []}
    assert fields[3]["job_id"].attr == "data-shift-id"
    assert selectors[4]["department"] == ["p.team", ":scope > p.team"]
    assert fields[4]["apply_url"].attr == "href"


def test_picked_field_from_text_icon_or_wrapper(spark, nodes, learned):
    cards, members, _ = learned
    ids = {}
    for r in nodes.filter("page_id = 2").orderBy("node_id").collect():
        ids.setdefault((r.tag, r.text), r.node_id)
        if r.tag == "em":
            ids.setdefault("signs", []).append(r.node_id)
    card = nodes.filter("page_id = 2 and tag = 'article'").agg(F.min("node_id")).first()[0]
    picks = [(2, 0, "city", ids[("b", "; Quito, Ecuador")]), (2, 0, "pin", ids["signs"][2]), (2, 0, "card", card), (2, 0, "out", 0)]
    table = spark.createDataFrame(picks, "page_id long, target_id int, field string, node_id int")
    got = {r.field: r.selectors for r in infer.infer_field(nodes, members, table).collect()}
    assert got["city"] == got["pin"] and got["card"] == [] and "out" not in got
    assert any(s.endswith("span") for s in got["pin"])


def test_learned_sites_read_their_pages(spark, pages, targets):
    details = spark.createDataFrame([(3, "https://n.com/show?shift=7301#x")], "page_id long, detail_url string")
    sites = onboard.learn_sites(pages, targets, details)
    rows = extract_pages(pages, sites).orderBy("page_id", "pos").collect()
    by_page = {p: [r for r in rows if r.page_id == p] for p in (1, 2, 3, 4)}
    assert [(r.location, r.title, r.department) for r in by_page[1]] == BERTHS
    assert [r.apply_url for r in by_page[1]] == [f"https://t.com/berth?no={k}" for k in range(31, 37)]
    assert [(r.title, r.location) for r in by_page[2]] == [(role, "".join(places)) for role, _, places in ROLES]
    assert by_page[2][1].apply_url == "https://i.com/vacancy/402"
    assert [(r.job_id, r.apply_url) for r in by_page[3]] == [(str(k), f"https://n.com/show?shift={k}") for k in range(7300, 7304)]
    assert len(by_page[4]) == 10 and by_page[4][0].department == "Engineering"
    checked = {r.slug: r.onboarded_job_count for r in onboard.verify_sites(pages, sites).collect()}
    assert checked == {"s1": 6, "s2": 3, "s3": 4, "s4": 10}


def test_learned_paging_and_search_run(spark, tmp_path):
    """A site learned from its first page and the use of a control reads both pages of its listing."""
    fetched = spark.createDataFrame(
        [(k, "s", "Site", f"https://l.com/list{'?page=2' if k == 2 else ''}", k, listing(k, 2, total=17), 200) for k in (1, 2)],
        "page_id long, slug string, name string, url string, page_no int, html string, status int")
    one = fetched.filter("page_no = 1")
    nodes = infer.prepare_nodes(one)
    used = nodes.filter("text = 'Further'").select("page_id", "node_id", F.lit("https://l.com/list?page=2").alias("after_url"))
    searches = spark.createDataFrame([(1, "tide engineer", "https://l.com/list?q=Tide+Engineer")], "page_id long, query string, results_url string")
    learned = onboard.learn_sites(one, controls=used, searches=searches)
    write_site_configs(learned, f"{tmp_path}/sites")
    sites = read_site_configs(spark, f"{tmp_path}/sites", lines=True)
    site = sites.first()
    assert (site.pagination.type, site.pagination.url_template) == ("next", "https://l.com/list?page={page}")
    assert site.search.results_url == "https://l.com/list?q={query}"
    run = scrape(fetched, sites, "r")
    assert sorted(r.title for r in run.raw.collect()) == sorted(f"Tide Engineer {k}" for k in range(17))
    assert [(r.status, r.n_jobs, r.pages) for r in run.runs.collect()] == [("ok", 17, 2)]
    assert onboard.verify_sites(fetched, sites).first().onboarded_job_count == 17


def test_shared_signature_drops_what_few_siblings_have(spark):
    items = "".join(f'<li class="item {"featured" if i == 1 else ""}" data-kind="job">{i}</li>' for i in range(5))
    html = f"<ul>{items}</ul><ol><li class='solo'>x</li><li class='other'>y</li></ol>"
    nodes = infer.prepare_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    got = [r.shared_sig for r in infer.shared_signatures(nodes).orderBy("node_id").collect()]
    assert got == ["ul"] + ['li.item[data-kind="job"]'] * 5 + ["ol", "li.solo", "li.other"]


def brute_force_lookalikes(rows):
    """Siblings that a signature matches, by comparing every pair."""
    out = {}
    for n in rows:
        names = set(n.sclasses[:3]) | set(n.sattrs[:3])
        alike = [c for c in rows if (c.parent_id, c.tag) == (n.parent_id, n.tag) and names <= set(c.sclasses) | set(c.sattrs)]
        out[n.node_id] = n.sig + (f":nth-of-type({n.nth_of_type})" if len(alike) > 1 else "")
    return out


def test_path_steps_agree_with_brute_force(spark):
    import random

    random.seed(5)
    kinds = ["alpha", "beta", "gamma", "delta", "item"]
    items = "".join(
        f'<{random.choice(["li", "p"])} class="{" ".join(random.sample(kinds, random.randint(0, 4)))}">x</{"li"}>' for _ in range(60)
    )
    nodes = infer.prepare_nodes(spark.createDataFrame([(1, f"<div>{items}</div>")], "page_id long, html string"))
    rows = [r for r in nodes.collect() if r.parent_id is not None]
    got = {r.node_id: r.step for r in infer.path_steps(nodes, nodes).collect()}
    assert {k: got[k] for k in brute_force_lookalikes(rows)} == brute_force_lookalikes(rows)


def test_stable_names(evaluate):
    good = ["job-card", "JobCard", "btn", "x" * 40, "grid-cols-2", "md:flex", "QJp"]
    bad = ["active", "is-open", "sort-asc", "css-1x2y3z", "sMn82b", "r0wTof", "QJPWVe", "card__a1b2c3", "list-a1f3e9", "x" * 41, ""]
    assert evaluate(elements.is_stable_class, [(c,) for c in good]) == [True] * len(good)
    assert evaluate(elements.is_stable_class, [(c,) for c in bad]) == [False] * len(bad)
    ids = {"main": True, "job-1234": False, "a:b": False, "1st": False, "row-12": True, None: False}
    assert evaluate(elements.is_stable_id, [(i,) for i in ids]) == list(ids.values())


def test_stable_attrs(spark):
    attrs = {"data-id": "abc", "data-n": "a1", "data-w": "two words", "role": "list 2", "title": "T", "style": "x",
             "itemprop": "p1234", "type": "deadbeefdeadbeef", "data-e": "", "rel": "next"}
    df = spark.createDataFrame([(attrs,)], "a map<string,string>")
    names = lambda item: [e.key for e in df.select(elements.stable_attrs(F.col("a"), item)).first()[0]]
    assert sorted(names(True)) == ["data-id", "role"]
    assert sorted(names(False)) == ["data-id", "data-n", "data-w", "rel", "role", "title"]


def test_signature_escapes(spark):
    df = spark.createDataFrame([("div", ["lg:flex", "is-open", "p-[1]"], {"data-k": 'a"b'})], "t string, c array<string>, a map<string,string>")
    sig = df.select(elements.element_signature(F.col("t"), F.col("c"), F.col("a"))).first()[0]
    assert sig == r'div.lg\:flex.p-\[1\][data-k="a\"b"]'


def test_controls_and_vocabularies(spark, evaluate):
    controls = [
        ("2", {}, 'a:text-is("{page}")', "page_number"), ("2", {}, None, "next"), ("Load  more", {}, None, "load_more"),
        ("", {"aria-label": "Show all"}, None, "load_more"), ("More jobs", {}, None, "load_more"), ("Reload more", {}, None, "next"), (">", {"rel": "next"}, None, "next"),
    ]
    df = spark.createDataFrame(controls, "t string, a map<string,string>, p string, want string")
    for r in df.withColumn("got", elements.classify_pagination(F.col("t"), F.col("a"), F.col("p"))).collect():
        assert r.got == r.want
    states = [(["next", "disabled"], {}, True), (["is-disabled"], {}, True), (["disabledness"], {}, False), ([], {"disabled": ""}, True),
              ([], {"aria-disabled": "false"}, False), ([], {"aria-disabled": "true"}, True), ([], {"style": "pointer-events:none"}, True)]
    df = spark.createDataFrame(states, "c array<string>, a map<string,string>, want boolean")
    for r in df.withColumn("got", elements.control_disabled(F.col("c"), F.col("a"))).collect():
        assert r.got == r.want
    texts = {"Pune": (1, 0, 0), "x, ab": (1, 0, 0), "3+ days ago": (0, 1, 0), "Sept 3, 2024": (0, 1, 0), "R&D Engineering": (0, 0, 1), "Zzz": (0, 0, 0)}
    got = evaluate(elements.text_category, [(t,) for t in texts])
    assert [tuple(int(v) for v in g) for g in got] == list(texts.values())
