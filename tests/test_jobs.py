from pyspark.sql import functions as F

from cardmill.operators import evaluate as ev
from cardmill.operators import jobs
from cardmill.functions import verdicts

ROW = "ord int, company string, job_id string, apply_url string, title string, location string"


def test_deduplicate_keys_and_order(spark):
    rows = [
        (5, "Acme", None, None, "Dev", ""),
        (1, "ACME", "7", None, "Dev", None),
        (2, "acme", "7", "https://x/1", "Other", None),
        (3, "Acme", None, "https://x/1", "Dev", None),
        (4, "Beta", "", "HTTPS://X/1", "Dev", None),
        (6, "acme", None, None, "DEV", None),
        (7, "Acme", None, None, None, "Pune"),
    ]
    got = jobs.deduplicate(spark.createDataFrame(rows, ROW)).collect()
    assert sorted(r.ord for r in got) == [1, 3, 5]


def test_deduplicate_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "a", "same", None, "t", None) for i in range(100)], ROW)
    plan = jobs.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_normalize_job(spark):
    row = [(1, None, None, "https://ex.test/berth/8/?gh_src=7&k=1#plan", "Dock Foreman\n(urgent)", "Location: Ghent\nHybrid")]
    df = spark.createDataFrame(row, ROW).withColumn("extras", F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit(" raw ")))
    r = jobs.normalize_jobs(df).first()
    assert (r.title, r.location, r.apply_url, r.extras) == ("Dock Foreman", "Ghent | Hybrid", "https://ex.test/berth/8?k=1", {"b": " raw "})


def test_score_rules(evaluate):
    """Whole words of either case, each keyword once, title and place together."""
    cases = {
        ("Deckhand and Developer", None): 4, ("Back-end DEVELOPER", "Remote"): 9, ("Head of Engineering", "Mumbai"): 0, ("Intern, software and software", "remote in India"): 12,
        ("Internationally staffed desk", "Indiana"): 0, ("Sr. Principal", None): -18, (None, "Chennai"): 3, (None, None): 0, ("", ""): 0,
    }
    assert evaluate(jobs.score_job, list(cases)) == list(cases.values())


def test_rank_is_stable_and_filters(spark):
    rows = [(1, "c", None, None, "Sales", None), (2, "c", None, None, "Engineer", None), (3, "c", None, None, "Engineer", None),
            (4, "c", None, None, "Software Engineer", None)]
    df = spark.createDataFrame(rows, ROW)
    assert [r.ord for r in jobs.rank_jobs(df).collect()] == [4, 2, 3, 1]
    assert [r.ord for r in jobs.rank_jobs(df, min_score=5).collect()] == [4, 2, 3]


def harvest_rows(spark, rows):
    return spark.createDataFrame(rows, "slug string, page_no int, pos int, apply_url string, job_id string, title string, location string")


def test_harvest_first_seen(spark):
    rows = [
        ("a", 2, 1, "u1", None, "x", None), ("a", 1, 9, "u1", None, "y", None), ("a", 1, 1, None, "7", "t", None),
        ("a", 1, 2, None, "7", "t2", None), ("b", 1, 1, "u1", "7", "t", None), ("a", 1, 3, None, None, "t", None),
        ("a", 3, 3, None, None, "T", None), ("a", 3, 4, None, None, None, "z"),
    ]
    got = jobs.harvest_first_seen(harvest_rows(spark, rows)).collect()
    assert sorted((r.slug, r.job_key, r.page_no, r.pos) for r in got) == [
        ("a", "T|", 3, 3), ("a", "id:7", 1, 1), ("a", "t|", 1, 3), ("a", "u1", 1, 9), ("b", "u1", 1, 1),
    ]


def test_pagination_cutoff(spark):
    rows = [
        ("a", 1, 1, "u1", None, "x", None), ("a", 2, 1, "u1", None, "x", None), ("a", 3, 1, "u3", None, "x", None),
        ("b", 1, 1, "u1", None, "x", None), ("b", 2, 1, "u2", None, "x", None), ("b", 3, 1, "u3", None, "x", None),
        ("c", 1, 1, "u1", None, "x", None), ("c", 2, 1, "u2", None, "x", None),
        ("e", 1, 1, "u1", None, "x", None), ("e", 2, 1, "u2", None, "x", None),
    ]
    seen = jobs.harvest_first_seen(harvest_rows(spark, rows))
    pages = spark.createDataFrame(
        [(s, p, k, n) for s, k, n, last in [("a", "next", True, 3), ("b", "next", True, 3), ("c", "scroll", True, 2),
                                            ("d", "next", True, 1), ("e", "next", False, 2)] for p in range(1, last + 1)],
        "slug string, page_no int, kind string, more boolean",
    )
    got = jobs.pagination_cutoff(pages, seen, max_pages=F.lit(2), kind=F.col("kind"), can_continue=F.col("more"))
    assert sorted(map(tuple, got.select("slug", "pages", "n_jobs").collect())) == [
        ("a", 2, 1), ("b", 2, 2), ("c", 1, 1), ("d", 1, 0), ("e", 1, 1),
    ]
    kept = jobs.within_cutoff(seen, got.select("slug", "pages"))
    assert kept.count() == 1 + 2 + 1 + 1


def test_new_listing_keys_treat_nulls_as_equal(spark):
    before = spark.createDataFrame([("a", None), ("b", "u")], "title string, apply_url string")
    after = spark.createDataFrame([("a", None), ("b", "v"), ("b", "v")], "title string, apply_url string")
    assert [tuple(r) for r in jobs.new_listing_keys(before, after).collect()] == [("b", "v")]


def test_parse_verdict(evaluate):
    cases = {
        'x {"fit":"yes ","score":"8/10","reason":"ok"} y': ("Yes", 8, "ok"),
        '{"fit":"No","score":-5,"reason":"r"}': ("No", 5, "r"),
        '{"fit":"Yes\\n","score":3,"reason":"r"}': ("Yes", 3, "r"),
        '{"fit":"\\t yes\\u00a0","score":3,"reason":"r"}': ("Yes", 3, "r"),
        '{"fit":"No","score":7.9,"reason":""}': ("No", 7, ""),
        '{"fit":"maybe","score":99999999999999999999999999999999999999999999,"reason":"r"}': ("Maybe", 10, "r"),
        '{"fit":"maybe","score":"007","reason":"r"}': ("Maybe", 7, "r"),
        '{"fit":"No","score":null,"reason":"r"}': ("No", 0, "r"),
        '{"fit":"No","score":1,"reason":1}': None,
        '{"fit":"No","reason":"r"}': None,
        '{"fit":"Perhaps","score":1,"reason":"r"}': None,
        '{"fit":"No" "score"}': None,
        "none": None,
        None: None,
    }
    got = evaluate(verdicts.parse_verdict, [(c,) for c in cases])
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_build_prompt(evaluate):
    prompt = evaluate(lambda a, b, c, d: verdicts.build_prompt(a, b, c, d, "100% remote\n"), [("Dev", "Acme", None, "IT")])[0]
    assert "Candidate:\n100% remote\n\nJob:\nTitle: Dev\nCompany: Acme\nLocation: None\nDepartment: IT\n\nReply with" in prompt


def rated(spark, scorer, **options):
    rows = [(i, "c", None, None, t, None) for i, t in enumerate(["good", "flaky", "bad", "boom", "late"], 1)]
    df = spark.createDataFrame(rows, ROW).withColumn("score", F.col("ord")).coalesce(1)
    return ev.evaluate_jobs(df, scorer, **options)


def test_evaluate_jobs(spark):
    def scorer(prompts):
        titles = [p.split("Title: ")[1].split("\n")[0] for p in prompts]
        if titles != ["good", "flaky", "bad", "boom"]:
            titles = [t.replace("flaky", "good") for t in titles]  # second attempt
        ok = '{"fit": "Yes", "score": 9, "reason": "ok"}'
        return [ok if t == "good" else "no" if t == "bad" else None for t in titles]

    got = {r.title: (r.ai_fit, r.ai_score, r.ai_reason) for r in rated(spark, scorer, limit=4).collect()}
    failed = ("Unknown", 0, "evaluation failed: no JSON object in reply")
    assert got == {"good": ("Yes", 9, "ok"), "flaky": ("Yes", 9, "ok"), "bad": failed, "boom": failed, "late": (None, None, None)}


def test_evaluate_jobs_failing_or_missing_scorer(spark):
    def scorer(prompts):
        raise RuntimeError("down " * 40)

    for r in rated(spark, scorer).collect():
        assert (r.ai_fit, r.ai_score) == ("Unknown", 0)
        assert r.ai_reason == "evaluation failed: " + "down " * 40
    same = rated(spark, None)
    assert "ai_fit" not in same.columns


def test_one_failing_prompt_fails_alone(spark):
    def scorer(prompts):
        if any("low" in p for p in prompts):
            raise RuntimeError("no answer " + "x" * 100)
        return ['{"fit": "Yes", "score": 2, "reason": "r"}' for _ in prompts]

    df = spark.createDataFrame([(1, "a", None, None, "low", None), (2, "a", None, None, "high", None), (2, "a", None, None, "mid", None)], ROW).withColumn("score", F.col("ord"))
    got = {r.title: (r.ai_fit, r.ai_reason) for r in ev.evaluate_jobs(df.coalesce(1), scorer).collect()}
    assert got["high"] == got["mid"] == ("Yes", "r") and got["low"][0] == "Unknown" and got["low"][1].endswith("x" * 100)
    # rows that share a key are rated together and stay as many
    assert ev.evaluate_jobs(df.coalesce(1), scorer, limit=2, order=[F.col("ord").desc()]).count() == 3


def test_ai_rank(spark):
    df = spark.createDataFrame([(1, None, 9), (2, 3, 1), (3, 3, None), (4, 0, 10), (5, 3, 1)], "ord int, ai_score int, score int")
    assert [r.ord for r in jobs.ai_rank(df).collect()] == [2, 5, 3, 4, 1]


def test_numbered_positions(spark):
    """Positions over many ranges equal those of a sort, ties and nulls included."""
    import random

    rng = random.Random(8)
    rows = [(k, rng.choice([None, *range(40)])) for k in range(700)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    got = {r.id: r.p for r in jobs.numbered(df, [F.col("v").desc(), "id"], "p").collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [got[i] for i, _ in want] == list(range(700))


def test_union_keeps_the_order_of_results(spark):
    first = spark.createDataFrame([(k, "a", k % 3) for k in range(50)], "k int, company string, x int").repartition(3)
    second = spark.createDataFrame([(k, "b", "y") for k in range(20)], "k int, company string, y string").repartition(2)
    got = jobs.union_results(first, second, first.limit(0), order=["k"]).orderBy("ord").collect()
    assert [(r.ord, r.company, r.k) for r in got] == [(k, "a", k) for k in range(50)] + [(50 + k, "b", k) for k in range(20)]
    assert jobs.union_results(first, second).count() == 70


def test_limit_marks_the_first_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("ord"), (F.col("id") * 7919 % 5000).alias("v")).repartition(6)
    flagged = ev.first_rows(df, 1234, ["v"], "ord")
    assert flagged.count() == 5000
    assert sorted(r.v for r in flagged.filter("_chosen").collect()) == list(range(1234))


def test_a_slow_prompt_fails_alone():
    import threading
    import time

    lock, now, most = threading.Lock(), [0], [0]

    def scorer(prompts):
        (prompt,) = prompts
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(3 if prompt == "slow" else 0.05)
        with lock:
            now[0] -= 1
        if prompt == "bad":
            raise RuntimeError("no")
        return [prompt.upper()]

    start = time.monotonic()
    got = ev.in_flight(scorer, ["a", "slow", "b", "bad", "c", "d"], 2, 0.6)
    assert time.monotonic() - start < 2 and most[0] <= 3  # two in flight, and the one that was given up
    assert got == [("A", None), (None, "no reply within 0.6 s"), ("B", None), (None, "no"), ("C", None), ("D", None)]
    assert ev.in_flight(scorer, [], 2, 1.0) == [] and ev.in_flight(scorer, ["x"], 4, None) == [("X", None)]


def test_rated_with_prompts_in_flight(spark):
    def scorer(prompts):
        import time

        (prompt,) = prompts
        if "Title: late" in prompt:
            time.sleep(5)
        return ['{"fit": "Yes", "score": 2, "reason": "r"}']

    got = {r.title: (r.ai_fit, r.ai_reason) for r in rated(spark, scorer, at_once=3, timeout=0.5).collect()}
    assert got["good"] == ("Yes", "r") and got["late"] == ("Unknown", "evaluation failed: no reply within 0.5 s")


def test_points_from_a_table_of_weights(spark, monkeypatch):
    """The same points as pattern by pattern, for plain and other patterns, in one pass and in several."""
    import random

    from cardmill.operators import weights

    rng = random.Random(3)
    words = ["sr", "senior", "back-end", "back end", "R&D", "c", "it", "data", "ml ops", "k", "sde2", "node js", "a_b", "it's"]
    patterns = {w: rng.randrange(-9, 9) for w in words} | {"lead|head of": 4, "dev(eloper)?s?": 3, r"front[- ]?end": -2, "c\\+\\+": 7, "über": 5}
    glue = [" ", "-", "/", ", ", "é", "_", "", "́", "‍", "\n", "2", "."]
    texts = [None, "", "SENIOR data", "K it", "İt", "IT", "ſr", "Über c++ c"]
    for _ in range(300):
        texts.append("".join(rng.choice([*words, "lead", "Head Of", "Developers", "front-end", "DEVS", "über"]) .swapcase() + rng.choice(glue) for _ in range(rng.randrange(1, 7))))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("points", F.lit("clash"))
    table = spark.createDataFrame([*patterns.items(), ("data", 1), (None, 5)], "pattern string, points int")
    want = {r.id: r.p for r in rows.select("id", jobs.keyword_points(F.col("t"), patterns | {"data": patterns["data"] + 1}).alias("p")).collect()}
    for together in (200_000, 4):
        monkeypatch.setattr(weights, "PASS_PATTERNS", together)
        got = {r.id: r.points for r in weights.keyword_points_of(rows, "t", table).collect()}
        assert got == want
    assert {r.points for r in weights.keyword_points_of(rows, "t", table.limit(0)).collect()} == {0}


def test_ten_thousand_patterns_in_one_pass(spark):
    from cardmill.operators import weights

    table = spark.range(10_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("pattern"), (F.col("id") % 7).alias("points"))
    rows = spark.range(2000).select("id", F.concat_ws(" ", F.concat(F.lit("Word"), F.col("id").cast("string")), F.concat(F.lit("word"), (F.col("id") * 5).cast("string")), F.lit("sword1 word")).alias("t"))
    got = {r.id: r.points for r in weights.keyword_points_of(rows, "t", table).collect()}
    # word0 stands twice and counts once
    assert got == {i: i % 7 + (i * 5 % 7 if i else 0) for i in range(2000)}
