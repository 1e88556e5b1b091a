"""Near duplicates, passages and components against plain versions."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from cardmill.llm import jaccard, substrings
from cardmill.llm.components import components
from cardmill.llm.fm_index import FMIndex

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_jaccard_join(rows, docs):
    sets = [(r[0], shingles(r[1])) for r in rows]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    named = classes(links, {i for i, _ in sets if i is not None})
    want = sorted((-1 if i is None else i, len(s), -1 if i is None else named[i] if s else i) for i, s in sets)
    got = jaccard.near_duplicates(docs.withColumn("component_id", docs.lang)).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got) == want


def test_links_through_a_repeated_id(spark):
    """An id that is in classes of others, and the smallest of none, links them."""
    text = lambda k: " ".join(f"t{k}x{i}" for i in range(30))
    cases = [[(2, 0), (5, 0), (3, 1), (5, 1)], [(2, 0), (5, 0), (3, 1), (5, 1), (1, 2), (6, 2), (6, 1), (7, 3), (9, 3), (8, 4)], [(k, k) for k in range(20, 40)] + [(50, k) for k in range(20, 40)]]
    for rows in cases:
        rows = [(i, text(k)) for i, k in rows]
        sets = [(i, shingles(t)) for i, t in rows]
        want = classes([(a, b) for (a, s), (b, t) in combinations(sets, 2) if 100 * len(s & t) >= 75 * len(s | t)], {i for i, _ in sets})
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, want[i]) for i, _ in rows)


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard.near_duplicates(no_docs).collect() == []


def test_groups_that_only_a_query_connects(spark):
    """Chains of documents, each similar to the next only, and sizes at the threshold."""
    words = [f"t{k}" for k in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 70])) for i in range(30)] + [(100 + k, " ".join(words[: 40 + k])) for k in range(0, 40, 3)]
    named = classes([(a, b) for (a, s), (b, t) in combinations([(i, shingles(t)) for i, t in rows], 2) if 100 * len(s & t) >= 75 * len(s | t)], [i for i, _ in rows])
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: r[2] for r in got} == named
    assert len(set(named.values())) < len(rows)


def cut(rows, window):
    """Per row: words, removed, kept words."""
    first = {}
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        for k in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((-1 if i is None else i, len(words), len(gone), tuple(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("window", "hot"), [(50, 5000), (50, 0), (12, 3), (3, 5000)])
def test_substrings(rows, docs, window, hot):
    got = substrings.deduplicate(docs.withColumn("n_words", docs.lang), window=window, hot_segments=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, tuple(WORD.findall(r.text or ""))) for r in got) == cut(rows, window)
    whole = {(r[0], r[1]) for r in rows}
    assert all((r.doc_id, r.text) in whole for r in got if not r.n_removed)


def test_many_ids_are_joined_by_shuffle(rows, docs, monkeypatch):
    """Beyond the bound of broadcast ids the results are the same."""
    from cardmill.llm import tables

    monkeypatch.setattr(tables, "BROADCAST_IDS", 0)
    monkeypatch.setattr(substrings, "BROADCAST_IDS", 0)
    got = substrings.deduplicate(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, tuple(WORD.findall(r.text or ""))) for r in got) == cut(rows, 50)
    few = docs.where("doc_id < 30")
    sets = [(r.doc_id, shingles(r.text)) for r in few.collect()]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(few).collect()} == classes(links, {i for i, _ in sets})


def test_substrings_of_nothing(no_docs):
    assert substrings.deduplicate(no_docs).collect() == []


def test_fm_index():
    rng = np.random.default_rng(3)
    for _ in range(40):
        window = int(rng.integers(2, 9))
        some = lambda k: [rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(0, 25))).astype(np.uint32) for _ in range(k)]
        indexed = [*some(5), np.arange(9, dtype=np.uint32)]
        streamed = some(5) + indexed[:2]
        owners = rng.permutation(len(indexed)).astype(np.int64)
        first = lambda parts: np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        index = FMIndex(np.concatenate(indexed), first(indexed), owners, window)
        least = {}
        for part, owner in zip(indexed, owners, strict=True):
            for k in range(len(part) - window + 1):
                key = tuple(part[k : k + window])
                least[key] = min(least.get(key, 99), owner)
        want = [least.get(tuple(p[k : k + window]), -1) if k + window <= len(p) else -1 for p in streamed for k in range(len(p))]
        assert index.least_owners(np.concatenate(streamed), first(streamed)).tolist() == want


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (3, 2), (200, 201), (201, 200)]
    nodes = {n for pair in links for n in pair}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(classes(links, nodes).items())


@pytest.mark.parametrize("n", [100, 300])
def test_pairs_of_a_family_grow_in_proportion(spark, monkeypatch, n):
    """Near copies of one text, most of them similar to each other: a few verified pairs a document, and one component."""
    rng = random.Random(n)
    base = [f"q{rng.randrange(400)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, plain = [], jaccard.verified

    def counting(some, *rest):
        pairs.append(some.count())
        return plain(some, *rest)

    monkeypatch.setattr(jaccard, "verified", counting)
    got = jaccard.near_duplicates(docs).collect()
    assert sum(pairs) <= 5 * n
    sets = [shingles(t) for t in texts]
    apart = [r.doc_id for r in got if r.component_id != 0]
    for d in apart:
        same = {r.doc_id for r in got if r.component_id == next(x.component_id for x in got if x.doc_id == d)}
        for e in range(n):
            linked = 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e])
            assert not linked or e in same
    assert len(apart) < n / 2
