"""Phrases, tries and vectors against brute force: nulls, empty and long values, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm import bit_slices, phrases, prefix_trie

# ---- phrases


def plain_collocations(rows, least, contained, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 5):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if any(other == lang and len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in found.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in out.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:first])}


def spoken():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(4000)]
    rows = [(rng.choice(["en", "de", None]), " ".join(words[a : a + rng.randrange(1, 60)])) for a in range(0, 3900, 30)]
    rows += [("en", "New York City Hall. new york, city!\tNEW  YORK;hall")] * 6 + [("en", "hot word " * 300), ("en", "the hot pair x%d" % 3), ("en", None), (None, ""), ("de", " \t\n.,"), ("é", "é ü é ü é ü é ü é ü")]
    rows += [("en", f"the {rng.randrange(9)} of {rng.randrange(9)}") for _ in range(200)] + [("en", "long" + "er" * 50_000 + " word")]
    return rows


@pytest.mark.parametrize("shard_rows,chunk", [(250_000, 4 << 20), (60, 500), (9, 4 << 20)])
def test_collocations(spark, monkeypatch, shard_rows, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = spoken()
    docs = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], "n long, lang string, text string, score int").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least=4, contained=80, first=40, shard_rows=shard_rows).collect()}
    assert got == plain_collocations(rows, 4, 80, 40) and len(got) > 60


def test_collocations_without_rows(spark, no_docs):
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", "")], "lang string, text string")).collect() == []


def test_sample_comes_to_the_driver_as_bytes(spark):
    """Lists of numbers would be objects there, 40 bytes and more for each of the 8."""
    docs = spark.range(200, numPartitions=4).selectExpr("id % 2 AS language", "array_join(transform(sequence(1, 1000), x -> concat('w', (x * id) % 997)), ' ') AS text")
    tracemalloc.start()
    flags, sample = phrases.survey(docs, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    suffix = 8 * (phrases.DEPTH + 1)  # bytes
    assert peak < len(flags) + 2 * 200_000 * suffix + 4_000_000
    assert sum(len(r.words) for r in sample) == 200_000 * suffix and all(r.weight == 1 for r in sample)
    assert max(len(r.words) for r in sample) <= phrases.SAMPLE_ROW * suffix
    edges = phrases.bounds(flags, sample, 500)
    assert len(edges) > 20 and {int(x) for x in edges[:, 0]} <= {0, 1}


def test_word_flags_of_many_words_come_packed(spark, monkeypatch):
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)  # a job for every partition
    wanted = spark.range(30_000, numPartitions=7).select(F.xxhash64("id").alias("word"))
    flags = np.unpackbits(phrases.word_flags(wanted))
    words = np.array([r.word for r in wanted.collect()], np.int64).view(np.uint64)
    assert len(flags) == 1 << phrases.WORD_BITS
    assert np.array_equal(np.flatnonzero(flags), np.unique(words >> np.uint64(64 - phrases.WORD_BITS)).astype(np.int64))
    assert not phrases.word_flags(wanted.where("word is null")).any()


def test_three_way_counts_prefixes():
    rng = np.random.default_rng(1)
    for least in (1, 3, 10):
        columns = [rng.integers(1, 4, 300).astype(np.uint64) for _ in range(4)]
        stop = rng.integers(1, 6, 300)
        for d in range(1, 4):
            columns[d][stop <= d] = 0
        weight = rng.integers(1, 4, 300)
        want = Counter()
        for i in range(300):
            for d in range(1, 5):
                key = tuple(int(c[i]) for c in columns[:d])
                if 0 in key:
                    break
                want[key] += int(weight[i])
        got = {tuple(int(c[r]) for c in columns[:d]): int(n) for d, rows, counts in phrases.three_way(columns, weight, least) for r, n in zip(rows, counts, strict=True)}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_score_of_large_counts(spark):
    """Products beyond 64 bits."""
    a, b, c = 9_000_000_000_000_000, 9_000_000_000_000_001, 9_100_000_000_000_003
    rows = [(1, 1, [1], b), (1, 1, [2], c), (1, 2, [1, 2], a)]
    frequent = spark.createDataFrame(rows, "language long, depth int, words array<long>, f long")
    got = phrases.candidates(frequent, 80).collect()
    assert [(r.a, r.l, r.r, r.score) for r in got] == [(a, b, c, 2000000 * a // (b + c))]


# ---- tries


def plain_trie(rows):
    own = defaultdict(list)
    digest = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(some, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))] for c, some in own.items()}
    nodes = defaultdict(list)
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            nodes[whole[c][:d]].append(c)
    out = set()
    for node, members in nodes.items():
        below = [m for m in nodes if m[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == node)))
        saved = sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in below if m)
        childless = lambda m: not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)
        out.add((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(m) == len(node) + 1 for m in below),
                 sum(childless(m) for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONV = "conv_id long, turn long, role string, text string, depth string"


def talks():
    rng = random.Random(5)
    rows = []
    for c in list(range(0, 60)) + list(range(95, 130)) + [200, 207, 312]:  # the opener of the last is absent
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hé", "a", "", None, f"t{rng.randrange(30)}"]), "x"))
    for c in range(400, 470):  # one very common conversation
        rows += [(c, t, "user", f"same{t}", "x") for t in range(7)]
    rows += [(900, t, "user", f"long{t}", "x") for t in range(300)] + [(901, None, "user", "first", "x"), (901, None, "user", "also", "x"), (901, 0, "user", "then", "x")]
    rows += [rows[3], rows[3], (None, 1, "user", "nobody", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns,merged", [(100_000, 256), (60, 2), (15, 3)])
def test_trie(spark, monkeypatch, shard_turns, merged):
    monkeypatch.setattr(prefix_trie, "ID_TEXT", 20)
    rows = talks()
    got = [tuple(r) for r in prefix_trie.trie_nodes(spark.createDataFrame(rows, CONV), shard_turns, merged).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_turnless_and_none(spark):
    assert prefix_trie.trie_nodes(spark.createDataFrame([], CONV)).collect() == []
    assert prefix_trie.trie_nodes(spark.createDataFrame([(None, 1, "a", "b", "x")], CONV)).collect() == []
    # 1205 has no opener, and no more turns than those that would come from it
    few = next(c for c in range(1201, 1300) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(few, 0, "user", "gone", "x")]
    got = [tuple(r) for r in prefix_trie.trie_nodes(spark.createDataFrame(rows, CONV)).collect()]
    assert set(got) == plain_trie(rows) and len(got) == 1


def test_find_close():
    rng = random.Random(2)
    for n in (1, 2, 31, 32, 33, 200, 3000):
        for deep in (0.2, 0.5, 0.95):
            depth = [0]
            for _ in range(n - 1):
                depth.append(depth[-1] + 1 if rng.random() < deep else rng.randrange(1, depth[-1] + 2))
            trie = prefix_trie.Parentheses(np.array(depth))
            stack, want = [], {}
            for at, bit in enumerate(trie.bits):
                if bit:
                    stack.append(at)
                else:
                    want[stack.pop()] = at
            close = trie.find_close()
            assert not stack and {int(a): int(z) for a, z in zip(trie.open, close, strict=True)} == want
            leaf = [i + 1 == n or depth[i + 1] <= depth[i] for i in range(n)]
            size = (close - trie.open + 1) // 2
            assert trie.leaves(close).tolist() == [sum(leaf[i : i + size[i]]) for i in range(n)]


# ---- vectors


def plain_nearest(rows, every, first):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(usable):
        if q % every == 0:
            scores = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(usable) if b != a)[:first]
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    return Counter(out)


def vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(260)]
    rows += [(300 + i, [0.5, -0.25, 0.125, 0.0, 0.3, 0.1]) for i in range(90)]  # one very common vector
    rows += [(400, None), (401, [0.1, None]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [0.1] * 6), (404, []), (420, [0.2, 0.4]), (440, [0.5] * 9)]
    rows += [(460, [1e6, -1e6, 3.0, 0.0, 0.0, -0.015625]), (461, [-1e6, 2e6, 0.0, 0.0, 0.0, 5.0]), (480, [0.0] * 6), (-20, [-0.5] * 6), rows[20], rows[7]]
    return rows


@pytest.mark.parametrize("blocks,pairs,words", [(1, 1 << 33, 2048), (5, 500, 1), (16, 1 << 33, 2048)])
def test_nearest(spark, monkeypatch, blocks, pairs, words):
    monkeypatch.setattr(bit_slices, "LEAST_BLOCKS", blocks)
    monkeypatch.setattr(bit_slices, "CELL_PAIRS", pairs)
    monkeypatch.setattr(bit_slices, "WORDS_AT_ONCE", words)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert Counter(tuple(r) for r in bit_slices.nearest(df, first=7).collect()) == plain_nearest(rows, 20, 7)
    assert Counter(tuple(r) for r in bit_slices.nearest(df, first=1000).collect()) == plain_nearest(rows, 20, 1000)


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert bit_slices.nearest(spark.createDataFrame([], schema)).collect() == []
    assert bit_slices.nearest(spark.createDataFrame([(20, [0.5])], schema)).collect() == []
    got = bit_slices.nearest(spark.createDataFrame([(20, [0.5]), (21, [-0.5])], schema)).collect()
    assert [tuple(r) for r in got] == [(20, 1, 21, -1024)]


def test_signed_digits():
    values = np.array([[0, 1, -1, 7, -7, 1 << 62, -(1 << 63), (1 << 63) - 1, 12345, -54321]])
    digits = bit_slices.signed_digits(values)
    assert [sum(int(d[0, k]) << p for p, d in enumerate(digits)) for k in range(values.shape[1])] == [int(v) for v in values[0]]
    assert all(not (a & b).any() for a, b in zip(digits, digits[1:]))
