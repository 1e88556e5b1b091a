"""The corpus pipeline against a plain version of all its stages."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.conftest import DOCS, corpus, prose
from tests.llm.test_duplicates import classes, cut, shingles

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, items):
    """(doc_id, piece, start, length, ids_crc32) of what the stages keep."""
    from tokenizers import Tokenizer

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # by row: of every group the smallest id, rows without one last
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [(k, shingles(r[1])) for k, r in enumerate(rows)]
    named = classes([(a, b) for (a, s), (b, t) in combinations(sets, 2) if 100 * len(s & t) >= 75 * len(s | t)], range(len(rows)))
    rows = [r for k, r in enumerate(rows) if named[k] == k]
    kept = [(i, words) for i, n, gone, words in cut(rows, 50) if words]
    normal = lambda words: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", " ".join(words).lower())) + " "
    kept = [(i, words) for i, words in kept if not any(normal([t]) in normal(words) for _, t in items)]
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, words in kept:
        ids = [*tokenizer.encode(" ".join(words), add_special_tokens=False).ids, 1]
        out += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    return sorted(out)


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randrange(12, 50), 300, stem="q")) for k in range(6)]
    rows = corpus(3)
    rows += [(900 + k, prose(rng, 40) + "\n" + t + ". " + prose(rng, 60), "en", "s", 1) for k, (_, t) in enumerate(items)]
    rows += [(950, "12 34 !!", None, "s", 8), (951, prose(rng, 9000), "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": [k for k, _ in items], "text": [t for _, t in items]}), f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain(rows, items)
    ends = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame(corpus(4)[:20], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": ["some item of a test that no text holds at all"]}), f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.dtypes == docs.dtypes, name


def test_pipeline_without_labels(spark, tmp_path):
    """Without any language to learn, documents with letters go on."""
    rows = [(r[0], r[1], None, r[3], r[4]) for r in corpus(6)] + [(970, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((r[0] or -1, r[1]) for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns with the names that operators use inside."""
    pq.write_table(pa.table({"item_id": [1], "text": ["some item of a test that no text holds at all"]}), f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(corpus(4)[:20], DOCS).selectExpr("*", "1 AS cut", "2 AS score", "'a' AS words", "3 AS component_id", "4 AS n", "5 AS lang_pred")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert {"cut", "words", "n"} <= set(stage(spark, docs, str(tmp_path)).columns), name


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_are_dropped_by_row(spark):
    """One row of every group stays, also where ids repeat with other texts."""
    rng = random.Random(5)
    x, y, z, u, v, w = (prose(rng, 60) for _ in range(6))
    near = z + " more"
    cases = [
        ([(3, y), (5, y), (5, x), (7, x)], [(3, y), (5, x)]),  # no group loses all its rows
        ([(1, y), *((5, t) for t in (x, y, u, v, w))], [(1, y), *((5, t) for t in (x, u, v, w))]),  # a hot id keeps its other texts
        ([(4, z), (4, near), (4, z), (4, x)], None),  # near copies under one id
        ([(None, x), (None, x), (2, x)], [(2, x)]),  # rows without an id are rows like others, and come last
        ([(None, y), (None, y), (None, z)], [(None, y), (None, z)]),
    ]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for rows, want in cases:
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
        if want is None:
            assert len(got) == 2 and (4, x) in got and set(got) <= {(4, z), (4, near), (4, x)}
        else:
            assert order(got) == order(want)
