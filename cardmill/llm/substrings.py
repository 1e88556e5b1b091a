"""Removal of word passages that an earlier document has, found with one compressed FM-index per shard.

A window is ``window`` consecutive words of one document. A window goes if its word sequence also starts in a document with
a smaller id; a word goes if a window that goes covers it.

1. Every window has an anchor: the smallest hash among its runs of ``ANCHOR_WORDS`` words, the leftmost one of equals.
   Windows with equal words have equal anchors. Neighbouring windows with one anchor form a segment.
2. Segments whose anchor occurs in one document only are done. Of equal segments, the one of the smallest document stands
   for all, so a group of copies is one segment whatever its size.
3. Segments are dealt to shards by anchor, and the number of shards follows from their total length. Each shard builds an
   FM-index of its segments; they are streamed against it, and the matching statistics, capped at the window, give the
   smallest document of every match of full length.
4. An anchor with more than ``hot_segments`` different segments is split: its windows go one by one, equal ones as one,
   to shards by the hash of their words.

Words are compared by 32 bits of their hash: two windows that differ are taken as equal with a probability of 2**-32 for
each word they differ in.

Defined results: a null text has no words. Rows with one doc_id are one document: none of them is earlier than another.
A row with a null doc_id keeps all its words, and no other row loses any to it. Extra columns pass through; input columns
``n_words`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.arrow_text import U64, frame, list_rows, mix, per_chunk, run_hashes, word_hashes, word_spans
from cardmill.llm.fm_index import FMIndex
from cardmill.llm.tables import BROADCAST_IDS, bounded_batches, join_ids, materialize, replace_columns

ANCHOR_WORDS = 8
SHARD_WORDS = 250_000  # of a shard's segments, on average
HOT_SEGMENTS = 5_000  # of one anchor in one shard, 500,000 words


def window_anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows inside a text, and position and hash of their anchors."""
    at = np.arange(len(words))
    row = np.searchsorted(first, at, "right") - 1
    starts = at[at + window <= first[row + 1]] if len(words) else at
    width = min(ANCHOR_WORDS, window)
    hashes = run_hashes(words, width)
    if not len(starts):
        return starts, starts, hashes[:0]
    # the least of `span` neighbours, doubling what is covered
    span, covered, place = window - width + 1, 1, np.arange(len(hashes))
    while covered < span:
        step = min(covered, span - covered)
        left, right = place[:-step], place[step:]
        place = np.where(hashes[right] < hashes[left], right, left)
        covered += step
    return starts, place[starts], hashes[place[starts]]


def sequence_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run words[begin:end], of any length."""
    step = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(step), -1, 1 << 64))
    powers = np.cumprod(np.concatenate(([U64(1)], np.full(len(words), step, U64))))
    inverses = np.cumprod(np.concatenate(([U64(1)], np.full(len(words), inverse, U64))))
    sums = np.concatenate(([U64(0)], np.cumsum(mix(words) * powers[:-1], dtype=U64)))
    return mix((sums[end] - sums[begin]) * inverses[begin] + (end - begin).astype(U64))


def segments(docs: DataFrame, window: int) -> DataFrame:
    """(doc, fp, anchor, sid, start, count) of every segment: its first window and their number; sid stands for its words."""
    names = ("doc", "fp", "anchor", "sid", "start", "count")
    schema = pa.schema([(n, pa.int32() if n in ("start", "count") else pa.int64()) for n in names])

    def function(rows, data, offsets):
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        at, place, anchor = window_anchors(words, first, window)
        begins = np.flatnonzero(np.diff(place, prepend=-1) != 0)
        count = np.diff(np.append(begins, len(at)))
        begin = at[begins]
        row = np.searchsorted(first, begin, "right") - 1
        doc, fp = (rows.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
        sid = sequence_hashes(words, begin, begin + count + window - 1)
        yield frame(schema, doc, fp, anchor[begins].view(np.int64), sid.view(np.int64), (begin - first[row]).astype(np.int32), count.astype(np.int32))

    return docs.mapInArrow(per_chunk(function, "text"), "doc long, fp long, anchor long, sid long, start int, count int")


def contents(docs: DataFrame, wanted: DataFrame, window: int, single: bool) -> DataFrame:
    """The words of the wanted segments (doc, fp, anchor, sid, start, count, owner), or of each of their windows."""
    lists = wanted.groupBy("doc", "fp").agg(F.collect_list(F.struct("anchor", "sid", "start", "count", "owner")).alias("want"))
    ids = wanted.select("doc", "fp").distinct()
    rows = join_ids(docs, ids, ["doc", "fp"], "left_semi").join(lists, ["doc", "fp"]).dropDuplicates(["doc", "fp"]).select("text", "want")
    schema = pa.schema([("route", pa.int64()), ("sid", pa.int64()), ("place", pa.int32()), ("owner", pa.int64()), ("words", pa.list_(pa.int32()))])

    def function(rows, data, offsets):
        starts, ends, first = word_spans(data, offsets)
        words = word_hashes(data, starts, ends)
        want = rows.column(1).combine_chunks() if isinstance(rows.column(1), pa.ChunkedArray) else rows.column(1)
        flat = want.flatten()
        anchor, sid, start, count, owner = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
        per_row = want.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.repeat(first[:-1], per_row) + start
        place = np.zeros(len(begin), np.int32)
        if single:
            spread = np.repeat(np.arange(len(begin)), count)
            place = (np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            begin, sid, owner, count = begin[spread] + place, sid[spread], owner[spread], np.ones(len(spread), np.int32)
            anchor = sequence_hashes(words, begin, begin + window).view(np.int64)
        # whole blocks, so that few segments are held as words at once
        for a in range(0, len(begin), 20_000):
            b, c = begin[a : a + 20_000], count[a : a + 20_000].astype(np.int64) + window - 1
            to = np.concatenate(([0], np.cumsum(c)))
            taken = words[np.repeat(b - to[:-1], c) + np.arange(to[-1])].astype(np.uint32).view(np.int32)
            yield frame(schema, anchor[a : a + 20_000], sid[a : a + 20_000], place[a : a + 20_000], owner[a : a + 20_000], list_rows(taken, to))

    return rows.mapInArrow(per_chunk(function, "text"), "route long, sid long, place int, owner long, words array<int>")


def least_owners(found: DataFrame, window: int) -> DataFrame:
    """(sid, owners): for every window of the segments (route, sid, owner, words), the smallest owner that has its words."""
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = 1 + total // SHARD_WORDS
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        first = np.concatenate(([0], np.cumsum([len(w) for w in part.words])))
        words = np.concatenate(list(part.words)).astype(np.int32).view(np.uint32)
        index = FMIndex(words, first, part.owner.to_numpy(np.int64), window)
        owners = index.least_owners(words, first)
        # the windows that reach over a segment's end are none
        return pd.DataFrame({"sid": part.sid, "owners": [owners[a : z - window + 1] for a, z in zip(first[:-1], first[1:], strict=True)]})

    return dealt.select("shard", "sid", "owner", "words").groupBy("shard").applyInPandas(search, "sid long, owners array<long>")


def repeated_ranges(docs: DataFrame, window: int = 50, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc, fp, begin, end): ranges of words of the documents (doc, fp, text) that an earlier document has."""
    cut = materialize(segments(docs.where("doc is not null"), window))
    # written, so that both sides of the join are shuffles whose hot anchors Spark can split
    shared = materialize(cut.groupBy("anchor").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("anchor"))
    cut = materialize(cut.join(shared, "anchor", "left_semi"))
    first = cut.groupBy("sid").agg(F.min(F.struct("doc", "fp", "start", "count", "anchor")).alias("s")).select("sid", "s.*", F.col("s.doc").alias("owner"))
    first = materialize(first)
    hot = materialize(first.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot_segments).select("anchor"))
    found = least_owners(materialize(contents(docs, first.join(hot, "anchor", "left_anti"), window, single=False)), window)
    if hot.take(1):
        alone = materialize(contents(docs, first.join(hot, "anchor", "left_semi"), window, single=True))
        least = alone.groupBy("route").agg(F.min("owner").alias("owner"), F.min("words").alias("words")).withColumn("sid", F.col("route"))
        each = least_owners(materialize(least), window).select(F.col("sid").alias("route"), F.col("owners")[0].alias("owner"))
        lists = alone.select("route", "sid", "place").join(each, "route").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("place", "owner"))).alias("x"))
        found = found.union(lists.select("sid", F.col("x.owner").alias("owners")))
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("begin", pa.int32()), ("end", pa.int32())])

    def ranges(batches):
        for batch in batches:
            doc, fp, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            size = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(doc)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            goes = np.flatnonzero(batch.column(3).flatten().to_numpy(zero_copy_only=False) < doc[row])
            if len(goes):
                new = np.append(True, (np.diff(goes) != 1) | (np.diff(row[goes]) != 0))
                a, z = goes[new], goes[np.append(new[1:], True)]
                begin, end = start[row[a]] + place[a], start[row[z]] + place[z] + window
                yield frame(schema, doc[row[a]], fp[row[a]], begin.astype(np.int32), end.astype(np.int32))

    met = cut.select("doc", "fp", "start", "sid").join(materialize(found), "sid").select("doc", "fp", "start", "owners")
    return met.where(F.array_min("owners") < F.col("doc")).mapInArrow(ranges, "doc long, fp long, begin int, end int")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """The documents without the words that go (and the blanks behind them), with ``n_words`` before and ``n_removed``."""
    docs = replace_columns(bounded_batches(docs), "n_words", "n_removed", "__doc", "__fp", "__cut")
    fingerprint = F.xxhash64(text)
    plain = docs.select(F.col(key).cast("long").alias("doc"), fingerprint.alias("fp"), F.col(text).alias("text"))
    gone = repeated_ranges(plain, window, hot_segments).groupBy("doc", "fp").agg(F.collect_set(F.struct("begin", "end")).alias("cut"))
    gone = materialize(gone)
    named = docs.withColumns({"__doc": F.col(key).cast("long"), "__fp": fingerprint})
    by_id = gone.select(F.col("doc").alias("__doc"), F.col("fp").alias("__fp"), F.col("cut").alias("__cut"))
    if gone.count() <= BROADCAST_IDS:  # only documents that lose words are shuffled
        ids = F.broadcast(by_id.drop("__cut"))
        changed = named.join(ids, ["__doc", "__fp"], "left_semi").join(by_id, ["__doc", "__fp"])
        same = named.join(ids, ["__doc", "__fp"], "left_anti").withColumn("__cut", F.lit(None).cast(by_id.schema["__cut"].dataType))
        named = changed.unionByName(same)
    else:
        named = named.join(by_id, ["__doc", "__fp"], "left")
    named = named.select(*[F.col(f"`{c}`") for c in docs.columns], "__cut")
    names, at = docs.columns, docs.columns.index(text)

    def function(rows, data, offsets):
        starts, ends, first = word_spans(data, offsets)
        cut = rows.column(len(names))
        flat, lengths = cut.flatten(), np.nan_to_num(cut.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        base = np.repeat(first[:-1], lengths)
        begin, end = (base + flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        covered = np.cumsum(np.bincount(begin, minlength=len(starts) + 1) - np.bincount(end, minlength=len(starts) + 1))[:-1] > 0 if len(begin) else np.zeros(len(starts), bool)
        lost = np.concatenate(([0], np.cumsum(covered)))
        removed = lost[first[1:]] - lost[first[:-1]]
        # a word that goes takes the bytes up to the next word of its text
        texts = rows.column(at)
        if removed.any():
            last = np.zeros(len(starts), bool)
            last[first[1:][np.diff(first) > 0] - 1] = True
            owner = np.searchsorted(first, np.arange(len(starts)), "right") - 1
            until = np.where(last, offsets[1:][owner], np.append(starts[1:], len(data)))
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, starts[covered], 1)
            np.add.at(edge, until[covered], -1)
            keep = np.cumsum(edge)[:-1] == 0
            kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
            new = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes()))
            whole = pa.array(removed > 0)
            texts = pa.compute.if_else(whole, new.cast(texts.type), texts)
        out = [texts if i == at else rows.column(i) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return named.mapInArrow(per_chunk(function, text), f"{schema}, n_words long, n_removed long")
