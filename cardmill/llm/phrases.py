"""Phrases of two to four words that occur together more often than their parts suggest, with exact counts.

Every word of a text starts a suffix: its words up to the fourth, or to the end of its piece (pieces end at marks and line
ends). The count of a phrase is the number of suffixes that begin with it.

1. A sketch of fixed size tells which pairs of neighbours can be frequent: a pair whose bucket stays below the least count
   is not. A suffix ends before the first pair that is not, as no frequent phrase goes on over it.
2. Equal suffixes of one part of the texts are one row with a count. Suffixes are routed by their leading words: shards are
   ranges of (language, words) whose bounds come from a sample, so a hot leading word is split by the words that follow it.
3. In a shard, a multikey three-way quicksort orders pointers to the suffixes: a partition is split by a pivot at one depth
   into smaller, equal and larger ones. The size of an equal partition is the count of its phrase, and it goes on at the
   next depth. Any partition that is too small to hold a frequent phrase is abandoned.
4. Prefixes of a shard's first and last suffix may go on in the next shard. They are counted apart, and their counts added up.

Cuts, containment and ranks are joins and aggregates over the frequent phrases.

Defined results: a null text is empty, a null language is ``und``. Rows are counted each, whatever keys they repeat. Words are
compared by 64-bit hashes. A text is one row of one task; there is no other bound on its length. A language with no
candidate, and an empty table, have no rows. Columns other than the language and the text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.arrow_text import LOWER, STEP, U64, mix, per_chunk, release_memory, spread_rows, word_hashes, word_spans
from cardmill.llm.tables import bounded_batches, materialize

DEPTH = 4  # words of the longest phrase
UNKNOWN = "und"
CHUNK = 4 << 20  # bytes of text whose equal suffixes become one row
SKETCH_BITS = 24  # buckets of pairs: 2 MB of flags broadcast, whatever the corpus
SLICE_BITS = 16  # buckets of one slice of the sketch on its way to be added up
WORD_BITS = 24  # flags of the words whose text is looked up
SHARD_ROWS = 250_000  # suffixes of a shard
SAMPLE = 1 << 18  # suffixes that the bounds of the shards are taken from, over all tasks
SAMPLE_ROW = 1 << 11  # suffixes of the sample in one row: 80 KB, as a large value is copied several times on its way

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"]] = True
BREAK[10:14] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True


def suffix_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The hash of every word, how many words its piece has from it on (four at most), and its place: start, end and row."""
    starts, ends, first = word_spans(data, offsets, GAP)
    row = spread_rows(first)
    hashes = word_hashes(data, starts, ends, lower=True)
    n = len(starts)
    if not n:
        return hashes, np.zeros(0, np.int8), (starts, ends, row)
    marks = np.concatenate(([0], np.cumsum(BREAK[data], dtype=np.int64)))[starts]
    joined = np.zeros(n, bool)  # with the next word
    joined[:-1] = (marks[1:] == marks[:-1]) & (row[1:] == row[:-1])
    return hashes, reach(joined), (starts, ends, row)


def reach(joined: np.ndarray) -> np.ndarray:
    """How many words from each one on are joined, four at most."""
    length = np.ones(len(joined), np.int8)
    on = joined.copy()
    for k in range(1, DEPTH):
        length += on
        if k < len(joined):
            on[:-k] &= joined[k:]
        on[-k:] = False
    return length


def pair_bucket(languages: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bucket of each word and the next one, in its language."""
    after = np.roll(hashes, -1) if len(hashes) else hashes
    return (mix(languages * STEP + hashes * U64(3) + after) >> U64(64 - SKETCH_BITS)).astype(np.int64)


def columns_of(hashes: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The words of every suffix by depth; zero beyond its end."""
    out = []
    for k in range(DEPTH):
        column = np.zeros(len(hashes), U64)
        column[: max(0, len(hashes) - k)] = hashes[k:]
        column[length <= k] = 0
        out.append(column)
    return out


def with_language(docs: DataFrame, language: str, text: str) -> DataFrame:
    return bounded_batches(docs).select(F.coalesce(F.col(f"`{language}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))


def row_languages(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)


def survey(docs: DataFrame, least: int) -> tuple[np.ndarray, list]:
    """Flags of the buckets of pairs that may be frequent, and a sample of suffixes (weight, words). The words come to the driver
    as bytes (10 MB in all): as lists of numbers they are objects there, in the JVM and in Python, ten times as large."""
    slices, size = 1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS
    a_task = max(4, SAMPLE // max(1, docs.rdd.getNumPartitions()))

    def run(batches):
        total = np.zeros(slices * size, np.uint8)
        seen, kept, order = 0, [], np.zeros(0)
        rng = np.random.default_rng(0)

        def add(rows, data, offsets):
            nonlocal seen, kept, order
            hashes, length, (_, _, row) = suffix_words(data, offsets)
            languages = row_languages(rows)[row]
            pairs, counts = np.unique(pair_bucket(languages, hashes)[length > 1], return_counts=True)
            total[pairs] = np.minimum(total[pairs].astype(np.int64) + counts, least)  # more than enough is enough
            # the suffixes with the smallest random numbers of the task
            seen += len(hashes)
            numbers = rng.random(len(hashes))
            some = np.argpartition(numbers, a_task)[:a_task] if len(numbers) > a_task else np.arange(len(numbers))
            spread = np.stack([languages, *columns_of(hashes, length)])[:, some] if len(some) else np.zeros((DEPTH + 1, 0), U64)
            kept = np.concatenate([*([kept] if len(kept) else []), spread], axis=1)
            order = np.concatenate((order, numbers[some]))
            best = np.argsort(order)[:a_task]
            kept, order = kept[:, best], order[best]
            return ()

        for _ in per_chunk(add, "text", CHUNK)(batches):
            pass
        for k in range(slices):
            part = total[k * size : (k + 1) * size]
            if part.any():
                yield pa.record_batch([[k], [part.tobytes()], [None], [None]], schema=schema)
        for a in range(0, kept.shape[1] if seen else 0, SAMPLE_ROW):
            yield pa.record_batch([[-1], [None], [seen / kept.shape[1]], [kept[:, a : a + SAMPLE_ROW].T.tobytes()]], schema=schema)

    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary()), ("weight", pa.float64()), ("words", pa.binary())])
    found = materialize(docs.mapInArrow(run, "slice int, counts binary, weight double, words binary"))

    def add_up(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.uint32)
                totals[k] = np.minimum(totals.get(k, 0) + part, least)
        for k, total in totals.items():
            yield pa.record_batch([pa.array([k], pa.int32()), [np.packbits(total >= least).tobytes()]], names=["slice", "flags"])

    counted = found.where("slice >= 0").select("slice", "counts").repartition(min(slices, 32), "slice")
    flags = np.zeros(slices * size // 8, np.uint8)
    for r in counted.mapInArrow(add_up, "slice int, flags binary").collect():  # at most 256 rows of 8 KB
        flags[r.slice * size // 8 : (r.slice + 1) * size // 8] = np.frombuffer(r.flags, np.uint8)
    return flags, found.where("slice < 0").select("weight", "words").collect()


def is_set(flags: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (flags[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1


def cut_at_rare_pairs(flags: np.ndarray, languages: np.ndarray, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The lengths of suffixes that end before their first pair that can't be frequent."""
    return reach((length > 1) & is_set(flags, pair_bucket(languages, hashes)))


def bounds(flags: np.ndarray, sample: list, shard_rows: int) -> np.ndarray:
    """First suffixes (language and words) of all shards but the first, in order."""
    words = [np.frombuffer(r.words, U64).reshape(-1, DEPTH + 1) for r in sample]
    if not words:
        return np.zeros((0, DEPTH + 1), U64)
    weight = np.concatenate([np.full(len(w), r.weight) for w, r in zip(words, sample, strict=True)])
    words = np.concatenate(words)
    # a suffix of one word is shared by many places
    bucket = (mix(words[:, 0] * STEP + words[:, 1] * U64(3) + words[:, 2]) >> U64(64 - SKETCH_BITS)).astype(np.int64)
    weight = np.where((words[:, 2] != 0) & is_set(flags, bucket), weight, weight / 16)
    order = np.lexsort(words.T[::-1])
    words, reached = words[order], np.cumsum(weight[order])
    shards = math.ceil(reached[-1] / shard_rows)
    at = np.searchsorted(reached, reached[-1] * np.arange(1, shards) / shards)
    return np.unique(words[np.minimum(at, len(words) - 1)], axis=0)


def lower_bound(columns: list[np.ndarray], key: np.ndarray) -> int:
    """The place of the first sorted row that is not below the key."""
    a, z = 0, len(columns[0])
    for column, x in zip(columns, key, strict=True):
        left, right = np.searchsorted(column[a:z], x, "left"), np.searchsorted(column[a:z], x, "right")
        a, z = a + int(left), a + int(right)
        if a == z:
            break
    return a


def suffixes(docs: DataFrame, flags: np.ndarray, edges: np.ndarray) -> DataFrame:
    """(shard, language, w1 to w4, n): the distinct suffixes of parts of the texts, a row per part and shard."""
    shared = docs.sparkSession.sparkContext.broadcast((flags, edges))
    schema = pa.schema([("shard", pa.int32())] + [(c, pa.list_(pa.int64())) for c in ("language", "w1", "w2", "w3", "w4", "n")])

    def function(rows, data, offsets):
        flags, edges = shared.value
        hashes, length, (_, _, row) = suffix_words(data, offsets)
        if not len(hashes):
            return
        languages = row_languages(rows)[row]
        length = cut_at_rare_pairs(flags, languages, hashes, length)
        columns = [languages, *columns_of(hashes, length)]
        whole = columns[0]
        for c in columns[1:]:
            whole = mix(whole * STEP + c)
        _, at, count = np.unique(whole, return_index=True, return_counts=True)
        columns = [c[at] for c in columns]
        order = np.lexsort(columns[::-1])
        columns, count = [c[order] for c in columns], count[order]
        cuts = [0, *(lower_bound(columns, key) for key in edges), len(count)]
        parts = [(k, a, z) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        first = pa.array([0] + [z for _, _, z in parts], pa.int32())
        lists = [pa.ListArray.from_arrays(first, pa.array(c.view(np.int64))) for c in [*columns, count.astype(np.int64)]]
        yield pa.record_batch([pa.array([k for k, _, _ in parts], pa.int32()), *lists], schema=schema)

    names = ", ".join(f"{c} array<long>" for c in ("language", "w1", "w2", "w3", "w4", "n"))
    return docs.mapInArrow(per_chunk(function, "text", CHUNK), f"shard int, {names}")


def three_way(columns: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the rows: (depth, a pointer to a row, the weight of all rows with the same
    first keys) of every such partition with the least weight. All open partitions take a step at once. A key of zero ends
    a row, the first key never."""
    pointers, rng = np.arange(len(weight)), np.random.default_rng(0)
    edge, depth = np.array([0, len(weight)]), np.zeros(1, np.int64)  # of the open partitions
    found = []
    while len(pointers):
        size = np.diff(edge)
        part = np.repeat(np.arange(len(size)), size)
        keys = np.empty(len(pointers), U64)
        for d in np.unique(depth):
            mine = depth[part] == d
            keys[mine] = columns[d][pointers[mine]]
        a, b, c = keys[edge[:-1] + (rng.random((3, len(size))) * size).astype(np.int64)]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = (keys >= pivot).astype(np.int8) + (keys > pivot)
        # pointers move to the smaller, equal and larger rows of their partition, in their order
        to = np.empty(len(pointers), np.int64)
        counts, placed = np.empty((len(size), 3), np.int64), edge[:-1].copy()
        for s in range(3):
            mine = side == s
            before = np.concatenate(([0], np.cumsum(mine)))
            counts[:, s] = before[edge[1:]] - before[edge[:-1]]
            to[mine] = (placed[part] + before[:-1] - before[edge[:-1]][part])[mine]
            placed += counts[:, s]
        moved = np.empty_like(pointers)
        moved[to] = pointers
        counts = counts.ravel()
        begin = np.concatenate(([0], np.cumsum(counts)))
        sums = np.concatenate(([0], np.cumsum(weight[moved])))
        heavy = sums[begin[1:]] - sums[begin[:-1]]
        depths, sides = np.repeat(depth, 3), np.tile(np.arange(3), len(depth))
        first = moved[np.minimum(begin[:-1], len(moved) - 1)]
        equal_key = np.empty(len(counts), U64)
        for d in np.unique(depths):
            equal_key[depths == d] = columns[d][first[depths == d]]
        alive = (counts > 0) & (heavy >= least)
        ended = (sides == 1) & (depths > 0) & (equal_key == 0)
        told = alive & (sides == 1) & ~ended
        for d in np.unique(depths[told]):
            these = told & (depths == d)
            found.append((int(d) + 1, first[these], heavy[these]))
        alive &= ~ended & ~((sides == 1) & (depths == len(columns) - 1))
        pointers = moved[np.repeat(alive, counts)]
        edge = np.concatenate(([0], np.cumsum(counts[alive])))
        depth = (depths + (sides == 1))[alive]
    return found


def shard_counts(columns: list[np.ndarray], weight: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(keys of a prefix, rows that show them, counts, partial) for a shard: its frequent prefixes, and those that may go on
    in another shard."""
    out, edges = [], set()
    for end in (end_row(columns, np.min), end_row(columns, np.max)):
        same = np.ones(len(weight), bool)
        for d, column in enumerate(columns):
            if d and column[end] == 0:
                break
            same &= column == column[end]
            prefix = (d + 1, tuple(c[end] for c in columns[: d + 1]))
            if prefix not in edges:
                edges.add(prefix)
                out.append((d + 1, np.array([end]), np.array([weight[same].sum()]), True))
    for depth, rows, counts in three_way(columns, weight, least):
        inner = np.ones(len(rows), bool)
        for d, key in edges:
            if d == depth:
                inner &= ~np.logical_and.reduce([columns[k][rows] == key[k] for k in range(depth)])
        out.append((depth, rows[inner], counts[inner], False))
    return out


def end_row(columns: list[np.ndarray], end) -> int:
    """The first or last row in the order of all columns."""
    rows = np.arange(len(columns[0]))
    for column in columns:
        rows = rows[column[rows] == end(column[rows])]
    return int(rows[0])


def counted(parts: DataFrame, least: int, shards: int) -> DataFrame:
    """(language, depth, words, count): the prefixes of suffixes that occur often enough; depth 0 is all of a language."""
    schema = pa.schema([("language", pa.int64()), ("depth", pa.int32()), ("words", pa.list_(pa.int64())), ("f", pa.int64()), ("partial", pa.bool_())])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                held.setdefault(shard, []).append([batch.column(c)[k].values.to_numpy() for c in range(1, 7)])
        for shard in sorted(held):
            rows = held.pop(shard)
            *columns, weight = (np.concatenate(x) for x in zip(*rows, strict=True))
            columns = [c.view(U64) for c in columns]
            for depth, at, counts, partial in shard_counts(columns, weight, least):
                # a language is a prefix without words, and goes on in other shards
                words = np.stack([columns[d][at] for d in range(1, depth)], axis=1).ravel() if depth > 1 else np.zeros(0, U64)
                first = np.arange(len(at) + 1) * (depth - 1)
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.record_batch(
                    [pa.array(columns[0][at].view(np.int64)), pa.array(np.full(len(at), depth - 1, np.int32)), lists, pa.array(counts.astype(np.int64)), pa.array(np.full(len(at), partial))],
                    schema=schema)
        release_memory()

    found = materialize(parts.repartition(shards, "shard").mapInArrow(run, "language long, depth int, words array<long>, f long, partial boolean"))
    keys = ["language", "depth", "words"]
    # a language's own count is partial in every shard, also where it is below the least count
    split = found.where("partial").groupBy(*keys).agg(F.sum("f").alias("f"))
    split = split.unionByName(found.where("not partial and depth = 0").select(*keys, "f")).groupBy(*keys).agg(F.sum("f").alias("f"))
    return materialize(found.where("not partial and depth > 0").select(*keys, "f").unionByName(split.where((F.col("f") >= least) | (F.col("depth") == 0))))


def big(column: Column) -> Column:
    """A whole number with room for products beyond 64 bits."""
    return column.cast("decimal(20,0)")


def parts_of(words: Column, depth: int) -> Column:
    """All proper parts of a phrase of ``depth`` words that have two words or more."""
    return F.array(*[F.slice(words, a + 1, k) for k in range(2, depth) for a in range(depth - k + 1)])


def candidates(frequent: DataFrame, contained: int) -> DataFrame:
    """(language, words, f, l, r, score) of the phrases that stand for themselves, each cut where it holds together least."""
    phrases = frequent.where("depth >= 2")
    cut = phrases.select("language", "words", "f", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cut = cut.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    counts = frequent.where("depth >= 1")
    cut = cut.join(counts.select("language", F.col("words").alias("head"), F.col("f").alias("l")), ["language", "head"])
    cut = cut.join(counts.select("language", F.col("words").alias("rest"), F.col("f").alias("r")), ["language", "rest"])
    cut = cut.withColumn("score", F.expr("(decimal(2000000) * cast(f as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    least = cut.groupBy("language", "words", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = None
    for depth in (3, 4):
        some = phrases.where(F.col("depth") == depth).select("language", F.explode(parts_of(F.col("words"), depth)).alias("words"), F.col("f").alias("most"))
        longer = some if longer is None else longer.union(some)
    longer = longer.groupBy("language", "words").agg(F.max("most").alias("most"))
    free = F.col("most").isNull() | (big(F.col("most")) * 100 < big(F.col("f")) * contained)
    found = least.join(longer, ["language", "words"], "left").where(free)
    return found.select("language", "words", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def word_flags(wanted: DataFrame) -> np.ndarray:
    """Flags of the buckets of all wanted words, eight to a byte. They come to the driver in one job, as 2048 rows of 1 KB at most."""
    size, row = (1 << WORD_BITS) // 8, 1 << 10  # bytes

    def mark(batches):
        flags = np.zeros(1 << WORD_BITS, bool)
        for batch in batches:
            flags[(batch.column(0).to_numpy().view(U64) >> U64(64 - WORD_BITS)).astype(np.int64)] = True
        packed = np.packbits(flags).reshape(-1, row)
        for k in np.flatnonzero(packed.any(axis=1)):
            yield pa.record_batch([pa.array([k], pa.int32()), [packed[k].tobytes()]], names=["part", "flags"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, flags in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[k] = held.get(k, np.uint8(0)) | np.frombuffer(flags.as_buffer(), np.uint8)
        for k, flags in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), [flags.tobytes()]], names=["part", "flags"])

    marked = wanted.mapInArrow(mark, "part int, flags binary").repartition(32, "part")
    flags = np.zeros(size, np.uint8)
    for r in marked.mapInArrow(merge, "part int, flags binary").collect():
        flags[r.part * row : (r.part + 1) * row] = np.frombuffer(r.flags, np.uint8)
    return flags


def word_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, written): the text of every wanted word (hash)."""
    shared = docs.sparkSession.sparkContext.broadcast(word_flags(wanted))

    def function(rows, data, offsets):
        starts, ends, _ = word_spans(data, offsets, GAP)
        hashes, at = np.unique(word_hashes(data, starts, ends, lower=True), return_index=True)
        mine = is_set(shared.value, (hashes >> U64(64 - WORD_BITS)).astype(np.int64))
        hashes, at = hashes[mine], at[mine]
        written = [LOWER[data[starts[i] : ends[i]]].tobytes().decode("utf-8", "replace") for i in at]
        yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(written, pa.string())], names=["word", "written"])

    found = docs.mapInArrow(per_chunk(function, "text", CHUNK), "word long, written string")
    return found.groupBy("word").agg(F.min("written").alias("written")).join(wanted, "word", "left_semi")


def collocations(docs: DataFrame, language: str = "lang", text: str = "text", least: int = 30, contained: int = 80, first: int = 2000, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases. ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts, ``n`` all words."""
    named = with_language(docs, language, text)
    plain = named.select(F.xxhash64("lang").alias("language"), "text")
    flags, sample = survey(plain, least)
    edges = bounds(flags, sample, shard_rows)
    frequent = counted(suffixes(plain, flags, edges), least, len(edges) + 1)
    found = candidates(frequent, contained)
    # phrases that may be among the first, whatever their letters; a rank of so many needs a group limit only
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"))
    found = materialize(found.withColumn("place", F.rank().over(order)).where(F.col("place") <= first).drop("place"))
    wanted = materialize(found.select(F.explode("words").alias("word")).distinct())
    texts = materialize(word_texts(plain, wanted))
    spelt = found.select("language", "words", F.posexplode("words").alias("i", "word")).join(texts, "word")
    spelt = spelt.groupBy("language", "words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "written"))), lambda x: x.written), " ").alias("phrase"))
    rank = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.join(spelt, ["language", "words"]).withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= first)
    totals = frequent.where("depth = 0").select("language", F.col("f").alias("n"))
    names = named.select("lang").distinct().select(F.xxhash64("lang").alias("language"), "lang")
    return found.join(totals, "language").join(names, "language").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(table: str = "documents", least: int = 30, contained: int = 80, first: int = 2000) -> str:
    """The same rows in DuckDB SQL."""
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, {' || chr(32) || '.join(f'w{k}' for k in range(1, d + 1))} AS p, {d} AS d FROM g WHERE w{d} IS NOT NULL" for d in range(1, DEPTH + 1))
    after = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc, piece ORDER BY i) AS w{k + 1}" for k in range(1, DEPTH))
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '{UNKNOWN}') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM {table}
), s AS (
  SELECT doc, lang, unnest(parts) AS part, unnest(range(len(parts))) AS piece FROM (SELECT doc, lang, regexp_split_to_array(body, '[.,;:!?\\x0A-\\x0D]') AS parts FROM t)
), x AS (
  SELECT doc, lang, piece, unnest(words) AS w, unnest(range(len(words))) AS i
  FROM (SELECT doc, lang, piece, regexp_extract_all(part, '[^\\x20\\x09]+') AS words FROM s)
), g AS (
  SELECT lang, w AS w1, {after} FROM x
), f AS (
  SELECT lang, p, d, count(*) AS f FROM ({grams}) GROUP BY ALL
), c AS (
  SELECT lang, p, d, f AS a, string_split(p, ' ') AS w FROM f WHERE d >= 2 AND f >= {least}
), k AS (
  SELECT lang, p, a, w, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, d)) AS k FROM c)
), m AS (
  SELECT k.lang, k.p, k.a, k.k, x.f AS l, y.f AS r, (2000000::HUGEINT * k.a) // (x.f + y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.p = k.head JOIN f y ON y.lang = k.lang AND y.p = k.rest
), b AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), o AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, array_to_string(w[i:i + z - 1], ' ') AS part
    FROM (SELECT *, unnest(range(1, d - z + 2)) AS i FROM (SELECT *, unnest(range(2, d)) AS z FROM c WHERE d > 2))
  ) GROUP BY ALL
), n AS (
  SELECT lang, count(*) AS n FROM x GROUP BY lang
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.p) AS rank, b.p AS phrase, b.a, b.l::BIGINT AS l, b.r::BIGINT AS r, n.n, b.score::BIGINT AS score
FROM b JOIN n USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.part = b.p
WHERE o.most IS NULL OR 100 * o.most < {contained} * b.a
QUALIFY rank <= {first}
"""
