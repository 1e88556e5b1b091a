"""Exact top-k by inner product of whole-number vectors, on a bit-sliced index.

1. Components are quantised to floor(scale * x). Rows are dealt to blocks; a block keeps, for every component and every bit of
   (value - least value of the block), a bitmap over its rows, which are in the order of their ids.
2. A query's weights are written in digits 1, 0 and -1 (no two neighbours other than 0). Every digit adds the bitmaps of its
   component, shifted by the digit's place; a digit of -1 adds the complements. Bitmaps of one weight are added three at a
   time by carry-save steps into one bitmap and carries, so the scores of all rows are bitmaps of their bits.
3. From the most significant bitmap down, rows with the bit are better than those without: a set of sure rows and one of
   boundary rows are kept until as many as wanted are sure. What boundary rows are left have equal scores: those with the
   smallest ids are taken. Scores are read off the bitmaps.
4. A query's best rows of all blocks are ranked by score and id.

Each part of the queries meets each block once. A cell of that grid is bounded in rows and in queries; its results are
``first`` rows a query.

Defined results: rows with a null id, a null vector, or a vector with null or non-finite components take no part. Vectors may
differ in length; missing components count as 0. A row is no candidate of itself; other rows with its id are, and rows that
repeat a query's id are queries of their own. Quantised components and scores must fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.tables import bounded_batches, materialize

U64 = np.uint64
LEAST_BLOCKS = 8  # of rows
LEAST_PARTS = 2  # of queries
BLOCK_ROWS = 1 << 17
CELL_PAIRS = 1 << 33  # of queries and rows
QUERY_ROWS = 1024  # queries in one row of the table of queries
WORDS_AT_ONCE = 2048  # of a bitmap, over the queries that are added up together


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): the rows that take part, with whole components."""
    v = F.col(f"`{vector}`")
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & usable)
        .select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))
    )


def bitmaps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of bits of every column, and the bitmaps over the rows, column by column from the lowest bit."""
    n, width = values.shape
    least = values.min(axis=0)
    over = values.view(U64) - least.view(U64)
    bits = np.array([int(x).bit_length() for x in over.max(axis=0)], np.int64)
    words = -(-n // 64)
    out = np.zeros((int(bits.sum()), words), U64)
    k = 0
    for d in range(width):
        column = np.ascontiguousarray(over[:, d])
        for b in range(bits[d]):
            packed = np.packbits((column >> U64(b)) & U64(1) == 1, bitorder="little")
            out[k].view(np.uint8)[: len(packed)] = packed
            k += 1
    return least, bits, out


def signed_digits(weights: np.ndarray) -> list[np.ndarray]:
    """Digits 1, 0 and -1 of whole numbers, from the lowest place, none of them beside another that is not 0."""
    out, rest = [], weights.copy()
    while rest.any():
        digit = np.where(rest & 1, 2 - (rest & 3), 0)
        out.append(digit)
        # half first, so that the largest number does not overflow
        rest = (rest >> 1) + ((rest & 1) - digit >> 1)
    return out


def carry_save(rows: np.ndarray) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """Bitmaps (k, query, word) of one weight, added up in place: one bitmap of that weight, and the carries of the next."""
    carries = []
    while len(rows) > 1:
        k = len(rows) // 3
        if k:
            a, b, c, rest = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k], rows[3 * k :]
            carry = a & b
            a ^= b
            carry |= np.bitwise_and(a, c, out=b)
            a ^= c
            rows[k : k + len(rest)] = rest
            rows = rows[: k + len(rest)]
        else:
            carry = rows[:1] & rows[1:]
            rows = rows[:1] ^ rows[1:]
        carries.append(carry)
    return (rows[0] if len(rows) else None), carries


def add_slices(slices: np.ndarray, bits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Bitmaps (place, query, word) of the sums of weighted columns. ``slices`` hold the bitmaps, then their complements, then
    an empty one."""
    half, offset = len(slices) // 2, np.cumsum(bits) - bits
    entries = []
    for place, digit in enumerate(signed_digits(weights)):
        q, d = np.nonzero(digit)
        size = bits[d]
        b = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        entries.append((np.repeat(q, size), place + b, np.repeat(offset[d] + np.where(digit[q, d] < 0, half, 0), size) + b))
    query, place, row = (np.concatenate(x) for x in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((query, place))
    query, place, row = query[order], place[order], row[order]
    out, carries, p = [], [], 0
    while p <= place.max(initial=-1) or carries:
        a, z = np.searchsorted(place, (p, p + 1))
        count = np.bincount(query[a:z], minlength=len(weights))
        at = np.full((int(count.max(initial=0)), len(weights)), len(slices) - 1)
        at[np.arange(z - a) - np.repeat(np.cumsum(count) - count, count), query[a:z]] = row[a:z]
        rows = np.empty((len(at) + sum(map(len, carries)), len(weights), slices.shape[1]), U64)
        np.take(slices, at, axis=0, out=rows[: len(at)], mode="clip")
        if carries:
            np.concatenate(carries, out=rows[len(at) :])
        total, carries = carry_save(rows)
        out.append(np.zeros((len(weights), slices.shape[1]), U64) if total is None else total)
        p += 1
    return np.stack(out) if out else np.zeros((0, len(weights), slices.shape[1]), U64)


def select_top(sums: np.ndarray, open_: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of sure and of boundary rows: every sure row is better than every boundary row, and these are equal."""
    sure = np.zeros_like(open_)
    for slice_ in sums[::-1]:
        with_bit = open_ & slice_
        n = np.bitwise_count(sure).sum(axis=1, dtype=np.int64) + np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)
        over, under = (n > first)[:, None], (n <= first)[:, None]
        sure = np.where(under, sure | with_bit, sure)
        open_ = np.where(over, with_bit, open_ & ~slice_)
        open_[n == first] = 0
    return sure, open_


def set_rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_of_block(least: np.ndarray, bits: np.ndarray, maps: np.ndarray, n: int, weights: np.ndarray, own: np.ndarray, first: int):
    """(query, row, score) of the best rows of a block for queries with these weights; ``own`` is a query's own row or -1."""
    words = maps.shape[1]
    slices = np.concatenate((maps, ~maps, np.zeros((1, words), U64)))
    valid = np.full(words, ~U64(0))
    if n % 64:
        valid[-1] = (U64(1) << U64(n % 64)) - U64(1)
    # of digits -1: minus the largest value of as many bits, shifted by their place; sums wrap round at 64 bits and come back
    full = np.array([(1 << int(b)) - 1 for b in bits], U64)
    base = (weights.view(U64) * least.view(U64)).sum(axis=1, dtype=U64)
    for place, digit in enumerate(signed_digits(weights)):
        base -= ((digit < 0) * full).sum(axis=1, dtype=U64) << U64(place) if place < 64 else U64(0)
    out = []
    step = max(1, WORDS_AT_ONCE // max(1, words))
    for a in range(0, len(weights), step):
        some = weights[a : a + step]
        sums = add_slices(slices, bits, some)
        open_ = np.tile(valid, (len(some), 1))
        mine = np.flatnonzero(own[a : a + step] >= 0)
        at = own[a : a + step][mine]
        open_[mine, at // 64] &= ~(U64(1) << (at % 64).astype(U64))
        sure, boundary = select_top(sums, open_, first)
        for q in range(len(some)):
            rows = set_rows(sure[q])
            if len(rows) < first and boundary[q].any():
                rows = np.concatenate((rows, set_rows(boundary[q])[: first - len(rows)]))
            score = np.full(len(rows), base[a + q])
            for p in range(min(64, len(sums))):
                score += ((sums[p, q][rows // 64] >> (rows % 64).astype(U64)) & U64(1)) << U64(p)
            out.append((np.full(len(rows), a + q), rows, score.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


INDEX = "block int, ids array<long>, least array<long>, bits array<long>, maps binary, part int, at array<long>, queries array<long>, weights array<long>"


def sliced(rows: DataFrame, width: int, blocks: int, every: int) -> DataFrame:
    """The index, a row per block (``maps`` not null), and its rows that are queries, a row for some hundreds of them."""
    schema = pa.schema([
        ("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("maps", pa.binary()),
        ("part", pa.int32()), ("at", pa.list_(pa.int64())), ("queries", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])

    def run(batches):
        ids, values = [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            some = np.zeros((len(size), width), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            some[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            ids.append(batch.column(0).to_numpy())
            values.append(some)
        ids, values = np.concatenate(ids), np.concatenate(values)
        if not len(ids):
            return
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        block = TaskContext.get().partitionId()
        least, bits, maps = bitmaps(values)
        yield pa.record_batch([[block], [ids], [least], [bits], [maps.tobytes()], [None], [None], [None], [None]], schema=schema)
        asking = np.flatnonzero(ids % every == 0)
        for k in range(0, len(asking), QUERY_ROWS):
            at = asking[k : k + QUERY_ROWS]
            yield pa.record_batch([[block], [None], [None], [None], [None], [k // QUERY_ROWS], [at], [ids[at]], [values[at].ravel()]], schema=schema)

    return rows.repartition(blocks).mapInArrow(run, INDEX)


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, every: int = 20, first: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` its ``first`` best rows."""
    rows = quantised(bounded_batches(vectors), key, vector, scale)
    n, asking, width = rows.agg(F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.size("v"))).first()
    width = width or 0
    blocks = max(LEAST_BLOCKS, math.ceil(n / BLOCK_ROWS))
    parts = max(LEAST_PARTS, math.ceil(asking * n / blocks / CELL_PAIRS))
    index = materialize(sliced(rows, width, blocks, every))
    last = index.agg(F.max("block")).first()[0] or 0
    side = index.where("maps is not null").select("block", "ids", "least", "bits", "maps", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cell"))
    asked = index.where("maps is null").select(
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"), ((F.col("block") + F.col("part")) % parts).alias("cell"),
        F.col("block").alias("home"), "at", "queries", "weights")
    schema = pa.schema([("query_id", pa.int64()), ("home", pa.int32()), ("at", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block = left.column("block")[0].as_py()
            ids, least, bits = (left.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "least", "bits"))
            maps = np.frombuffer(left.column("maps")[0].as_buffer(), U64).reshape(int(bits.sum()), -(-len(ids) // 64))
            for r in right.select(["home", "at", "queries", "weights"]).to_batches():
                for k in range(r.num_rows):
                    home = r.column(0)[k].as_py()
                    at, asked_ids, weights = (r.column(c)[k].values.to_numpy() for c in (1, 2, 3))
                    weights = weights.reshape(len(at), width)
                    q, row, score = best_of_block(least, bits, maps, len(ids), weights, at if home == block else np.full(len(at), -1), first)
                    out.append(pa.table([pa.array(asked_ids[q]), pa.array(np.full(len(q), home, np.int32)), pa.array(at[q]), pa.array(ids[row]), pa.array(score)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = side.groupBy("block", "cell").cogroup(asked.groupBy("block", "cell")).applyInArrow(meet, "query_id long, home int, at long, vec_id long, score long")
    rank = Window.partitionBy("query_id", "home", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= first).select("query_id", "rank", "vec_id", "score")


def oracle(table: str = "embeddings", scale: int = 64, every: int = 20, first: int = 20) -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {table}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % {every} = 0
)
SELECT query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {first}
"""
