"""Packing of tokenized documents into as few sequences of bounded length as possible.

Documents are tokenized in batches: each different word once per worker, as no token crosses white space. A document's ids
end with one more id; only longer documents are cut. Pieces are dealt evenly, without a key, to blocks of bounded size,
each packed by bin completion: best-fit decreasing gives the first solution. While a block has more sequences than its lower
bound, the pieces of its loosest ones, and of some others among them, go to a branch and bound search in groups that have a
sequence's worth of blanks and are small enough to reach complete solutions; full sequences stay. The search completes one
sequence after another around the largest piece left. It tries every undominated filling (no piece left over fits or could
replace a smaller one in it), made as they are asked for, the fullest of each few first, and gives up a branch as soon as the
blanks so far exceed what a better solution may have. A step is a filling, or a part of one, that was tried; the best solution
found within ``steps`` stays, and no group of pieces is searched twice. With ``steps=None`` each block is searched to its end
and has as few sequences as there can be. What stands in each block's emptiest sequences is then packed once more across blocks.

Defined results: a null or empty text is the single closing id. Rows that repeat a document are packed each. Columns of the
input other than the key and the text are left out, as a row is a piece.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.llm.arrow_text import chunks, frame, release_memory, spread_rows, word_hashes, word_spans
from cardmill.llm.tables import bounded_batches, materialize

BLOCK_PIECES = 20_000
SEARCH_STEPS = 100_000  # of a block's searches; None searches it to the end
FILLINGS = 4  # put in order at a time
GROUP_PIECES = 60  # of a search at least, twice as many every other time, if its sequences have more blanks than one sequence before
GROUP_STEPS = 4_000  # of a search; more if its pieces could need more for a first complete solution
CACHED_WORDS = 600_000  # of a task, about 30 MB; beyond that it starts anew
TOGETHER = 4_000  # words given to the tokenizer at once
AGAIN, FULL = 1 << 60, 1 << 61  # where the numbers of repacked and of full sequences begin
CHUNK = 2 << 20  # bytes of text at once: words repeat, so larger parts have fewer different ones
LOOSE = 0.97  # sequences filled less are packed once more


def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """The ids of words, each different word of a task tokenized once. Its tokenizer and most of its memory belong to one
    task; a worker's next task begins with the words that were met more than once."""

    def __init__(self):
        self.tokenizer = None
        self.clear()

    def clear(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of words in order, and their slots
        self.size, self.begin, self.ids = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.hits = np.zeros(1 << 16, np.int32)  # parts of text that had the word
        self.used = 0  # of ids

    def keep_frequent(self) -> None:
        """Forget the words that one part of text had only."""
        frequent = self.hits[self.slots] > 1
        known, slots = self.known[frequent], self.slots[frequent]
        size, begin, ids = self.size[slots], self.begin[slots], self.ids
        self.clear()
        n, edge = len(known), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        self.known, self.slots, self.used = known, np.arange(n, dtype=np.int32), int(edge[-1])
        self.size, self.begin, self.hits = size.copy(), edge[:-1].copy(), np.ones(n, np.int32)
        self.ids = ids[np.repeat(begin - edge[:-1], size) + np.arange(edge[-1])]
        if not n:
            self.clear()

    def tokenize(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has. Words go to the tokenizer as lines of one text, as no token crosses a line."""
        ids, sizes = [], []
        for a in range(0, len(starts), TOGETHER):
            first, size = starts[a : a + TOGETHER], (ends - starts)[a : a + TOGETHER]
            edge = np.cumsum(size + 1)
            lines = np.full(edge[-1], 10, np.uint8)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            lines[at + np.repeat(edge - size - 1, size)] = data[at + np.repeat(first, size)]
            found = self.tokenizer.encode(lines.tobytes().decode("utf-8", "replace"), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            characters = np.cumsum((lines & 0xC0) != 0x80)[edge - 1]  # up to the end of every line
            begin = np.array([s for s, _ in found.offsets], np.int64)
            sizes.append(np.bincount(np.searchsorted(characters, begin, "right"), minlength=len(first)))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slots of new words."""
        ids, size = self.tokenize(data, starts, ends)
        slots = len(self.known) + np.arange(len(hashes))
        while len(self.size) < slots[-1] + 1:
            self.size, self.begin, self.hits = (np.resize(x, 2 * len(x)) for x in (self.size, self.begin, self.hits))
        self.hits[slots] = 1
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[slots], self.begin[slots] = size, self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.slots = np.insert(self.known, at, hashes), np.insert(self.slots, at, slots)
        return slots

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin."""
        starts, ends, first = word_spans(data, offsets)
        hashes, at, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.keep_frequent()
        place = np.searchsorted(self.known, hashes)
        new = np.append(self.known, np.uint64(0))[place] != hashes
        new[place == len(self.known)] = True
        slots = np.append(self.slots, np.int32(0))[place].astype(np.int64)
        self.hits[slots[~new]] += 1
        if new.any():
            slots[new] = self.learn(hashes[new], data, starts[at[new]], ends[at[new]])
        slot = slots[inverse]
        size = self.size[slot]
        edge = np.concatenate(([0], np.cumsum(size)))
        return self.ids[np.repeat(self.begin[slot] - edge[:-1], size) + np.arange(edge[-1])], edge[first]


@cache
def frequent_words(path: str) -> WordIds:
    """What this worker keeps from task to task: some megabytes of words."""
    return WordIds()


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document's pieces; ``ids`` only where they are wanted, as Spark
    can't leave out what Python has made."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32())))

    def cut(rows, data, offsets, words):
        ids, first = words.texts(data, offsets)
        # the closing id after each text's
        n = len(first) - 1
        whole = np.full(len(ids) + n, end_id, np.uint32)
        whole[np.arange(len(ids)) + spread_rows(first)] = ids
        first = first + np.arange(n + 1)
        size = np.diff(first)
        count = -(-size // capacity)
        row = np.repeat(np.arange(n), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        begin = first[row] + start
        crc = np.array([zlib.crc32(whole[a : a + k].astype("<u4").tobytes()) for a, k in zip(begin, length, strict=True)], np.int64)
        columns = [pa.array(rows.column(0)).take(pa.array(row)), piece.astype(np.int32), start, length, crc]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(whole)), pa.int32()), pa.array(whole.view(np.int32))))
        return frame(schema, *columns)

    def run(batches):
        words = frequent_words(path)
        words.tokenizer = tokenizer(path)
        for rows, data, offsets in chunks(batches, "text", CHUNK):
            yield cut(rows, data, offsets, words)
        words.tokenizer = None
        words.keep_frequent()
        release_memory()

    return bounded_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    )


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: every piece goes where the least room is left. Lengths must not rise; returns piece numbers."""
    bins, rooms = [], []  # rooms: (room, bin), sorted
    for i, length in enumerate(lengths):
        at = bisect_right(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > length:
            insort(rooms, (room - length, b))
    return bins


class Steps:
    """A number of steps to take, or None for as many as it needs."""

    def __init__(self, left: int | None):
        self.left, self.taken = left, 0

    def take(self, n: int = 1) -> bool:
        """Whether there was such a number left."""
        self.taken += n
        if self.left is None:
            return True
        self.left -= n
        return self.left >= 0


class OutOfSteps(Exception):
    pass


def fillings(sizes: list[int], have: list[int], room: int, steps: Steps) -> Iterator[list[int]]:
    """Every undominated way to fill the room, as numbers of pieces of each size (sizes fall): no piece left out fits in what
    stays empty, and none could replace a smaller chosen one. Larger pieces are tried first."""
    below = [0] * (len(sizes) + 1)  # all pieces of a size and smaller ones
    for k in range(len(sizes) - 1, -1, -1):
        below[k] = below[k + 1] + sizes[k] * have[k]
    chosen = [0] * len(sizes)

    def fill(k: int, room: int, out: int) -> Iterator[list[int]]:
        # out: the smallest piece left out so far, which must not fit at the end
        if not steps.take():
            raise OutOfSteps
        if room - below[k] >= out:
            return
        while k < len(sizes) and (not have[k] or sizes[k] > room):
            if have[k]:
                out = sizes[k]
            k += 1
        if k == len(sizes):
            left = [x for x, n, c in zip(sizes, have, chosen, strict=True) if n > c] if room else []
            if not any(c and any(x < y <= x + room for y in left) for x, c in zip(sizes, chosen, strict=True)):
                yield list(chosen)
            return
        most = min(have[k], room // sizes[k])
        for n in range(most, -1, -1):
            chosen[k] = n
            yield from fill(k + 1, room - n * sizes[k], out if n == have[k] else sizes[k])
        chosen[k] = 0

    yield from fill(0, room, room + 1)


def fullest_first(options: Iterator[list[int]], sizes: list[int], ahead: int) -> Iterator[list[int]]:
    """The same fillings, of every ``ahead`` the fullest first."""
    while some := list(islice(options, ahead)):
        yield from sorted(some, key=lambda f: -sum(n * x for n, x in zip(f, sizes, strict=True)))


def search(lengths: list[int], capacity: int, best: list[list[int]], steps: Steps, ahead: int = FILLINGS) -> tuple[list[list[int]], bool]:
    """Bins of piece numbers, fewer than ``best`` if there are such and the steps lead to them, else ``best``; and whether
    the search came to its end: it then has tried every undominated filling, or reached the lower bound."""
    total = sum(lengths)
    least = math.ceil(total / capacity)
    sizes = sorted(set(lengths), reverse=True)
    at = {x: k for k, x in enumerate(sizes)}
    have = [0] * len(sizes)
    for x in lengths:
        have[at[x]] += 1
    found: list[list[tuple[int, int]]] | None = None
    count, allowed = len(best), (len(best) - 1) * capacity - total  # blanks that a better solution may have
    bins: list[list[tuple[int, int]]] = []
    blanks = [0]

    def options() -> Iterator[list[tuple[int, int]]]:
        # the largest piece left, and what may stand beside it: numbers of pieces by size
        mine = [k for k, n in enumerate(have) if n]
        beside, some = [have[k] for k in mine], [sizes[k] for k in mine]
        beside[0] -= 1
        for f in fullest_first(fillings(some, beside, capacity - some[0], steps), some, ahead):
            f[0] += 1
            yield [(k, n) for k, n in zip(mine, f, strict=True) if n]

    def change(f: list[tuple[int, int]], sign: int) -> None:
        for k, n in f:
            have[k] += sign * n

    ended = count <= least
    stack = [options()] if not ended else []
    try:
        while stack:
            f = next(stack[-1], None)
            if f is None:
                stack.pop()
                if bins:
                    change(bins.pop(), 1)
                    blanks.pop()
                continue
            if not steps.take():
                raise OutOfSteps
            now = blanks[-1] + capacity - sum(n * sizes[k] for k, n in f)
            if now > allowed:
                continue
            change(f, -1)
            bins.append(f)
            blanks.append(now)
            if any(have):
                stack.append(options())
                continue
            found, count = list(bins), len(bins)
            allowed = (count - 1) * capacity - total
            if count == least:
                break
            change(bins.pop(), 1)
            blanks.pop()
        ended = True
    except OutOfSteps:
        pass
    if found is None:
        return best, ended
    numbers: dict[int, list[int]] = {}
    for i in reversed(range(len(lengths))):
        numbers.setdefault(lengths[i], []).append(i)
    return [[numbers[sizes[k]].pop() for k, n in b for _ in range(n)] for b in found], ended


def bin_completion(lengths: list[int], capacity: int, steps: int | None = SEARCH_STEPS, told: dict[str, int] | None = None, group_pieces: int = GROUP_PIECES) -> list[list[int]]:
    """Pieces (lengths that do not rise) in few bins: the best found within ``steps``. Without a number of steps all bins are
    searched at once, to the end: the result has as few bins as there can be. ``told`` counts the searches, those that came
    to their end, and those that saved bins."""
    best = best_fit(lengths, capacity)
    least = math.ceil(sum(lengths) / capacity)

    def tried(ended: bool, saved: bool) -> None:
        if told is not None:
            for name, count in (("searches", 1), ("ended", ended), ("saved", saved)):
                told[name] = told.get(name, 0) + int(count)

    if steps is None:
        if len(best) > least:
            found, ended = search(lengths, capacity, best, Steps(None))
            tried(ended, len(found) < len(best))
            best = found
        return best
    rng = random.Random(0)
    room = lambda b: capacity - sum(lengths[i] for i in b)
    bins = sorted(((room(b), sorted(b)) for b in best), key=lambda x: (-x[0], x[1]))
    failed: set[tuple[int, ...]] = set()
    left, tries = Steps(steps), 0
    while len(bins) > least and left.left > 0:
        # the loosest bins, and from the second try on others between them
        blanks, size, group = 0, 0, []
        skip = 0.0 if not tries else rng.random()
        for k, (rest, b) in enumerate(bins):
            if size + len(b) > group_pieces * (1 + tries % 2) and blanks >= capacity:
                break
            if rng.random() >= skip:
                group.append(k)
                blanks, size = blanks + rest, size + len(b)
        numbers = sorted(i for k in group for i in bins[k][1])
        if blanks < capacity or tuple(numbers) in failed:  # no bin can be saved among these, or was
            if not tries and blanks < capacity:
                break
            tries += 1
            left.take(1 + len(bins) // 100)
            continue
        at = {i: n for n, i in enumerate(numbers)}
        mine = Steps(min(left.left, max(GROUP_STEPS, 10 * size)))
        found, ended = search([lengths[i] for i in numbers], capacity, [[at[i] for i in bins[k][1]] for k in group], mine)
        left.take(max(1, mine.taken))
        saved = len(found) < len(group)
        tried(ended, saved)
        tries += 1
        if saved:
            gone = set(group)
            new = [sorted(numbers[n] for n in b) for b in found]
            bins = sorted([x for k, x in enumerate(bins) if k not in gone] + [(room(b), b) for b in new], key=lambda x: (-x[0], x[1]))
            tries = 0
        else:
            failed.add(tuple(numbers))
            if ended and len(group) == len(bins):
                break  # all bins were in it: there is nothing better
    return [b for _, b in bins]


def packed(rows: DataFrame, capacity: int, steps: int | None) -> DataFrame:
    """The rows with sequence_id, offset and how full the sequence is; each task packs the rows it gets."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at = names.index("length")

    def run(batches):
        parts = list(batches)
        if not parts or not sum(p.num_rows for p in parts):
            return
        part = pa.Table.from_batches(parts).combine_chunks()
        length = part.column(at).to_numpy()
        order = np.argsort(-length, kind="stable")
        bins = bin_completion(length[order].tolist(), capacity, steps)
        sequence, offset, used = (np.zeros(len(length), np.int64) for _ in range(3))
        for b, members in enumerate(bins):
            rows_ = order[members]
            size = length[rows_]
            sequence[rows_], offset[rows_], used[rows_] = b, np.cumsum(size) - size, size.sum()
        sequence += TaskContext.get().partitionId() << 32
        out = part.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("used", pa.array(used))
        yield from out.to_batches(max_chunksize=10_000)
        release_memory()

    return rows.mapInArrow(run, f"{schema}, sequence_id long, offset long, used long")


def pack(found: DataFrame, capacity: int = 4096, steps: int | None = SEARCH_STEPS) -> DataFrame:
    """Pieces (with a column ``length``) with ``sequence_id`` and ``offset``."""
    found = materialize(found)
    full = found.where(F.col("length") >= capacity).withColumn("sequence_id", F.lit(FULL) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    part = found.where(F.col("length") < capacity)
    blocks = max(1, math.ceil(part.count() / BLOCK_PIECES))
    done = materialize(packed(part.repartition(blocks), capacity, steps))
    tight = done.where(F.col("used") >= int(capacity * LOOSE)).drop("used")
    loose = done.where(F.col("used") < int(capacity * LOOSE)).drop("used", "sequence_id", "offset")
    again = max(1, math.ceil(loose.count() / BLOCK_PIECES))
    rest = packed(loose.repartition(again), capacity, steps).drop("used").withColumn("sequence_id", F.col("sequence_id") + F.lit(AGAIN))
    return tight.unionByName(rest).unionByName(full)
