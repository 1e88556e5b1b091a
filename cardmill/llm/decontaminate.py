"""Benchmark decontamination: every passage of every document is a BM25 query against an inverted index of the test items.

The index holds, for every term, its items with their BM25 weight as a share of the item's score for itself, so one
threshold holds for all items. Item numbers are cut into blocks; every list keeps its largest weight and its largest
weight in each block. As in block-max WAND a passage goes on only while sums of such maxima over its terms reach the
threshold: first over whole lists, then block by block, and only the items of blocks that pass are scored. All items above
the threshold are retrieved. A retrieved item counts as leaked if the passage holds enough of the runs of words of its
question and of its answer.

Items are grouped by length. Passages have twice as many words as the longest item that a group may hold (64 words, or twice
that, or four times, and so on) and begin at every half of that, so an item that stands in a text stands whole in one passage,
and how long the passages for an item are does not depend on the other items. Words are runs of letters and digits (any byte over 127 counts as a letter),
with A-Z as a-z.

Items are read to the driver: at most ``max_items``, else an error. Each pass over the documents carries an index of at most
``PASS_ITEMS`` items, and more items take more passes.

Defined results: a null or empty text has no leaks. Items without words never leak. Repeated items each leak. A null item
id stays null; item ids are whole numbers. Of passages with equal scores the one with the larger overlaps is told. An input column ``leaks`` is replaced; all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cardmill.llm.arrow_text import per_chunk, run_hashes, word_hashes, word_spans
from cardmill.llm.tables import bounded_batches, checked_rows, replace_columns

GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
BLOCK = 16  # items
SHARD_ITEMS = 1024  # items of one matrix of block maxima
PASS_ITEMS = 8192  # items carried in one pass over the documents
HALF = 64  # words from one passage to the next, in the group of the shortest items
RUN = 3  # words of the runs that verify an item
CELLS = 1 << 22  # of the matrix of passages' block bounds held at once
LEAKS = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets, GAP)
    return word_hashes(data, starts, ends, lower=True), first


def words_of_text(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]))[0]


@dataclass
class Item:
    item_id: int | None
    words: np.ndarray
    question: np.ndarray  # hashes of the runs of words of the question
    answer: np.ndarray  # of those that end in the answer


def runs_of(words: np.ndarray) -> np.ndarray:
    return run_hashes(words, min(RUN, len(words))) if len(words) else words


def make_item(item_id: int | None, question: str | None, answer: str | None) -> Item:
    """Without an answer of its own, an item's last quarter of words is taken as its answer."""
    words = words_of_text(question)
    if answer is None:
        split = len(words) - max(1, len(words) // 4)
    else:
        split = len(words)
        words = np.concatenate((words, words_of_text(answer)))
    runs = runs_of(words)
    split = max(0, min(split - min(RUN, len(words)) + 1, len(runs)))
    return Item(item_id, words, np.unique(runs[:split]), np.unique(runs[split:]))


class Index:
    """Weights of the terms of up to ``SHARD_ITEMS`` items of a group, in blocks; passages begin every ``half`` words."""

    def __init__(self, items: list[Item], weights: list[tuple[np.ndarray, np.ndarray]], half: int):
        self.items, self.half = items, half
        self.blocks = -(-len(items) // BLOCK)
        terms = np.concatenate([t for t, _ in weights])
        values = np.concatenate([w for _, w in weights])
        number = np.repeat(np.arange(len(items)), [len(t) for t, _ in weights])
        self.terms, dense = np.unique(terms, return_inverse=True)
        order = np.lexsort((number, dense))
        self.number, self.weight, dense = number[order], values[order], dense[order]
        #: where the part of a list that lies in a block begins
        self.pointer = np.searchsorted(dense * (self.blocks * BLOCK + 1) + self.number, (np.arange(len(self.terms))[:, None] * (self.blocks * BLOCK + 1) + np.arange(self.blocks + 1) * BLOCK).ravel()).reshape(-1, self.blocks + 1)
        self.block_most = np.zeros((len(self.terms), self.blocks), np.float32)
        np.maximum.at(self.block_most, (dense, self.number // BLOCK), self.weight.astype(np.float32))
        self.most = self.block_most.max(axis=1, initial=0)

    def retrieve(self, words: np.ndarray, passage: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all items whose score for a passage reaches the threshold."""
        least = threshold * (1 - 1e-5)  # the bounds are sums of 32-bit numbers
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        hit = self.terms[at] == words
        pairs = np.unique(passage[hit] * len(self.terms) + at[hit])  # each term once
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        bound = np.bincount(passage, self.most[term])
        keep = bound[passage] >= least
        passage, term = passage[keep], term[keep]
        found = []
        step = max(1, CELLS // self.blocks)
        begins = np.flatnonzero(np.diff(passage, prepend=-1))
        cuts = [0]
        for b in begins:  # whole passages
            if b - cuts[-1] > step:
                cuts.append(int(b))
        for a, z in zip(cuts, [*cuts[1:], len(passage)], strict=True):
            if a < z:
                found.append(self._score(passage[a:z], term[a:z], least, threshold))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _score(self, passage, term, least, threshold):
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        opens = np.add.reduceat(self.block_most[term], begin, axis=0) >= least  # passages x blocks
        which, block = np.nonzero(opens)
        size = np.diff(np.append(begin, len(passage)))
        # the lists' parts in the open blocks
        of = np.repeat(np.arange(len(which)), size[which])
        row = np.repeat(begin[which] - (np.cumsum(size[which]) - size[which]), size[which]) + np.arange(len(of))
        lo, hi = self.pointer[term[row], block[of]], self.pointer[term[row], block[of] + 1]
        length = hi - lo
        at = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        scores = np.bincount(np.repeat(of, length) * BLOCK + self.number[at] % BLOCK, self.weight[at], minlength=len(which) * BLOCK)
        good = np.flatnonzero(scores >= threshold)
        return passage[begin][which[good // BLOCK]], block[good // BLOCK] * BLOCK + good % BLOCK, scores[good]


def build(items: list[Item], k1: float = 1.2, b: float = 0.75) -> list[Index]:
    """Indexes of all items by groups of length; document frequencies and lengths are those of all items."""
    items = [i for i in items if len(i.words)]
    if not items:
        return []
    counted = [np.unique(i.words, return_counts=True) for i in items]
    terms, df = np.unique(np.concatenate([t for t, _ in counted]), return_counts=True)
    idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(i.words) for i in items])
    weights = []
    for item, (t, tf) in zip(items, counted, strict=True):
        w = idf[np.searchsorted(terms, t)] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(item.words) / mean))
        weights.append((t, w / w.sum()))
    halves = np.array([half_of(len(i.words)) for i in items])
    out = []
    for half in np.unique(halves):
        mine = np.flatnonzero(halves == half)
        out += [Index([items[i] for i in some], [weights[i] for i in some], int(half)) for some in np.split(mine, range(SHARD_ITEMS, len(mine), SHARD_ITEMS))]
    return out


def half_of(n: int) -> int:
    """Half the words of the passages for an item of ``n`` words: no fewer than it has."""
    half = HALF
    while half < n:
        half *= 2
    return half


def share(runs: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(runs, there).mean()) if len(runs) else 1.0


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", question: str = "text", answer: str | None = None,
               threshold: float = 0.5, overlap: float = 0.5, answer_overlap: float = 0.25, max_items: int = 1_000_000) -> DataFrame:
    """The documents with ``leaks``: the verified items of each, with the best score and overlaps of its passages.

    ``threshold`` is the share of an item's score for itself, ``overlap`` and ``answer_overlap`` the shares of the runs of words
    of its question and its answer that a passage must hold: copies with some words changed count as well."""
    docs = replace_columns(bounded_batches(docs), "leaks")
    rows = checked_rows(benchmark.select(item, question, *([answer] if answer else [])), max_items, "benchmark items")
    items = [make_item(None if r[0] is None else int(r[0]), r[1], (r[2] or "") if answer else None) for r in rows]
    indexes = build(items)
    per_pass = PASS_ITEMS // SHARD_ITEMS
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    for number, part in enumerate([indexes[a : a + per_pass] for a in range(0, len(indexes), per_pass)] or [[]]):
        docs = docs.mapInArrow(per_chunk(scan(docs.sparkSession.sparkContext.broadcast(part), names, kind, threshold, (overlap, answer_overlap), number > 0), text), f"{schema}, leaks {LEAKS}")
    return docs


def scan(shared, names: list[str], kind: pa.DataType, threshold: float, overlaps: tuple[float, float], more: bool):
    def function(rows, data, offsets):
        leaks = rows.column(len(names)).to_pylist() if more else [[] for _ in range(rows.num_rows)]
        words, first = words_of(data, offsets)
        if len(words):
            row = np.searchsorted(first, np.arange(len(words)), "right") - 1
            place = np.arange(len(words)) - first[row]
            for half, group in groupby(shared.value, key=lambda index: index.half):
                blocks = -(-np.diff(first) // half)
                base = np.cumsum(blocks) - blocks  # the number of a text's first passage
                second = base[row] + place // half
                # a word is in the passage that begins with its half, and in the one before unless it is in the first half
                both = place >= half
                all_words, passages = np.concatenate((words, words[both])), np.concatenate((second, second[both] - 1))
                owner = np.repeat(np.arange(rows.num_rows), blocks)
                for index in group:
                    best: dict[tuple[int, int], tuple] = {}
                    for p, i, score in zip(*index.retrieve(all_words, passages, threshold), strict=True):
                        r = int(owner[p])
                        begin = int(first[r] + (p - base[r]) * half)
                        entry = index.items[i]
                        there = run_hashes(words[begin : min(begin + 2 * half, int(first[r + 1]))], min(RUN, len(entry.words)))
                        q, a = share(entry.question, there), share(entry.answer, there)
                        if q >= overlaps[0] and a >= overlaps[1]:
                            best[r, int(i)] = max(best.get((r, int(i)), (0.0, 0.0, 0.0)), (float(score), q, a))
                    for (r, i), (score, q, a) in sorted(best.items()):
                        leaks[r].append({"item_id": index.items[i].item_id, "score": score, "question_overlap": q, "answer_overlap": a})
        yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(names))), pa.array(leaks, kind)], names=[*names, "leaks"])

    return function
