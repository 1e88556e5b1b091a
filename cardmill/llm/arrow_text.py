"""Whole columns of texts as numpy arrays: bytes, words and word hashes of an Arrow batch, without a Python step per row.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``. Hashes are 64-bit; two different words or word
sequences get one hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 19  # texts handled at once; a longer text is a chunk of its own
BLOCK_WORDS = 1 << 16  # words hashed at once
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP, FINAL = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all bits of a 64-bit value."""
    x = (x ^ (x >> U64(32))) * FINAL
    x = (x ^ (x >> U64(29))) * STEP
    return x ^ (x >> U64(32))


BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * STEP)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about ``max_bytes`` of text each, whole rows, with the bytes and offsets of the text."""
    for batch in batches:
        data, offsets = byte_column(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + max_bytes, "right")) - 1)
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (bytes that ``gap`` marks are none), and for every row the number of its first word (one entry more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(gap[data], out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word; ``lower`` takes A-Z as a-z."""
    out = np.empty(len(starts), U64)
    longest = int((ends - starts).max(initial=0))
    powers = np.cumprod(np.full(longest + 1, STEP, U64))
    for a in range(0, len(starts), BLOCK_WORDS):
        s, e = starts[a : a + BLOCK_WORDS], ends[a : a + BLOCK_WORDS]
        part = data[s[0] : e[-1]]
        length = e - s
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        at = np.arange(int(length.sum())) - np.repeat(begin, length)
        bytes_ = part[np.repeat(s - s[0], length) + at]
        codes = BYTE_CODE[LOWER[bytes_] if lower else bytes_] * powers[at]
        out[a : a + BLOCK_WORDS] = mix(np.add.reduceat(codes, begin) + length.astype(U64))
    return out


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from every position on; the last ``width - 1`` positions have none."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= STEP
        out += words[k : k + n]
    return mix(out + U64(width))


def spread_rows(first: np.ndarray) -> np.ndarray:
    """The row of every item, from the number of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def frame(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def list_rows(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One list per row: ``values[first[i]:first[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def release_memory() -> None:
    """Give what a task has freed back to the system: its worker may wait for long, beside the next stage's workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)


def per_chunk(function: Callable, text: str, max_bytes: int = CHUNK_BYTES) -> Callable:
    """An Arrow function that calls ``function(rows, data, offsets)`` on parts of bounded size and passes on what it yields."""

    def run(batches):
        for rows, data, offsets in chunks(batches, text, max_bytes):
            yield from function(rows, data, offsets)
        release_memory()

    return run
