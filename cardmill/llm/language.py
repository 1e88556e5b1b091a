"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; every character that is no letter becomes a blank. Its features are all n-grams of 1 to 3
characters that hold a letter, each hashed to one of 32,768 buckets. Training counts buckets by language on Spark; the
matrix of log probabilities (languages x buckets) is broadcast, and texts are scored in numpy, whole, in blocks of characters.
A matrix holds at most 256 languages; more languages are further matrices, each in a pass of its own, with the same result.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any training row every text is
``und``. Equal scores go to the language that sorts first. Rows that repeat a key and a text count once in training, and
rows are chosen one by one, whatever keys they repeat. Columns ``lang_pred`` and ``score`` of the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardmill.llm.arrow_text import chunks
from cardmill.llm.tables import bounded_batches, materialize, replace_columns

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MATRIX_LANGUAGES = 256  # of one matrix, which then has 64 MB
BLOCK = 1 << 16  # characters hashed and scored at once


@dataclass(frozen=True)
class Matrix:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_probability: np.ndarray  # buckets x languages


@dataclass(frozen=True)
class Model:
    parts: tuple[Matrix, ...]

    @property
    def languages(self) -> tuple[str, ...]:
        return tuple(g for part in self.parts for g in part.languages)


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' characters one after another, blanks for non-letters, and where each text begins."""
    texts = [(t or "").lower() for t in texts]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(letters()[chars], chars, 32), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def features(chars: np.ndarray, first: np.ndarray):
    """Blocks (text number, bucket) of all n-grams that hold a letter; none crosses the end of its text."""
    for a in range(0, len(chars), BLOCK):
        z = min(a + BLOCK, len(chars))
        row = np.searchsorted(first, np.arange(a, z), "right") - 1
        end = first[row + 1]
        code, letter = np.zeros(z - a, np.uint64), np.zeros(z - a, bool)
        for n in range(1, max(ORDERS) + 1):
            at = np.arange(a, z) + n - 1
            inside = at < end
            c = chars[np.minimum(at, len(chars) - 1)]
            code = (code + c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            letter |= c != 32
            if n in ORDERS:
                keep = inside & letter
                yield row[keep], (((code[keep] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int64)


def count_features(index: dict[str, int], text: str, lang: str):
    def run(batches):
        total = np.zeros((len(index), BUCKETS), np.int64)
        for batch, _, _ in chunks(batches, text):
            langs = np.array([index[x] for x in batch.column(lang).to_pylist()], np.int64)
            for row, bucket in features(*code_points(batch.column(text).to_pylist())):
                total += np.bincount(langs[row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    return run


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 40_000, smoothing: float = 0.5) -> Model:
    """Fit on the different rows with a text and a language: all of them, or ``max_rows`` at most, evenly many of each
    language, those with the smallest hashes of key and text. Rare languages keep all their rows."""
    place = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), text)
    rows = bounded_batches(labelled).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        place.alias("place"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")
    )
    # only hashes are put in order; a language's last place bounds its rows exactly
    places = rows.groupBy("l", "place").agg(F.count("*").alias("n"))
    kinds = materialize(places.groupBy("l").agg(F.sum("n").alias("n")))
    n_languages = kinds.count()
    if not n_languages:
        return Model(())
    quota = max(1, max_rows // n_languages)
    order = Window.partitionBy("l").orderBy("place")
    last = places.withColumn("k", F.row_number().over(order)).where(F.col("k") <= quota).groupBy("l").agg(F.max("place").alias("last"))
    chosen = rows.join(materialize(last), "l").where(F.col("place") <= F.col("last")).dropDuplicates(["l", "place"]).select("l", "t")
    counts = {r.l: r.n for r in kinds.collect()}
    languages, whole = sorted(counts), sum(counts.values())
    if len(languages) > MATRIX_LANGUAGES:  # read once for every matrix
        chosen = materialize(chosen)
    parts = []
    for a in range(0, len(languages), MATRIX_LANGUAGES):
        some = tuple(languages[a : a + MATRIX_LANGUAGES])
        mine = chosen if len(some) == len(languages) else chosen.where(F.col("l").between(some[0], some[-1]))
        cells = mine.mapInArrow(count_features({g: i for i, g in enumerate(some)}, "t", "l"), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(some) * BUCKETS)
        total[cells.cell.to_numpy(np.int64)] = cells.n
        total = total.reshape(len(some), BUCKETS) + smoothing
        prior = np.array([counts[g] for g in some], float)
        parts.append(Matrix(some, np.log(prior / whole), np.log(total / total.sum(axis=1, keepdims=True)).T.copy()))
    return Model(tuple(parts))


def score(part: Matrix, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best language of a matrix, its log probability, and the log of the sum over all its languages; none for a text
    without a letter."""
    chars, first = code_points(texts)
    n = len(texts)
    known = np.zeros(n, bool)
    total = np.zeros((n, len(part.languages)))
    for row, bucket in features(chars, first):
        if len(row):
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[begin]] += np.add.reduceat(part.log_probability[bucket], begin, axis=0)
            known[row[begin]] = True
    total += part.log_prior
    best = total.argmax(axis=1)
    top = total[np.arange(n), best]
    whole = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
    names = np.array(part.languages, object)[best]
    return np.where(known, names, None), np.where(known, top, -np.inf), np.where(known, whole, -np.inf)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The table with ``lang_pred`` and ``score``. One pass for each matrix, no shuffle."""
    docs = replace_columns(bounded_batches(docs), "lang_pred", "score", "__best", "__top", "__whole")
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = docs.withColumns({"__best": F.lit(None).cast("string"), "__top": F.lit(float("-inf")), "__whole": F.lit(float("-inf"))})
    for part in model.parts:
        found = found.mapInArrow(judged_by(docs.sparkSession.sparkContext.broadcast(part), text), f"{plain}, __best string, __top double, __whole double")
    posterior = F.when(F.col("__best").isNull(), 0.0).otherwise(F.exp(F.col("__top") - F.col("__whole")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns, F.coalesce("__best", F.lit(UNKNOWN)).alias("lang_pred"), posterior.alias("score"))


def judged_by(shared, text: str):
    """Rows with the best language so far, of earlier matrices and this one."""

    def run(batches):
        for rows, _, _ in chunks(batches, text):
            *columns, best, top, whole = rows.columns
            new, new_top, new_whole = score(shared.value, rows.column(rows.schema.get_field_index(text)).to_pylist())
            top, whole = top.to_numpy(zero_copy_only=False), whole.to_numpy(zero_copy_only=False)
            better = new_top > top  # of equal ones the earlier
            best = np.where(better, new, best.to_numpy(zero_copy_only=False))
            out = [pa.array(best, pa.string()), pa.array(np.maximum(top, new_top)), pa.array(np.logaddexp(whole, new_whole))]
            yield pa.RecordBatch.from_arrays([*columns, *out], names=rows.schema.names)

    return run
