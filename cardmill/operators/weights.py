"""Keyword points from a table of weights: very many patterns in one pass over the texts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.operators.jobs import keyword_points

LITERALS = r"^[A-Za-z0-9 _&/'-]+(\|[A-Za-z0-9 _&/'-]+)*$"  # alternatives without any sign of a regular expression
PASS_PATTERNS = 200_000  # literal alternatives of one automaton, some tens of MB; more take more passes
#: characters that a case-insensitive pattern takes as an ASCII letter
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZKſİı", "abcdefghijklmnopqrstuvwxyzksii")
WORD = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"}


def in_word(c: str) -> bool:
    return unicodedata.category(c) in WORD or c in "‌‍" or "Ⓐ" <= c <= "ⓩ"


def literal_points(shared):
    """Add the points of every pattern of which an alternative stands in the text as whole words, each once."""

    def run(batches):
        automaton = ahocorasick.Automaton()
        known: dict[str, list[int]] = {}
        points = []
        for number, (pattern, n) in enumerate(shared.value):
            points.append(n)
            for word in set(pattern.translate(FOLD).split("|")):
                known.setdefault(word, []).append(number)
        for word, numbers in known.items():
            automaton.add_word(word, (len(word), in_word(word[0]), in_word(word[-1]), numbers))
        automaton.make_automaton()
        for batch in batches:
            *columns, text, total = batch.columns
            out = []
            for value, so_far in zip(text.to_pylist(), total.to_pylist(), strict=True):
                value = (value or "").translate(FOLD)
                hit: set[int] = set()
                for end, (size, first, last, numbers) in automaton.iter(value):
                    begin = end - size + 1
                    before = begin > 0 and in_word(value[begin - 1])
                    after = end + 1 < len(value) and in_word(value[end + 1])
                    if before != first and after != last:
                        hit.update(numbers)
                out.append(so_far + sum(points[k] for k in hit))
            yield pa.RecordBatch.from_arrays([*columns, text, pa.array(out, pa.int64())], names=batch.schema.names)

    return run


def keyword_points_of(rows: DataFrame, text: str, weights: DataFrame, name: str = "points") -> DataFrame:
    """Add ``name``, what ``keyword_points`` gives for the (pattern, points) of a table.

    Patterns of plain alternatives go into one automaton, with which a text is read once however many there are; automata of
    bounded size are broadcast, and more patterns take more passes. Patterns with signs of regular expressions stay such, and
    cost a search each. A pattern that occurs twice in the table counts with the sum of its points. A null text has none.
    """
    summed = weights.where("pattern is not null").groupBy("pattern").agg(F.sum("points").cast("long").alias("points"))
    plain = F.rlike("pattern", F.lit(LITERALS)) & ~F.rlike("pattern", F.lit(r"^ | $|\| | \|"))
    expressions = [(r.pattern, r.points) for r in summed.where(~plain).collect()]  # each is a search of every text anyway
    literal = summed.where(plain).cache()
    passes = max(1, -(-literal.count() // PASS_PATTERNS))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.withColumns({"_text": F.col(text).cast("string"), "_points": F.lit(0).cast("long")})
    for k in range(passes):
        mine = [(r.pattern, r.points) for r in literal.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k).toLocalIterator()]
        if mine:
            found = found.mapInArrow(literal_points(rows.sparkSession.sparkContext.broadcast(mine)), f"{schema}, _text string, _points long")
    literal.unpersist()
    total = reduce(lambda a, e: a + keyword_points(F.col("_text"), {e[0]: e[1]}), expressions, F.col("_points"))
    return found.withColumn(name, total).drop("_text", "_points")
