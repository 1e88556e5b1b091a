"""Elements inside elements: containment of id ranges, without lists of ancestors.

Elements are numbered in document order, so an element holds the ids from its own to the end of its subtree. A page is
cut into blocks of ids; a range meets the points of the blocks that it reaches. A range has a row per block it reaches (one,
for most), a point has one row, and a page with very many elements is many blocks, which Spark deals to many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardmill.session import grown

BLOCK = 256  # ids


def inside(outer: DataFrame, inner: DataFrame, at: str, start: str, end: str, on: Sequence[str] = ("page_id",), own: bool = False) -> DataFrame:
    """Every row of ``inner`` with every row of ``outer`` whose range of ids from ``start`` to ``end`` its id ``at`` is in.

    The two tables share no columns but those of ``on``. ``own`` also takes an id as inside its own range.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    ranges = outer.withColumn("__block", F.explode(F.sequence(block(start), block(end))))
    points = inner.withColumn("__block", block(at))
    after = F.col(start) <= F.col(at) if own else F.col(start) < F.col(at)
    return ranges.join(grown(points), [*on, "__block"]).where(after & (F.col(at) <= F.col(end))).drop("__block")
