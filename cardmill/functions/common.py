"""Shared helpers for columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it in several places.

    Without it a column built from many uses of the same sub-column grows with every use, and so does
    the time to plan it.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)
