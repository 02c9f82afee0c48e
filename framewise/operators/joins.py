"""Joins that do not gather a hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has more rows than this, and more than this part of all rows; so fewer than ``HOT_PARTS`` keys are hot.
HOT_ROWS = 10_000
HOT_PARTS = 1000


def look_up(big: DataFrame, small: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row for each key; hot keys of ``big`` spread over all tasks.

    Rows of ``small`` whose key is hot in ``big`` are broadcast: there are fewer than ``HOT_PARTS`` of them, whatever the size
    of the tables. All other keys meet in a plain join. ``counts`` may give ``on`` and ``n``, the rows of ``big`` for each key. Both
    tables should be written ones, as they are read more than once. Null keys match nothing.
    """
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, total // HOT_PARTS)
    if total <= limit:
        return big.join(small, on)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*on))
    hot_small = F.broadcast(small.join(hot, on, "left_semi"))
    return big.join(hot_small, on).unionByName(big.join(hot, on, "left_anti").join(small.join(hot, on, "left_anti"), on))
