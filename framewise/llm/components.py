"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a hub with any number of links is pre-aggregated and never gathered in
one task. Each round is written to the shared folder, which cuts the lineage, and the round
before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import remove_table, write_table

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a").where(F.col("b") > F.col("a"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for each node of ``a``-``b`` links other than the roots.

    Rows with a null end are left out; loops and repeated links do nothing. Nodes may be of any ordered type.
    """
    clean = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    now, path = write_table(_tidy(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        after, after_path = write_table(_tidy(_small_star(_tidy(_large_star(now)))))
        new = _state(after)
        remove_table(edges.sparkSession, path)
        now, path, same, state = after, after_path, new == state, new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
