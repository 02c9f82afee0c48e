"""Ranks, running sums and running maxima that never put one whole group into one task.

A window over a hot group runs in a single task. Here every group is cut into consecutive pieces that follow
the sort order, the window runs inside each piece, and a table with one row per (piece, group) carries the
totals of the earlier pieces. Pieces come from an integer that grows with the order (lazy, see ``seq_bucket``) or,
for arbitrary orders, from a range partitioning that is staged once (``pieces_of``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.session import stage

PIECE = "__piece"
POSITION = "__position"
SEQ_WIDTH = 1 << 17
GROUP_LIMIT = 1000  # Spark prunes rank <= k before the shuffle up to this k
TASK_ROWS = 1 << 20  # rows that one task of first_few sorts, about
KEY_BUCKETS = 1 << 16


def pieces_of(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partitioned rows in (group, order) order, staged once, with ``__piece`` and ``__position`` in it."""
    keys = [F.col(c) for c in by] + list(order)
    return stage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(PIECE, F.spark_partition_id().cast("bigint"))
        .withColumn(POSITION, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    *,
    bucket: Column | str | None = None,
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    max_before: dict[str, Column] | None = None,
    max_through: dict[str, Column] | None = None,
) -> DataFrame:
    """Add ``rank`` (from 1), inclusive running sums, and running maxima before / through each row.

    ``bucket`` must be non-decreasing along ``order`` inside a group and hold a bounded number of rows per
    value, such as ``seq div 131072`` for a unique ``seq``. Given as a column name it stays in the result, so that
    a second call reuses the same partitioning. A null in a ``by`` column is an error.
    """
    by = list(by)
    inner = list(order)
    df = no_null_keys(df, by)
    if bucket is None:
        pieces, piece, inner = pieces_of(df, by, order), PIECE, [F.col(POSITION)]
    elif isinstance(bucket, str):
        pieces, piece = df, bucket
    else:
        pieces, piece = df.withColumn(PIECE, bucket.cast("bigint")), PIECE

    totals: list[Column] = []
    carried: list[Column] = []
    local: dict[str, Column] = {}
    merged: dict[str, Column] = {}
    earlier = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    piece_window = Window.partitionBy(piece, *by).orderBy(*inner)
    through = piece_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = piece_window.rowsBetween(Window.unboundedPreceding, -1)

    def add(name: str, per_row: Column, per_piece: Column, fold, combine) -> None:
        totals.append(per_piece.alias(f"__t_{name}"))
        carried.append(fold(F.col(f"__t_{name}")).over(earlier).alias(f"__c_{name}"))
        local[name] = per_row
        merged[name] = combine(F.col(name), F.col(f"__c_{name}"))

    def plus(here: Column, carry: Column) -> Column:
        return here + F.coalesce(carry, F.lit(0))

    if rank:
        add(rank, F.row_number().over(piece_window).cast("bigint"), F.count(F.lit(1)), F.sum, plus)
    for name, value in (sums or {}).items():
        add(name, F.sum(value).over(through), F.sum(value), F.sum, plus)
    for name, value in (max_before or {}).items():
        add(name, F.max(value).over(before), F.max(value), F.max, F.greatest)
    for name, value in (max_through or {}).items():
        add(name, F.max(value).over(through), F.max(value), F.max, F.greatest)

    carry = pieces.groupBy(piece, *by).agg(*totals).select(piece, *by, *carried)
    return (
        pieces.select("*", *[c.alias(n) for n, c in local.items()])
        .join(carry, [piece, *by])
        .select(*df.columns, *[c.alias(n) for n, c in merged.items()])
    )


def seq_bucket(seq: str, descending: bool = False, width: int | None = None) -> Column:
    """Pieces of at most ``width`` rows for a unique integer order column."""
    piece = F.floor(F.col(seq) / F.lit(width or SEQ_WIDTH)).cast("bigint")
    return -piece if descending else piece


def no_null_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same rows; a null key raises, as the join with the totals would lose its rows."""
    if not by:
        return df
    missing = F.lit(False)
    for c in by:
        missing = missing | F.col(c).isNull()
    return df.where(F.when(missing, F.raise_error(F.lit(f"null in a key of {', '.join(by)}")).cast("boolean")).otherwise(True))


def rank_by_seq(df: DataFrame, by: Sequence[str], seq: str, rank: str, descending: bool = False) -> DataFrame:
    """Rank by a unique integer inside each group; every group is ranked in pieces, however many rows it holds."""
    order = F.col(seq).desc() if descending else F.col(seq).asc()
    return running(df, by, [order], bucket=seq_bucket(seq, descending), rank=rank)


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank.

    Up to ``GROUP_LIMIT`` the filter on the window is applied by every map task before the shuffle, so a hot
    group sends at most ``k`` rows per task; beyond it the rank is computed in pieces.
    """
    if k <= GROUP_LIMIT:
        window = Window.partitionBy(*by).orderBy(*order)
        ranked = df.withColumn(rank, F.row_number().over(window).cast("bigint"))
    else:
        ranked = running(df, by, order, rank=rank)
    return ranked.where(F.col(rank) <= k)


def first_few(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """``first_k`` for keys that are mostly different, where a sort before the shuffle drops nothing and holds all rows of a scan task.

    Rows are counted by ``KEY_BUCKETS`` hashes of their key, in a job that runs here; the count says how many tasks to deal them
    to, unsorted, at about ``TASK_ROWS`` each. Keys whose bucket alone exceeds that are dealt in parts by a hash of
    ``order``, and the first ``k`` of their parts once more. A table of up to ``TASK_ROWS`` is left to ``first_k``.
    """
    limit, bucket, part = TASK_ROWS, "__bucket", "__part"
    placed = df.withColumn(bucket, F.pmod(F.xxhash64(*by), F.lit(KEY_BUCKETS)))
    counts = placed.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("n") > limit, F.struct(bucket, F.ceil(F.col("n") / limit).alias("parts")))
    total, full = counts.agg(F.sum("n"), F.collect_list(parts)).first()
    if (total or 0) <= limit:
        return first_k(df, by, order, k, rank)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // limit))

    def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return first_k(rows.repartition(tasks, *keys), keys, order, k, rank)

    if not full:
        return dealt(df, by)
    hot = F.broadcast(df.sparkSession.createDataFrame(full, f"{bucket} bigint, parts bigint"))
    cut = placed.join(hot, bucket).withColumn(part, F.pmod(F.xxhash64(*order), F.col("parts")))
    some = dealt(cut, [*by, part]).select(*df.columns)
    return dealt(placed.join(hot, bucket, "left_anti").select(*df.columns), by).unionByName(first_k(some, by, order, k, rank))


def first_per_key(df: DataFrame, key: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """Keep the first (or last) row of each key: a map-side combined aggregate, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*key)
        .agg(pick(F.struct(*[F.col(c) for c in rest]), order).alias("__row"))
        .select(*key, *[F.col("__row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )
