"""Deterministic splits, sequential ids, sampling and seeded batches. Global ranks are computed in pieces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.hashing import split_hash
from framewise.functions.permute import Permutation
from framewise.operators.ordered import running
from framewise.operators.radix import cut_keys
from framewise.session import stage

SPLITS = ("train", "val", "test")
# Accepted spellings.
ALIASES = {
    "train": "train", "training": "train",
    "val": "val", "valid": "val", "validation": "val",
    "test": "test", "testing": "test",
}


def split_sizes(n: int, ratios: tuple[float, float, float]) -> dict[str, int]:
    """Rows per split: largest remainder, and no active split left empty while another can spare a row."""
    if any((not math.isfinite(r)) or r < 0 for r in ratios):
        raise ValueError("ratios must be finite and not negative")
    whole = sum(ratios)
    if whole <= 0:
        raise ValueError("at least one ratio must be positive")
    share = [r / whole for r in ratios]
    active = [i for i in range(3) if share[i] > 0]
    sizes = [0, 0, 0]
    if n < len(active):
        for i in sorted(active, key=lambda i: (-share[i], i))[:n]:
            sizes[i] = 1
        return dict(zip(SPLITS, sizes))
    exact = [s * n for s in share]
    sizes = [math.floor(x) for x in exact]
    by_remainder = sorted(range(3), key=lambda i: (sizes[i] - exact[i], i))
    for turn in range(n - sum(sizes)):
        sizes[by_remainder[turn % 3]] += 1
    for i in active:
        if sizes[i] == 0:
            donor = max((j for j in range(3) if j != i and sizes[j] > 1), key=lambda j: (sizes[j], -j))
            sizes[donor] -= 1
            sizes[i] += 1
    return dict(zip(SPLITS, sizes))


def split_size_table(df: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """``split_sizes`` of the row count, as a three-row DataFrame."""
    sizes = split_sizes(df.count(), ratios)
    return df.sparkSession.createDataFrame(list(sizes.items()), "split string, n bigint")


def _checked_count(ids: DataFrame, column: str) -> int:
    """Number of ids; blank or repeated ones raise. One aggregate answers all three questions."""
    per_id = ids.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    blank = F.col(column).isNull() | (F.trim(F.col(column)) == "")
    seen = per_id.agg(
        F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by(column, "n").alias("which"), F.count_if(blank).alias("blank")
    ).first()
    if seen["blank"]:
        raise ValueError("sample id must not be empty")
    if (seen["most"] or 0) > 1:
        raise ValueError(f"duplicate sample id: {seen['which']}")
    return int(seen["rows"] or 0)


def assign(
    df: DataFrame, id_col: str, seed: int, ratios: tuple[float, float, float], check: bool = True
) -> DataFrame:
    """``id, split``: ids ordered by seeded hash, the first rows train, the next val, the rest test.

    The two cuts are found by counting hashes by their leading digits; no id is sorted or moved. Equal hashes go by id.
    """
    ids = df.select(id_col)
    rows = _checked_count(ids, id_col) if check else ids.count()
    hashed = stage(ids.withColumn("__h", split_hash(F.col(id_col), seed)).select(id_col, F.col("__h.hi").alias("hi"), F.col("__h.lo").alias("lo")))
    sizes = split_sizes(rows, ratios)
    train, val = cut_keys(hashed, id_col, [sizes["train"], sizes["train"] + sizes["val"]])
    split = F.when(_upto(train, id_col), "train").when(_upto(val, id_col), "val").otherwise("test")
    return hashed.select(id_col, split.alias("split"))


def _upto(cut: tuple | None, id_col: str) -> Column:
    """Keys up to and with the cut."""
    if cut is None:
        return F.lit(False)
    hi, lo, last = cut
    same_hi = F.col("hi") == hi
    return (F.col("hi") < hi) | (same_hi & (F.col("lo") < lo)) | (same_hi & (F.col("lo") == lo) & (F.col(id_col) <= F.lit(last)))


def enforce(samples: DataFrame, assignment: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Overwrite ``split`` with the assignment."""
    return samples.drop("split").join(assignment.select(id_col, "split"), id_col)


def counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def assign_groups(df: DataFrame, group: str, seed: int, ratios: tuple[float, float, float]) -> DataFrame:
    """Rows with the split of their whole group, so no group crosses a split."""
    groups = assign(df.select(group).distinct(), group, seed, ratios, check=False)
    # the right side has one row per group: adaptive skew handling may cut a hot group on the left
    return df.drop("split").join(groups, group)


def leakage(df: DataFrame, group: str) -> DataFrame:
    """One row: whether any group is in several splits, the share of such groups, and how many."""
    per_group = df.groupBy(group).agg((F.min("split") != F.max("split")).alias("crosses"))
    return per_group.agg(
        F.coalesce(F.bool_or("crosses"), F.lit(False)).alias("leakage_detected"),
        F.coalesce(F.avg(F.col("crosses").cast("double")), F.lit(0.0)).alias("overlap_fraction"),
        F.count_if("crosses").alias("overlapping_groups"),
    )


def only(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split; ``all`` keeps everything."""
    name = split.strip().lower()
    if name == "all":
        return df
    if name not in ALIASES:
        raise ValueError(f"unknown split: {split}")
    return df.where(F.col("split") == ALIASES[name])


def by_id(df: DataFrame, sample_id: str, name: str = "sample_id") -> DataFrame:
    """The rows of one sample; an id that is not there gives none."""
    return df.where(F.col(name) == F.lit(sample_id))


def sequential_id(df: DataFrame, order: list[Column], start: int = 0, name: str = "sample_id") -> DataFrame:
    """One global counter over the given order, formatted ``sample_000000``."""
    ranked = running(df, [], order, rank="__rank")
    return ranked.withColumn(name, F.format_string("sample_%06d", F.col("__rank") - 1 + start)).drop("__rank")


def every_nth(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Systematic sample of at most ``n`` rows: every ceil(rows / n)-th one."""
    rows = df.count()
    n = min(n, rows)
    if n == 0:
        return df.limit(0)
    step = math.ceil(rows / n)
    ranked = running(df, [], order, rank="__rank")
    return ranked.where((F.col("__rank") - 1) % step == 0).drop("__rank")


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows: those of rank ``n`` or less in pieces of the order, so no task gathers them."""
    return running(df, [], order, rank="__rank").where(F.col("__rank") <= n).orderBy("__rank").drop("__rank")


def numbered(df: DataFrame, id_col: str, name: str = "row_number") -> DataFrame:
    """The rows with their place, from 0, in the order of a unique id: ranked once, for any number of epochs.

    Only ids are sorted, in pieces; the payload is joined once.
    """
    ranks = running(df.select(id_col), [], [F.col(id_col)], rank="__rank").select(id_col, (F.col("__rank") - 1).alias(name))
    return ranks if df.columns == [id_col] else df.join(ranks, id_col)


def shuffled(rows: DataFrame, n: int, size: int, seed: int, epoch: int = 0, drop_last: bool = False, number: str = "row_number") -> DataFrame:
    """``batch_index`` and ``position`` of numbered rows in the shuffle of ``seed + epoch``: a column, no exchange and no sort."""
    place = Permutation(n, seed + epoch).column(F.col(number))
    out = _placed(rows.withColumn("__place", place), size)
    return out.where(F.col("batch_index") < n // size) if drop_last else out


def one_batch(rows: DataFrame, n: int, size: int, seed: int, epoch: int, batch_index: int, number: str = "row_number") -> DataFrame:
    """The rows of one batch of ``shuffled``, found by their numbers: the permutation is turned back on the driver for ``size`` places.

    A table that is sorted by its number is read in the files and row groups that hold them.
    """
    permutation = Permutation(n, seed + epoch)
    places = range(batch_index * size, min(n, (batch_index + 1) * size))
    numbers = {permutation.back(p): p for p in places}
    if not numbers:
        return _placed(rows.where("false").withColumn("__place", F.lit(0).cast("bigint")), size)
    back = F.create_map(*[F.lit(x).cast("bigint") for pair in numbers.items() for x in pair])
    return _placed(rows.where(F.col(number).isin(list(numbers))).withColumn("__place", F.element_at(back, F.col(number))), size)


def _placed(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns(
        {"batch_index": F.floor(F.col("__place") / size).cast("bigint"), "position": (F.col("__place") % size).cast("int")}
    ).drop("__place")


def batches(
    df: DataFrame, id_col: str, size: int, seed: int | None = None, epoch: int = 0, drop_last: bool = False,
    order: list[Column] | None = None,
) -> DataFrame:
    """``batch_index`` and ``position`` of every row: input order, or a seeded shuffle (seed + epoch) of the rows in id order.

    For many epochs number the rows once (``numbered``) and take ``shuffled``.
    """
    if size < 1:
        raise ValueError("batch size must be positive")
    total = df.count() if seed is not None or drop_last else 0
    if seed is not None:
        return shuffled(numbered(df, id_col, "__number"), total, size, seed, epoch, drop_last, "__number").drop("__number")
    keys = order or [F.col(id_col)]
    if order is None:
        ranked = numbered(df, id_col, "__place")
    else:
        ranked = running(df, [], keys, rank="__rank").withColumn("__place", F.col("__rank") - 1).drop("__rank")
    out = _placed(ranked, size)
    return out.where(F.col("batch_index") < total // size) if drop_last else out


def assemble(batched: DataFrame, values: str, shape: str) -> DataFrame:
    """One row per batch: concatenated values and ``[B] + shape``; mixed shapes raise. B is a bounded batch size."""
    rows = F.sort_array(F.collect_list(F.struct("position", values)))
    mixed = F.min(shape) != F.max(shape)
    return batched.groupBy("batch_index").agg(
        F.when(mixed, F.raise_error(F.lit("rows of a batch must share one shape")))
        .otherwise(F.concat(F.array(F.count(F.lit(1)).cast("int")), F.max(shape)))
        .alias("batch_shape"),
        F.flatten(F.transform(rows, lambda r: r[values])).alias("batch_values"),
    )
