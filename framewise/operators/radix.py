"""Order without sorting: counts by leading digits, refined only where a bucket is too full.

``ScoreTree`` lays out scored rows in leaves that follow (score descending, ``idx``): a leaf is a bucket of few rows, and one row of
counts for each leaf gives every leaf its place. ``cut_keys`` finds order statistics of 64-bit hashes by three or four counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.joins import look_up
from framewise.operators.ordered import no_null_keys
from framewise.session import RoundLog, stage

#: First digit and refinements of a score or index; rows that a leaf may hold.
FIRST, FANOUT = 4096, 256
LEAF_ROWS = 1 << 18

#: Rows of a hash bucket that are looked at one by one.
FEW = 1000
DIGITS = 4  # sixteen bits each


def _path(node: Column, digit: Column) -> Column:
    """Paths sort like the rows below them: no path is the beginning of another leaf's."""
    return F.concat(node, F.lit("."), F.lpad(digit.cast("string"), 5, "0"))


def _linear(value: Column, low: Column, high: Column) -> Column:
    """0 at ``low`` to ``FANOUT - 1`` at ``high``, never falling in between; so a bucket of different values always parts."""
    share = (value.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    return F.floor(share * (FANOUT - 1)).cast("int")


class ScoreTree:
    """Rows ``by, idx, label, score`` in leaves, and ``nodes``: the counts of each leaf and of what lies before it.

    The scores are read once, into a log; each refinement writes the rows of the buckets that it parts into a round of their own. A
    bucket of one score is parted by ``idx`` and stays marked by its ``flat`` path, as its rows are one tie.
    """

    def __init__(self, scores: DataFrame, by: str, extra: dict[str, Column] | None = None):
        self.by, self.extra = by, list(extra or {})
        self.log = RoundLog(scores.sparkSession)
        first = F.lpad((F.lit(FIRST) - F.floor(F.col("score").cast("double") * FIRST)).cast("string"), 5, "0")
        columns = [by, "idx", F.col("label").cast("int").alias("label"), "score", *[c.alias(n) for n, c in (extra or {}).items()]]
        self.log.add(0, no_null_keys(scores, [by]).select(*columns, first.alias("node"), F.lit(None).cast("string").alias("flat")))
        self.counts = [stage(self._counted(0))]
        while True:
            full = self.counts[-1].where(self._full())
            if full.isEmpty():
                break
            number = len(self.counts)
            self.log.add(number, self._parted(number - 1, full))
            self.counts.append(stage(self._counted(number)))
        self.nodes = stage(self._placed())

    def _full(self) -> Column:
        """Too many rows, and something left to tell them apart; a bucket without a positive needs no order."""
        differ = (F.col("low") < F.col("high")) | (F.col("first").cast("double") < F.col("last").cast("double"))
        return (F.col("n") > LEAF_ROWS) & (F.col("pos") > 0) & differ

    def _counted(self, number: int) -> DataFrame:
        sums = [F.sum(c).cast("bigint").alias(c) for c in self.extra]
        return self.log.rows(number).groupBy(self.by, "node", "flat").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("pos"), F.min("score").alias("low"), F.max("score").alias("high"),
            F.min("idx").alias("first"), F.max("idx").alias("last"), *sums,
        )

    def _parted(self, number: int, full: DataFrame) -> DataFrame:
        rows = self.log.rows(number).drop("round")
        bounds = full.select(self.by, "node", "low", "high", "first", "last")
        one_score = F.col("low") == F.col("high")
        digit = F.when(one_score, _linear(F.col("idx"), F.col("first"), F.col("last"))).otherwise(
            F.lit(FANOUT - 1) - _linear(F.col("score"), F.col("low"), F.col("high"))
        )
        met = look_up(rows, bounds, [self.by, "node"], full.select(self.by, "node", "n"))
        return met.select(*[c for c in rows.columns if c not in ("node", "flat")], _path(F.col("node"), digit).alias("node"),
                          F.when(one_score, F.coalesce("flat", "node")).alias("flat"))

    def _placed(self) -> DataFrame:
        """Leaves with the rows, positives and negatives before them in the order of their class."""
        leaves = None
        for i, counts in enumerate(self.counts):
            here = counts if i == len(self.counts) - 1 else counts.where(~self._full())
            here = here.withColumn("level", F.lit(i))
            leaves = here if leaves is None else leaves.unionByName(here)
        before = Window.partitionBy(self.by).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        return leaves.select(
            "*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "pos")]
        ).withColumn("neg_before", F.col("n_before") - F.col("pos_before"))

    def ranked(self) -> DataFrame:
        """The rows of leaves that hold a positive, with ``rank`` and ``hits`` (positives so far) in the whole class."""
        wanted = self.nodes.where("pos > 0").select(self.by, "node", "level", "n_before", "pos_before", "neg_before", F.col("pos").alias("leaf_pos"), F.col("n").alias("leaf_n"))
        rows = self.log.rows()
        counts = wanted.select(self.by, "node", F.col("level").alias("round"), F.col("leaf_n").alias("n"))
        met = look_up(rows, wanted.withColumnRenamed("level", "round"), [self.by, "node", "round"], counts)
        leaf = Window.partitionBy(self.by, "node").orderBy(F.col("score").desc(), "idx")
        through = leaf.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return met.withColumns({
            "rank": F.col("n_before") + F.row_number().over(leaf), "hits": F.col("pos_before") + F.sum("label").over(through),
        })


def wins(tree: ScoreTree) -> DataFrame:
    """Per class ``wins``: pairs of a positive and a negative with the lower score, ties counting half.

    A leaf with positives or negatives only, and a score that many leaves share, are settled by counts; rows are looked at
    in mixed leaves alone.
    """
    by, nodes = tree.by, tree.nodes
    total = nodes.groupBy(by).agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    ties = nodes.where("flat is not null").groupBy(by, "flat").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.min("neg_before").alias("neg_before")
    )
    plain = nodes.where("flat is null and (pos = n or low = high)").select(by, "n", "pos", "neg_before")
    closed = plain.unionByName(ties.drop("flat")).where("pos > 0").join(total, by)
    neg = F.col("n") - F.col("pos")
    after = F.col("all_n") - F.col("all_pos") - F.col("neg_before") - neg
    settled = closed.select(by, (F.col("pos") * (after + neg / 2.0)).alias("w"))
    mixed = nodes.where("flat is null and pos > 0 and pos < n and low < high").select(by, "node", F.col("level").alias("round"), F.col("n").alias("leaf_n"), "neg_before")
    rows = tree.log.rows()
    counts = mixed.select(by, "node", "round", F.col("leaf_n").alias("n"))
    levels = look_up(rows, mixed, [by, "node", "round"], counts).groupBy(by, "node", "neg_before", "score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    above = Window.partitionBy(by, "node").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = levels.withColumn("neg_through", F.sum("neg").over(above)).join(total, by)
    below = F.col("all_n") - F.col("all_pos") - F.col("neg_before") - F.col("neg_through")
    opened = inside.where("pos > 0").select(by, (F.col("pos") * (below + F.col("neg") / 2.0)).alias("w"))
    summed = settled.unionByName(opened).groupBy(by).agg(F.sum("w").alias("wins"))
    return total.join(summed, by, "left").select(
        by, F.col("all_pos").alias("pos"), (F.col("all_n") - F.col("all_pos")).alias("neg"), F.coalesce("wins", F.lit(0.0)).alias("wins")
    )


def cut_keys(keys: DataFrame, id_col: str, ranks: list[int]) -> list[tuple | None]:
    """``(hi, lo, id)`` of the given ranks (from 1) in the order of ``hi, lo, id``; None for a rank of 0 or less.

    ``hi`` and ``lo`` are 32-bit numbers. Each count pass takes the next sixteen bits of the keys that agree with a cut so far, and
    gives the driver at most 65536 counts for each cut; a bucket of at most ``FEW`` rows is read. Equal keys are told apart by id.
    """
    half = F.lit(1 << 16)
    digits = [F.floor(F.col("hi") / half), F.col("hi") % half, F.floor(F.col("lo") / half), F.col("lo") % half]
    digits = [d.cast("int") for d in digits]
    open_cuts = {r: ((), r) for r in set(ranks) if r > 0}
    found: dict[int, tuple] = {}

    def inside(prefix: tuple) -> Column:
        out = F.lit(True)
        for digit, value in zip(digits, prefix):
            out = out & (digit == F.lit(value))
        return out

    for depth in range(DIGITS + 1):
        if not open_cuts:
            break
        prefixes = sorted({p for p, _ in open_cuts.values()})
        which = F.coalesce(*[F.when(inside(p), F.lit(i)) for i, p in enumerate(prefixes)])
        if depth == DIGITS:  # one key: the id decides
            for rank, (prefix, left) in open_cuts.items():
                found[rank] = tuple(keys.where(inside(prefix)).select("hi", "lo", id_col).orderBy(id_col).limit(left).tail(1)[0])
            break
        table = keys.withColumn("__which", which).where(F.col("__which").isNotNull()).groupBy("__which", digits[depth].alias("__digit")).count().collect()
        for rank, (prefix, left) in list(open_cuts.items()):
            for row in sorted((r for r in table if r["__which"] == prefixes.index(prefix)), key=lambda r: r["__digit"]):
                if left <= row["count"]:
                    break
                left -= row["count"]
            prefix = (*prefix, row["__digit"])
            open_cuts[rank] = (prefix, left)
            if row["count"] <= FEW:
                few = sorted(tuple(r) for r in keys.where(inside(prefix)).select("hi", "lo", id_col).collect())
                found[rank] = few[left - 1]
                del open_cuts[rank]
    return [found.get(r) for r in ranks]
