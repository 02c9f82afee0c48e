"""Links between texts whose sets of 5-word shingles have a Jaccard similarity of at least a limit.

Candidates share one of ``BANDS`` keys, each made of ``ROWS`` least hashes of the set: two texts at 0.8 share none of them
in about 2 of 10 000 cases. Texts under one key are compared in all pairs up to ``SMALL`` of them; a larger key compares
each of its texts with its first and last one (in an order of its own). The links found so join the roots, and every key
whose texts still have several roots is looked at again as a whole: all its pairs of two roots are compared on their whole sets.
Up to ``CROWD`` texts meet in one group. A larger crowd is dealt into blocks, and each pair of blocks is a group, but for
pairs of blocks that hold its largest root only; so no pair is left out, a group stays small, and the work beyond the largest root's is
spread. A group gives at most one link fewer than it has texts, those of a spanning forest, so no count grows with the square of a crowd.

Texts stay where they are until candidates are known: keys and counts come first, and of equal texts one row is read. It is
named by partition and number in it, so the input's partitions must be the same whenever they are read, as those of files are.

Defined cases: a text with fewer words than a shingle is one shingle; a text without words has no links; null texts count
as empty; null ids do not matter; equal texts are one node, named by the xxhash64 of the text; an empty table has no links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import keyed_texts, look_up, small_batches
from framewise.llm.components import components
from framewise.session import stage

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
SMALL = 8
#: Texts that meet in one group, and different shingles, on average, that a block of them may hold.
CROWD, CROWD_SHINGLES = 2048, 1 << 20
SEED = 42
SLICE = 1 << 12
#: Shingles of a text whose holders are counted together.
TERMS = 512

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_R = np.random.default_rng(SEED)
_PLACE = _R.integers(0, 2**64, WIDTH, np.uint64) | np.uint64(1)
_TURN = _R.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_ROW = _R.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Ascending 64-bit hashes of the different shingles of a text."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    digest = xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    w = np.fromiter((digest(x, SEED) for x in words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for j in range(WIDTH):
        total += w[j : j + n] * _PLACE[j]
    return np.unique(_mixed(total))


def _least(shingles: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The least hash of the set under each turn."""
    least = np.full(len(turns), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), SLICE):
        turned = shingles[None, at : at + SLICE] * turns
        least = np.minimum(least, (turned ^ (turned >> np.uint64(32))).min(axis=1))
    return least


def band_keys(shingles: np.ndarray) -> list[int]:
    """Keys that the text is filed under; none without shingles."""
    if not len(shingles):
        return []
    least = _least(shingles, _TURN).reshape(BANDS, ROWS)
    return _mixed((_mixed(least) * _ROW).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets, each without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        columns = [
            batch.column("node"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["node", "row", "n", "keys"])


def crowd_links(root: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Members of a crowd that join its roots, as pairs whose sets are at least so similar: a spanning forest of all such links."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(term))])
    joined = np.unique(root, return_inverse=True)[1]
    found = []
    # Of two members of two roots, one at least has another root than the most frequent one.
    for i in np.flatnonzero((joined != np.bincount(joined).argmax()) & (sizes > 0)):
        if (joined == joined[i]).all():
            continue
        both = np.zeros(len(sets), np.int64)
        for at in range(starts[i], starts[i + 1], TERMS):
            held = [holder[first[t] : first[t + 1]] for t in term[at : min(at + TERMS, starts[i + 1])]]
            both += np.bincount(np.concatenate(held), minlength=len(sets))
        near = both / np.maximum(1, sizes + sizes[i] - both) >= least
        for j in np.flatnonzero(near & (joined != joined[i])):
            if joined[j] != joined[i]:
                found.append((int(i), int(j)))
                joined[joined == joined[j]] = joined[i]
    return found


def _crowd(least: float):
    def run(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        pairs = np.array(crowd_links(root, sets, least), np.int64).reshape(-1, 2)
        return pa.table({"a": root[pairs[:, 0]], "b": root[pairs[:, 1]]})

    return run


def _dealt(crowds: DataFrame, most: int, shingles: int) -> DataFrame:
    """Members of keys (``key, node, root, n``) under ``low`` and ``high``, the blocks that meet: every two members of two roots meet.

    The largest root of a large key has blocks of its own, which do not meet each other.
    """
    crowds = stage(crowds)
    per_root = crowds.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    per_key = stage(per_root.groupBy("key").agg(
        F.sum("m").alias("size"), F.sum("s").alias("held"), F.max(F.struct("m", "root", "s")).alias("top")
    ))
    blocks = lambda m, s: F.ceil(F.greatest(m / F.lit(most / 2), s / F.lit(float(shingles)))).cast("int")
    small = (F.col("size") <= most) & (F.col("held") <= 2 * shingles)
    keys = stage(per_key.select(
        "key", F.col("top.root").alias("top"), F.when(small, 0).otherwise(blocks(F.col("top.m"), F.col("top.s"))).alias("tops"),
        F.when(small, 1).otherwise(blocks(F.col("size") - F.col("top.m"), F.col("held") - F.col("top.s"))).alias("others"),
    ))
    placed = look_up(crowds, keys, ["key"], per_key.select("key", F.col("size").alias("n")))
    turn = F.xxhash64("node", F.lit(1))
    bulk = (F.col("tops") > 0) & (F.col("root") == F.col("top"))
    own = F.when(bulk, F.pmod(turn, F.greatest("tops", F.lit(1)))).otherwise(F.col("tops") + F.pmod(turn, F.col("others"))).cast("int")
    last = F.col("tops") + F.col("others") - 1
    met = F.when(F.col("own") < F.col("tops"), F.sequence(F.col("tops"), last)).otherwise(F.sequence(F.lit(0), last))
    spread = placed.withColumn("own", own).withColumn("other", F.explode(met))
    return spread.select("key", "node", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 128):
        sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def _checked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            sides = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right")]
            close = pa.array([similarity(x, y) >= least for x, y in zip(*sides)], pa.bool_())
            yield batch.select(["root_a", "root_b"]).filter(close)

    return run


def _candidates(under: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of members ``x`` (node, root, n) under one ``key`` that may be alike, and the members of large keys of several roots."""
    turn = F.struct(F.xxhash64("key", "x.node").alias("turn"), F.col("x").alias("x"))
    keys = under.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(turn)["x"].alias("first"), F.max(turn)["x"].alias("last"),
        (F.min("x.root") != F.max("x.root")).alias("apart"),
    ).where("apart").drop("apart")
    keys = stage(keys)
    placed = look_up(under, keys, ["key"], keys.select("key", F.col("size").alias("n")))
    crowds = placed.where(F.col("size") > SMALL)
    ends = crowds.select("x", F.explode(F.array("first", "last")).alias("y"))
    whole = placed.where(F.col("size") <= SMALL).groupBy("key").agg(F.collect_list("x").alias("xs"))
    every = whole.select("xs", F.explode("xs").alias("x")).select("x", F.explode("xs").alias("y"))
    pairs = ends.union(every).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where(
        (F.col("x.root") != F.col("y.root"))
        & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(least))  # no pair of such sizes is more alike than their ratio
    )
    return stage(
        pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("root_a"), F.col("y.root").alias("root_b")).distinct()
    ), crowds


def _chosen(texts: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the one row that stands for each of ``nodes``."""
    return texts.join(rows.join(nodes, "node", "left_semi").select("row"), "row").select("node", "text")


def _alike(pairs: DataFrame, texts: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The roots ``a`` and ``b`` of the pairs whose whole sets are alike."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stage(_chosen(texts, needed, rows).mapInArrow(_sets, "node long, shingles binary"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("root_a", "root_b", "left", "right")
    return met.mapInArrow(_checked(least), "root_a long, root_b long").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def links(docs: DataFrame, rooted: DataFrame, least: float = LEAST) -> DataFrame:
    """``a``, ``b``: links between the roots of similar texts; texts under one root already are not compared.

    ``rooted`` has ``node`` (xxhash64 of each different text, once) and ``root``.
    """
    texts = keyed_texts(docs).select(F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("node"), "text")
    filed = texts.mapInArrow(_filed, "node long, row long, n long, keys array<long>").groupBy("node").agg(
        F.min(F.struct("row", "n", "keys")).alias("one")
    ).select("node", "one.*")
    filed = stage(filed.join(rooted, "node"))
    rows = filed.select("node", "row")
    under = stage(filed.select(F.explode("keys").alias("key"), F.struct("node", "root", "n").alias("x")))
    pairs, _ = _candidates(under, least)
    found = stage(_alike(pairs, texts, rows, least))
    joined = components(found).withColumnRenamed("root", "joined").withColumnRenamed("node", "old")
    again = under.join(joined, F.col("x.root") == F.col("old"), "left").select(
        "key", F.struct(F.col("x.node").alias("node"), F.coalesce("joined", F.col("x.root")).alias("root"), F.col("x.n").alias("n")).alias("x")
    )
    _, crowds = _candidates(stage(again), least)
    crowds = _dealt(crowds.select("key", "x.node", "x.root", "x.n"), CROWD, CROWD_SHINGLES)
    members = crowds.select("node").distinct()
    sets = stage(_chosen(texts, members, rows).mapInArrow(_sets, "node long, shingles binary"))
    met = crowds.join(sets, "node").groupBy("key", "low", "high").applyInArrow(_crowd(least), "a long, b long")
    return found.union(stage(met.distinct()))
