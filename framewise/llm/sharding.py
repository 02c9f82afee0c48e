"""Shards of near equal bytes from size-weighted sampled splitters, with DataFrame functions only.

Rows are ordered by (hash of the text, ``doc_id``), so equal texts lie together. Equal rows are counted and go on as blocks
of up to ``BLOCK`` rows, so that a row repeated any number of times is parted like different ones. A size-weighted sample of these keys
gives quantile splitters, the splitters cut the order into many ranges, the exact bytes of each range are counted over
all rows, and an overfull range is subdivided by a hash of ``doc_id`` and block. Whole ranges go to shards in order, each to the
shard that holds the middle of its bytes.

Defined cases: a null text has size 1 and the checksum of the empty text; a null ``doc_id`` sorts first; equal rows get
different slots; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns never
clash; with ``with_text=True`` the text travels along, else it is pruned before the exchange.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import keyed_texts

#: Ranges between splitters (a power of two), and parts of an overfull range. Both bound what is broadcast.
RANGES = 1024
PARTS = 16
#: Expected number of sampled keys for each range. It bounds what the driver receives, and only balance depends on it.
SAMPLES_PER_RANGE = 16
LOWEST = -(2**63)
#: Equal rows that stay together. They get their slots where the block lies.
BLOCK = 64


def _sized(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Blocks of equal rows: ``block`` is the number within its group, ``n`` the rows and ``bytes`` their sizes together."""
    df = keyed_texts(docs)
    rows = df.select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"), "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"),
    )
    text = [F.first("text").alias("text")] if with_text else []
    equal = rows.groupBy("doc_id", "size", "text_crc32", "h", "k").agg(F.count(F.lit(1)).alias("all"), *text)
    blocks = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / BLOCK))))
    blocks = blocks.withColumn("n", F.least(F.lit(BLOCK), F.col("all") - F.col("block") * BLOCK)).drop("all")
    return blocks.withColumn("bytes", F.col("size") * F.col("n"))


def splitters(sized: DataFrame, ranges: int = RANGES, per_range: int = SAMPLES_PER_RANGE) -> list[tuple[int, int]]:
    """Quantiles of a size-weighted sample of the keys: at most ``ranges`` - 1 pairs, ascending."""
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    wanted = ranges * per_range
    u = F.pmod(F.xxhash64("h", "k", "block", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = sized.where(u * F.lit(float(max(total, 1))) < F.col("bytes") * F.lit(float(wanted))).select("h", "k")
    drawn = sorted((r.h, r.k) for r in keys.collect())
    cuts = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
    return sorted(set(cuts))


def _range_of(cuts: list[tuple[int, int]], ranges: int) -> Column:
    """How many splitters are at or below the row's key, by binary search in a constant array."""
    if not cuts:
        return F.lit(0)
    hs = F.from_json(F.lit(json.dumps([h for h, _ in cuts])), "array<bigint>")
    ks = F.from_json(F.lit(json.dumps([k for _, k in cuts])), "array<bigint>")
    steps = [1 << i for i in range(ranges.bit_length() - 1, -1, -1)]

    def step(at: Column, jump: Column) -> Column:
        i = at + jump
        below = (F.get(hs, i - 1) < F.col("h")) | ((F.get(hs, i - 1) == F.col("h")) & (F.get(ks, i - 1) <= F.col("k")))
        return F.when((i <= len(cuts)) & below, i).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def shard(docs: DataFrame, n_shards: int = 8, *, ranges: int = RANGES, parts: int = PARTS, with_text: bool = False) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    sized = _sized(docs, with_text)
    keyed = sized.withColumn("rng", _range_of(splitters(sized, ranges), ranges)).withColumn(
        "part", F.pmod(F.xxhash64("k", "h", "block", F.lit("part")), F.lit(parts)).cast("int")
    )
    counted = keyed.groupBy("rng", "part").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("rows"))
    every = Window.partitionBy(F.lit(0))
    counted = counted.withColumn("total", F.sum("bytes").over(every)).withColumn(
        "range_bytes", F.sum("bytes").over(Window.partitionBy("rng"))
    )
    overfull = F.col("range_bytes") * ranges > F.col("total") * 2
    counted = counted.withColumn("piece", F.when(overfull, F.col("part")).otherwise(0))
    # At most ranges * parts rows from here on: one ordered pass over them is small at any input size.
    ordered = Window.partitionBy("total").orderBy("rng", "piece")
    pieces = counted.groupBy("total", "rng", "piece").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    middle = F.sum("bytes").over(ordered) - F.col("bytes") / 2
    pieces = pieces.withColumn("shard", F.least(F.floor(middle * n_shards / F.col("total")), F.lit(n_shards - 1)).cast("int"))
    pieces = pieces.withColumn("base", F.sum("rows").over(Window.partitionBy("shard").orderBy("rng", "piece")) - F.col("rows"))
    assigned = counted.select("rng", "part", "piece").join(F.broadcast(pieces.select("rng", "piece", "shard", "base")), ["rng", "piece"])
    placed = keyed.join(F.broadcast(assigned), ["rng", "part"])
    before = F.sum("n").over(Window.partitionBy("rng", "piece").orderBy("h", "k", "size", "text_crc32", "block").rowsBetween(Window.unboundedPreceding, 0))
    at = placed.withColumn("first", F.col("base") + before - F.col("n"))
    each = at.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return each.withColumn("slot", F.col("slot").cast("long")).select(
        "doc_id", "size", "text_crc32", "shard", "slot", *(["text"] if with_text else [])
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> None:
    """One folder per shard with its rows in slot order inside each file."""
    out = shard(docs, n_shards, with_text=True)
    out.repartition(n_shards * 4, "shard", F.pmod("slot", F.lit(4))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
