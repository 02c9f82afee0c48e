"""Alignment against a plain sequential matcher."""

import random

import pytest
from pyspark.sql import functions as F

from framewise import session
from framewise.operators import align, ordered

FRAME = "file_name string, segment string, timestamp_micros bigint, seq bigint"


def sequential(cams, lids, tolerance):
    """Cameras in arrival order take the nearest free lidar time; equal distance: earlier; same time: last arrived."""
    free = {}
    for f, s, t, q in sorted(lids, key=lambda r: r[3]):
        free.setdefault((f, s), []).append((t, q))
    out = []
    for f, s, t, q in sorted(cams, key=lambda r: r[3]):
        pool = free.get((f, s), [])
        if not pool:
            continue
        best = min(pool, key=lambda l: (abs(l[0] - t), l[0], -l[1]))
        if abs(best[0] - t) <= tolerance:
            pool.remove(best)
            out.append((f, s, t, q, best[1], best[0], abs(best[0] - t)))
    return sorted(out)


def make(rng, n, span, segments=3):
    return [(f"f{rng.randrange(2)}", f"s{rng.randrange(segments)}", rng.randrange(span), i) for i in range(n)]


def pairs(df):
    return sorted(tuple(r) for r in df.select(*align.PAIR_COLUMNS).collect())


@pytest.mark.parametrize("seed,span,tolerance", [(1, 40, 3), (2, 400, 5), (3, 12, 2), (4, 30, 0), (5, 2000, 40)])
def test_nearest_matches_sequential(spark, seed, span, tolerance):
    rng = random.Random(seed)
    cams, lids = make(rng, 150, span), make(rng, 150, span)
    c, l = spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME)
    want = sequential(cams, lids, tolerance)
    assert pairs(align.nearest(c, l, tolerance)) == want


@pytest.mark.parametrize("seed,span,tolerance", [(6, 25, 4), (7, 300, 6)])
def test_long_islands_by_rounds_match_sequential(spark, seed, span, tolerance):
    rng = random.Random(seed)
    cams, lids = make(rng, 60, span, 2), make(rng, 50, span, 2)
    c, l = spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME)
    assert pairs(align.nearest(c, l, tolerance, max_fold_rows=4)) == sequential(cams, lids, tolerance)


def test_rounds_write_only_what_is_contested(spark, monkeypatch):
    rng = random.Random(12)
    cams = [("f0", "s0", t, i) for i, t in enumerate(rng.sample(range(4000), 900))]
    lids = [("f0", "s0", t + rng.randrange(-2, 3), i) for i, (_, _, t, _) in enumerate(cams)]
    cams += [("f0", "s0", 2000 + rng.randrange(20), 900 + i) for i in range(25)]
    logs = []
    monkeypatch.setattr(align, "RoundLog", lambda s: logs.append(session.RoundLog(s)) or logs[-1])
    c, l = spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME)
    assert pairs(align.nearest(c, l, 60, max_fold_rows=4)) == sequential(cams, lids, 60)
    (log,) = logs
    written = [log.rows(n).count() for n in log.rounds]
    assert len(written) > 5 and written[0] == len(cams)
    assert written[-1] < written[0] / 10 and sum(written) < 3 * len(cams)


def test_no_lidar_in_reach_of_a_long_island(spark):
    cams = [("f0", "s0", 3 * i, i) for i in range(40)]
    lids = [("f0", "s0", 1000, 0)]
    assert pairs(align.nearest(spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME), 3, max_fold_rows=4)) == []
    assert pairs(align._propose(spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME), spark.createDataFrame(
        [("f0", "s0", 3 * i, 1, 0, 0, 0) for i in range(40)], "file_name string, segment string, timestamp_micros bigint, cams bigint, lids bigint, lidar_pos bigint, island bigint"), 3)) == []


def test_exact_with_hot_keys(spark, monkeypatch):
    rng = random.Random(8)
    cams, lids = make(rng, 300, 4, 1), make(rng, 260, 4, 1)
    c, l = spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME)
    want = sequential(cams, lids, 0)
    assert pairs(align.exact(c, l)) == want
    monkeypatch.setattr(ordered, "SEQ_WIDTH", 16)
    assert pairs(align.exact(c, l)) == want


def frames(spark, times):
    return spark.createDataFrame([("f", "s", t, i) for i, t in enumerate(times)], FRAME)


def stats(spark, cams, lids, tolerance):
    c, l = frames(spark, cams), frames(spark, lids)
    return align.stats(c, l, align.nearest(c, l, tolerance)).first().asDict()


def test_golden_counts(spark):
    got = stats(spark, [100, 200], [100, 300], 0)
    assert (got["matched_pairs"], got["unmatched_camera"], got["unmatched_lidar"]) == (1, 1, 1)
    got = stats(spark, [1_000_000], [1_000_012], 20)
    assert (got["matched_pairs"], got["max_abs_delta_micros"]) == (1, 12)
    got = stats(spark, [100, 100], [100], 0)
    assert (got["matched_pairs"], got["unmatched_camera"], got["unmatched_lidar"]) == (1, 1, 0)
    assert stats(spark, [10], [12], -5)["matched_pairs"] == 0


def test_input_order_does_not_matter(spark):
    rng = random.Random(9)
    cams, lids = make(rng, 120, 50), make(rng, 120, 50)
    a = align.nearest(spark.createDataFrame(cams, FRAME), spark.createDataFrame(lids, FRAME), 4)
    rng.shuffle(cams), rng.shuffle(lids)
    b = align.nearest(
        spark.createDataFrame(cams, FRAME).repartition(5), spark.createDataFrame(lids, FRAME).repartition(3), 4
    )
    assert pairs(a) == pairs(b)


def test_payload_follows_the_pair(spark):
    c = frames(spark, [1, 2]).withColumn("image", F.col("seq").cast("string").cast("binary"))
    l = frames(spark, [2, 1]).withColumn("range_values", F.array(F.col("seq").cast("float"))).withColumn("shape", F.array(F.lit(1)))
    got = align.with_payload(align.exact(c, l), c, l).orderBy("timestamp_micros").collect()
    assert [(bytes(r["image"]), r["range_values"]) for r in got] == [(b"0", [1.0]), (b"1", [0.0])]
