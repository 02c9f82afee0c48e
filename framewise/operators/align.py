"""One-to-one alignment of camera and lidar frames, per (file, segment).

Inputs carry ``file_name, segment, timestamp_micros, seq``; ``seq`` is the arrival order inside a file.
Only these narrow key columns are shuffled; payload columns are joined back by (file, seq) afterwards.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.operators.ordered import rank_by_seq, running, seq_bucket
from framewise.session import RoundLog, stage

KEY = ["file_name", "segment", "timestamp_micros"]
SCOPE = ["file_name", "segment"]
PAIR_COLUMNS = ["file_name", "segment", "timestamp_micros", "camera_seq", "lidar_seq", "lidar_timestamp_micros",
                "abs_delta_micros"]
TIME_BUCKET_MICROS = 3_600_000_000  # one hour of distinct frame times per piece
MAX_FOLD_ROWS = 256


def exact(camera: DataFrame, lidar: DataFrame) -> DataFrame:
    """Pair the k-th camera (arrival order) with the k-th last lidar of the same segment and time.

    Both sides are ranked together, each frame key in pieces of its arrival order, so a key may hold any number of
    frames. A frame without a complete key has no partner.
    """
    side = [*KEY, "is_camera"]
    rows = camera.select(*KEY, F.lit(True).alias("is_camera"), "seq", F.col("seq").alias("arrival")).unionByName(
        lidar.select(*KEY, F.lit(False).alias("is_camera"), "seq", (-F.col("seq")).alias("arrival"))
    )
    ranked = running(rows.dropna(subset=KEY), side, [F.col("arrival")], bucket=seq_bucket("arrival"), rank="k")
    paired = ranked.groupBy(*KEY, "k").agg(
        F.max(F.when(F.col("is_camera"), F.col("seq"))).alias("camera_seq"),
        F.max(F.when(~F.col("is_camera"), F.col("seq"))).alias("lidar_seq"),
    )
    return paired.where("camera_seq is not null and lidar_seq is not null").select(
        *KEY, "camera_seq", "lidar_seq",
        F.col("timestamp_micros").alias("lidar_timestamp_micros"),
        F.lit(0).cast("bigint").alias("abs_delta_micros"),
    )


def islands(camera: DataFrame, lidar: DataFrame, max_delta_micros: int) -> DataFrame:
    """Distinct frame times with their island: frames within tolerance always share one.

    Columns: key, ``cams``, ``lids`` (frames at that time), ``lidar_pos`` (lidar times of the scope up to here)
    and ``island`` (its first time).
    """
    sides = camera.select(*KEY, F.lit(1).alias("c"), F.lit(0).alias("l")).unionByName(
        lidar.select(*KEY, F.lit(0).alias("c"), F.lit(1).alias("l"))
    )
    ts = F.col("timestamp_micros")
    # narrow and needed several times over: written once instead of scanning the sources again
    times = stage(
        sides.groupBy(*KEY)
        .agg(F.sum("c").cast("bigint").alias("cams"), F.sum("l").cast("bigint").alias("lids"))
        .withColumn("hour", F.floor(ts / F.lit(TIME_BUCKET_MICROS)).cast("bigint"))
    )

    def after_gap(previous: Column) -> Column:
        return ts - previous > F.lit(max_delta_micros)

    # inside one hour of a scope everything but the link to earlier hours is known
    hour = Window.partitionBy(*SCOPE, "hour").orderBy("timestamp_micros")
    through = hour.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        times.withColumn("previous", F.lag("timestamp_micros").over(hour))
        .withColumn("start", F.when(after_gap(F.col("previous")), ts))
        .withColumn("own_island", F.max("start").over(through))
        .withColumn("own_pos", F.sum((F.col("lids") > 0).cast("bigint")).over(through))
    )
    # one row per scope and hour: what the hours before it hand over
    before = Window.partitionBy(*SCOPE).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = local.groupBy(*SCOPE, "hour").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("start").alias("last_start"), F.max("own_pos").alias("n_pos")
    )
    opened = F.when(
        F.col("earlier").isNull() | (F.col("first") - F.col("earlier") > F.lit(max_delta_micros)), F.col("first")
    )
    carry = (
        hours.withColumn("earlier", F.max("last").over(before))
        .withColumn("opened", opened)
        .withColumn("newest", F.coalesce("last_start", "opened"))
        .select(
            *SCOPE, "hour", F.coalesce("opened", F.max("newest").over(before)).alias("open_island"),
            F.coalesce(F.sum("n_pos").over(before), F.lit(0)).alias("pos_before"),
        )
    )
    return local.join(carry, [*SCOPE, "hour"]).select(
        *KEY, "cams", "lids", (F.col("own_pos") + F.col("pos_before")).alias("lidar_pos"),
        F.coalesce("own_island", "open_island").alias("island"),
    )


def nearest(camera: DataFrame, lidar: DataFrame, max_delta_micros: int, max_fold_rows: int = MAX_FOLD_ROWS) -> DataFrame:
    """Greedy one-to-one nearest-time pairs: cameras in arrival order, ties to the earlier lidar time.

    Timelines are cut into islands. Islands of at most ``max_fold_rows`` frames are folded natively; a longer
    one is solved by distributed proposal rounds, so no island is ever collected into one task.
    """
    tolerance = max(int(max_delta_micros), 0)
    if tolerance == 0:
        return exact(camera, lidar)
    timeline = stage(islands(camera, lidar, tolerance))
    sizes = (
        timeline.groupBy(*SCOPE, "island")
        .agg(F.sum("cams").alias("n_cams"), F.sum("lids").alias("n_lids"))
        .where((F.col("n_cams") > 0) & (F.col("n_lids") > 0))
        .withColumn("fold", F.col("n_cams") + F.col("n_lids") <= F.lit(max_fold_rows))
        .select(*SCOPE, "island", "fold")
    )
    places = timeline.join(sizes, [*SCOPE, "island"])
    folded = _fold(camera, lidar, places.where("fold"), tolerance)
    if sizes.where(~F.col("fold")).isEmpty():
        return folded
    return folded.unionByName(_propose(camera, lidar, stage(places.where(~F.col("fold"))), tolerance))


def _fold(camera: DataFrame, lidar: DataFrame, places: DataFrame, tolerance: int) -> DataFrame:
    def side(frames: DataFrame, flag: int) -> DataFrame:
        return frames.select(*KEY, "seq", F.lit(flag).alias("is_camera"))

    frames = side(camera, 1).unionByName(side(lidar, 0)).join(places.select(*KEY, "island"), KEY)
    frame = F.struct(F.col("seq"), F.col("timestamp_micros").alias("t"))
    grouped = frames.groupBy(*SCOPE, "island").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_camera") == 1, frame))).alias("cams"),
        F.collect_list(F.when(F.col("is_camera") == 0, frame)).alias("lids"),
    )

    def choose(state: Column, cam: Column) -> Column:
        ranked = F.transform(
            state["free"],
            lambda l: F.struct(F.abs(l["t"] - cam["t"]).alias("d"), l["t"].alias("t"), (-l["seq"]).alias("s")),
        )
        best = F.array_min(ranked)
        taken = F.coalesce(best["d"] <= F.lit(tolerance), F.lit(False))
        remaining = F.when(
            taken, F.filter(state["free"], lambda l: l["seq"] != -best["s"])
        ).otherwise(state["free"])
        pair = F.struct(
            cam["t"].alias("timestamp_micros"), cam["seq"].alias("camera_seq"), (-best["s"]).alias("lidar_seq"),
            best["t"].alias("lidar_timestamp_micros"), best["d"].alias("abs_delta_micros"),
        )
        return F.struct(
            remaining.alias("free"),
            F.when(taken, F.concat(state["pairs"], F.array(pair))).otherwise(state["pairs"]).alias("pairs"),
        )

    pair_type = ("array<struct<timestamp_micros:bigint,camera_seq:bigint,lidar_seq:bigint,"
                 "lidar_timestamp_micros:bigint,abs_delta_micros:bigint>>")
    start = F.struct(F.col("lids").alias("free"), F.array().cast(pair_type).alias("pairs"))
    solved = F.aggregate(F.col("cams"), start, choose, lambda state: state["pairs"])
    return grouped.select(*SCOPE, F.inline(solved)).select(*PAIR_COLUMNS)


def _propose(camera: DataFrame, lidar: DataFrame, places: DataFrame, tolerance: int) -> DataFrame:
    """Proposal rounds for long islands.

    Cameras in arrival order taking their nearest free lidar is the stable matching in which every lidar time
    prefers earlier cameras. Each round all unplaced cameras propose to their next lidar time, and each time
    keeps its earliest cameras up to the number of lidars it holds. The result does not depend on round order. A camera
    whose next time is out of reach has no partner and leaves the state.

    The state is a log with one folder per round, never rewritten: a round holds the cameras of the slots that were proposed to
    in it, those that keep their place and those that must go on. Who sits at a slot is what its last round says, so a round
    reads the settled cameras of contested slots only and writes nothing else.
    """
    slots = stage(places.where("lids > 0").select(
        *SCOPE, F.col("lidar_pos").alias("pos"), F.col("timestamp_micros").alias("slot_time"), F.col("lids").alias("room")
    ))
    log = RoundLog(camera.sparkSession)
    below = F.col("lidar_pos").alias("below")
    waiting = stage(camera.select(*KEY, "seq").join(places.select(*KEY, "lidar_pos"), KEY).select(*KEY, "seq", below, (F.col("lidar_pos") + 1).alias("above")))
    for number in itertools.count():
        proposed = stage(_proposals(waiting, slots, tolerance))
        if proposed.isEmpty():
            break
        held = proposed
        if number:
            contested = proposed.select(*SCOPE, "slot").distinct()
            held = held.unionByName(_seated(log.rows().join(contested, [*SCOPE, "slot"], "left_semi")))
        ranked = rank_by_seq(held, [*SCOPE, "slot"], "seq", "k")
        room = slots.select(*SCOPE, F.col("pos").alias("slot"), "room")
        log.add(number, ranked.join(room, [*SCOPE, "slot"]).withColumn("stays", F.col("k") <= F.col("room")).drop("room", "k"))
        waiting = log.rows(number).where(~F.col("stays")).drop("slot", "stays", "round")

    placed = log.rows() if log.rounds else proposed.withColumns({"stays": F.lit(True), "round": F.lit(0)})
    placed = rank_by_seq(_seated(placed), [*SCOPE, "slot"], "seq", "k").join(
        slots.select(*SCOPE, F.col("pos").alias("slot"), "slot_time"), [*SCOPE, "slot"]
    )
    lids = rank_by_seq(
        lidar.dropna(subset=KEY).select(*SCOPE, F.col("timestamp_micros").alias("slot_time"), F.col("seq").alias("lidar_seq")),
        [*SCOPE, "slot_time"], "lidar_seq", "k", descending=True,
    )
    return placed.join(lids, [*SCOPE, "slot_time", "k"]).select(
        *KEY, F.col("seq").alias("camera_seq"), "lidar_seq", F.col("slot_time").alias("lidar_timestamp_micros"),
        F.abs(F.col("timestamp_micros") - F.col("slot_time")).alias("abs_delta_micros"),
    )


def _proposals(waiting: DataFrame, slots: DataFrame, tolerance: int) -> DataFrame:
    """The next slot of each waiting camera within reach, and what lies beyond it on both sides."""
    lower = slots.select(*SCOPE, F.col("pos").alias("below"), F.col("slot_time").alias("t_below"))
    upper = slots.select(*SCOPE, F.col("pos").alias("above"), F.col("slot_time").alias("t_above"))
    d_below = F.col("timestamp_micros") - F.col("t_below")
    d_above = F.col("t_above") - F.col("timestamp_micros")
    go_below = F.col("t_below").isNotNull() & (F.col("t_above").isNull() | (d_below <= d_above))
    reach = F.when(go_below, d_below).otherwise(d_above)
    near = waiting.join(lower, [*SCOPE, "below"], "left").join(upper, [*SCOPE, "above"], "left")
    return near.where(reach <= F.lit(tolerance)).withColumn("down", go_below).select(
        *KEY, "seq",
        F.when(F.col("down"), F.col("below") - 1).otherwise(F.col("below")).alias("below"),
        F.when(~F.col("down"), F.col("above") + 1).otherwise(F.col("above")).alias("above"),
        F.when(F.col("down"), F.col("below")).otherwise(F.col("above")).alias("slot"),
    )


def _seated(log: DataFrame) -> DataFrame:
    """Per slot the cameras that stay in its last round."""
    last = log.groupBy(*SCOPE, "slot").agg(F.max("round").alias("round"))
    return log.where("stays").join(last, [*SCOPE, "slot", "round"]).select(*KEY, "seq", "below", "above", "slot")


def stats(camera: DataFrame, lidar: DataFrame, pairs: DataFrame, by: Sequence[str] = ("file_name",)) -> DataFrame:
    """Per file: frame, match and unmatched counts, and the largest time difference over matches."""
    zero = F.lit(0).cast("bigint")

    def marks(df: DataFrame, c: int, l: int, m: int) -> DataFrame:
        delta = F.col("abs_delta_micros") if m else zero
        return df.select(*by, F.lit(c).alias("c"), F.lit(l).alias("l"), F.lit(m).alias("m"), delta.alias("d"))

    return (
        marks(camera, 1, 0, 0).unionByName(marks(lidar, 0, 1, 0)).unionByName(marks(pairs, 0, 0, 1))
        .groupBy(*by)
        .agg(
            F.sum("c").cast("bigint").alias("camera_frames"),
            F.sum("l").cast("bigint").alias("lidar_frames"),
            F.sum("m").cast("bigint").alias("matched_pairs"),
            F.sum(F.col("c") - F.col("m")).cast("bigint").alias("unmatched_camera"),
            F.sum(F.col("l") - F.col("m")).cast("bigint").alias("unmatched_lidar"),
            F.max("d").alias("max_abs_delta_micros"),
        )
    )


def sample_bounds(samples: DataFrame, by: Sequence[str] = ("file_name",)) -> DataFrame:
    """First and last sample id written from each file."""
    return samples.groupBy(*by).agg(
        F.min("sample_id").alias("first_sample_id"), F.max("sample_id").alias("last_sample_id")
    )


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a partner in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def with_ranges(pairs: DataFrame, lidar: DataFrame) -> DataFrame:
    """Join range values back to aligned keys."""
    lid = lidar.select("file_name", F.col("seq").alias("lidar_seq"), "range_values", "shape")
    return pairs.join(lid, ["file_name", "lidar_seq"])


def with_images(pairs: DataFrame, camera: DataFrame) -> DataFrame:
    """Join images back to aligned keys; call it last, so that images cross the network once."""
    cam = camera.select("file_name", F.col("seq").alias("camera_seq"), "image")
    return pairs.join(cam, ["file_name", "camera_seq"])


def with_payload(pairs: DataFrame, camera: DataFrame, lidar: DataFrame) -> DataFrame:
    """Range values and images joined back to aligned keys."""
    return with_images(with_ranges(pairs, lidar), camera)
