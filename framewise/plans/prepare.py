"""The prepare flow: scan, align, label, build tensors, number samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions import tensors
from framewise.operators import align, labels, splits


def prepare(
    camera: DataFrame, lidar: DataFrame, boxes: DataFrame, *, h: int = tensors.RANGE_HEIGHT, w: int = tensors.RANGE_WIDTH,
    channels: tuple[str, ...] = ("range", "intensity"), max_delta_micros: int = 0, max_range: float = tensors.MAX_RANGE_METERS,
    skip_empty_range: bool = False,
) -> DataFrame:
    """Aligned, labelled and normalised samples.

    Matching and numbering move only key columns. Pairs without a range image are left out before numbering, so ids
    have no gaps. Range values are joined back first and reduced to tensors; images come last and are moved once.
    """
    pairs = align.nearest(camera, lidar, max_delta_micros)
    if skip_empty_range:
        filled = lidar.where(F.size("range_values") > 0).select("file_name", F.col("seq").alias("lidar_seq"))
        pairs = pairs.join(filled, ["file_name", "lidar_seq"], "left_semi")
    numbered = splits.sequential_id(pairs, [F.col("file_name"), F.col("camera_seq")])
    labelled = align.with_ranges(labels.attach(numbered, labels.box_counts(boxes)), lidar)
    dims = [F.get("shape", F.lit(i)) for i in range(3)]
    values = F.col("range_values")
    mask = tensors.validity(values, *dims, h, w)
    tensors_only = (
        labelled.withColumn("range", tensors.range_chw(values, *dims, h, w, list(channels), max_range))
        .withColumn("__v", tensors.validity_stats(mask))
        .select("*", "__v.*")
        .drop("__v", "range_values", "shape")
    )
    return align.with_images(tensors_only, camera)


def align_report(camera: DataFrame, lidar: DataFrame, boxes: DataFrame) -> DataFrame:
    """Per segment: frames, matches and objects on aligned frames."""
    pairs = align.exact(camera, lidar)
    labelled = labels.attach(pairs, labels.box_counts(boxes))
    objects = labelled.groupBy("segment").agg(
        F.sum("vehicle_count").alias("vehicles"), F.sum("pedestrian_count").alias("pedestrians"),
        F.count_if(F.col("sign_count") > 0).alias("frames_with_sign"),
    )
    per_segment = align.stats(camera, lidar, pairs, by=["segment"])
    return per_segment.join(objects, "segment", "left").fillna(0).select(
        "segment", "camera_frames", "lidar_frames", "matched_pairs", "vehicles", "pedestrians", "frames_with_sign"
    )
