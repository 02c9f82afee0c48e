"""Object labels of frames: class counts, presence, attachment to samples and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.tensors import validity_stats
from framewise.operators.ordered import first_per_key

FRAME = ["segment", "timestamp_micros"]
# Object type codes.
CLASS_CODES = {"vehicle": 1, "pedestrian": 2, "sign": 3, "cyclist": 4}
CLASSES = ["vehicle", "pedestrian", "cyclist", "sign"]
BENCHMARKABLE = ["vehicle", "pedestrian"]


def box_counts(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Boxes per class and frame; unknown types are dropped first, so frames with only those are absent."""
    return (
        boxes.where(F.col("type").isin(list(CLASS_CODES.values())))
        .groupBy(*(by or FRAME))
        .agg(*[F.count_if(F.col("type") == code).alias(f"{name}_count") for name, code in CLASS_CODES.items()])
    )


def presence(df: DataFrame) -> DataFrame:
    """Add a 0/1 presence column per class count."""
    return df.withColumns({f"{c}_present": (F.col(f"{c}_count") > 0).cast("tinyint") for c in CLASSES})


def attach(samples: DataFrame, counts: DataFrame, total_pixels: int | None = None) -> DataFrame:
    """Left join counts on the frame key; missing frames count 0, missing validity is 0 of ``total_pixels``."""
    out = samples.join(counts, FRAME, "left")
    out = out.fillna(0, [f"{c}_count" for c in CLASSES])
    if total_pixels is not None and "valid_pixels" in out.columns:
        out = out.withColumns(
            {
                "valid_pixels": F.coalesce("valid_pixels", F.lit(0).cast("bigint")),
                "total_pixels": F.coalesce("total_pixels", F.lit(total_pixels).cast("bigint")),
                "valid_fraction": F.coalesce("valid_fraction", F.lit(0.0)),
            }
        )
    return presence(out)


def frame_validity(pairs: DataFrame, mask: str = "mask") -> DataFrame:
    """Validity statistics of aligned frames, one row per pair."""
    stats = validity_stats(F.col(mask))
    return pairs.select("file_name", *FRAME, stats.alias("s")).select("file_name", *FRAME, "s.*")


def backfill(samples: DataFrame, boxes: DataFrame, validity: DataFrame, total_pixels: int, file_order: str = "file_name") -> DataFrame:
    """Labels of existing samples recomputed from the sources; a later file overwrites an earlier one per frame."""
    return attach(samples, recomputed(boxes, validity, file_order), total_pixels)


def recomputed(boxes: DataFrame, validity: DataFrame, file_order: str = "file_name") -> DataFrame:
    """Counts and validity of each frame that the sources know; the last file wins."""
    per_file = box_counts(boxes, ["file_name", *FRAME])
    counts = first_per_key(per_file, FRAME, F.col(file_order), last=True).drop("file_name")
    valid = first_per_key(validity, FRAME, F.col(file_order), last=True).drop("file_name")
    return counts.join(valid, FRAME, "full_outer")


def label_table(frames: DataFrame, boxes: DataFrame, validity: DataFrame, total_pixels: int, file_order: str = "file_name") -> DataFrame:
    """The narrow sister of a sample table: one row of labels for each frame key of ``frames``, without any tensor."""
    return attach(frames.select(*FRAME).distinct(), recomputed(boxes, validity, file_order), total_pixels)
