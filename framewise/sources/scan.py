"""Scans of raw per-sensor component tables: columns are found by name fragment, then renamed at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.operators.ordered import first_k

# Fixed values of the raw table format: name fragments of the columns that are read.
SEGMENT = "segment_context_name"
TIMESTAMP = "frame_timestamp_micros"
CAMERA_NAME = "camera_name"
LASER_NAME = "laser_name"
IMAGE = "image"
RANGE_VALUES = "range_image_return1.values"
RANGE_SHAPE = "range_image_return1.shape"
BOX_TYPE = "[CameraBoxComponent].type"
FRONT_CAMERA, TOP_LASER = 1, 1


def find_column(df: DataFrame, fragment: str, kind: type | tuple[type, ...] | None = None) -> str:
    """The first column whose name contains ``fragment`` (and has type ``kind``), quoted for use in ``F.col``."""
    for field in df.schema.fields:
        if fragment in field.name and (kind is None or isinstance(field.dataType, kind)):
            return f"`{field.name}`"
    known = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema.fields)
    raise ValueError(f"no column containing '{fragment}' in schema [{known}]")


def sensor_id(df: DataFrame, name: str) -> Column:
    """A sensor or class id as TINYINT: only 8-bit and 32-bit inputs, and out-of-range values raise."""
    kind = df.select(name).schema[0].dataType
    if not isinstance(kind, (T.ByteType, T.IntegerType)):
        raise ValueError(f"sensor id column {name} has type {kind.simpleString()}; expected tinyint or int")
    column = F.col(name)
    if isinstance(kind, T.ByteType):
        return column
    bad = (column < -128) | (column > 127)
    return F.when(bad, F.raise_error(F.lit(f"sensor id out of range in {name}"))).otherwise(column.try_cast("tinyint"))


def _located(df: DataFrame) -> DataFrame:
    """Ensure ``file_name`` and ``seq``: from the file metadata when the table does not carry them."""
    if "file_name" not in df.columns:
        df = df.withColumn("file_name", F.col("_metadata.file_name"))
    if "seq" not in df.columns:
        raise ValueError("raw tables need an explicit arrival-order column `seq`")
    return df


def _capped(frames: DataFrame, max_per_file: int | None) -> DataFrame:
    if max_per_file is None:
        return frames
    return first_k(frames, ["file_name"], [F.col("seq")], max_per_file, rank="__rank").drop("__rank")


def camera_frames(df: DataFrame, sensor: int = FRONT_CAMERA, max_per_file: int | None = None) -> DataFrame:
    """Frames of one camera: ``file_name, seq, segment, timestamp_micros, image``; cap applies after the filter."""
    segment, ts = find_column(df, SEGMENT), find_column(df, TIMESTAMP)
    name, image = find_column(df, CAMERA_NAME), find_column(df, IMAGE, T.BinaryType)
    frames = (
        _located(df)
        .where(sensor_id(df, name) == F.lit(sensor))
        .select(
            "file_name", "seq", F.col(segment).alias("segment"), F.col(ts).alias("timestamp_micros"),
            F.col(image).alias("image"),
        )
    )
    return _capped(frames, max_per_file)


def lidar_frames(df: DataFrame, sensor: int = TOP_LASER, max_per_file: int | None = None) -> DataFrame:
    """Frames of one laser with ``range_values`` and a three-entry ``shape``; null lists become empty / zeros."""
    segment, ts = find_column(df, SEGMENT), find_column(df, TIMESTAMP)
    name = find_column(df, LASER_NAME)
    values, shape = find_column(df, RANGE_VALUES, T.ArrayType), find_column(df, RANGE_SHAPE, T.ArrayType)
    short = F.col(shape).isNotNull() & (F.size(F.col(shape)) < 3)
    whole = F.when(short, F.raise_error(F.lit("range shape needs three entries")).cast("boolean")).otherwise(True)
    zeros = F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<int>")
    frames = (
        _located(df)
        .where(sensor_id(df, name) == F.lit(sensor))
        .where(whole)
        .select(
            "file_name", "seq", F.col(segment).alias("segment"), F.col(ts).alias("timestamp_micros"),
            F.coalesce(F.col(values), F.array().cast("array<float>")).alias("range_values"),
            F.coalesce(F.slice(F.col(shape), 1, 3), zeros).alias("shape"),
        )
    )
    return _capped(frames, max_per_file)


def box_rows(df: DataFrame, sensor: int = FRONT_CAMERA) -> DataFrame:
    """Object boxes of one camera: ``segment, timestamp_micros, type``."""
    name, kind = find_column(df, CAMERA_NAME), find_column(df, BOX_TYPE)
    extra = ["file_name"] if "file_name" in df.columns else []
    return df.where(sensor_id(df, name) == F.lit(sensor)).select(
        *extra,
        F.col(find_column(df, SEGMENT)).alias("segment"),
        F.col(find_column(df, TIMESTAMP)).alias("timestamp_micros"),
        sensor_id(df, kind).alias("type"),
    )
