"""Sensor-shaped views over plain tables: events become frames and boxes, embeddings become tensors.

All views are lazy projections of the whole table.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
FILES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def array_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for costly per-row work. A table with fewer scan tasks than cores is spread over them;
    a large table already has more tasks than that and is left as it is, without a shuffle."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    of_day = F.hour(ts).cast("bigint") * 3600 + F.minute(ts) * 60
    part = F.extract(F.lit("SECOND"), ts) * 1_000_000
    return F.unix_date(ts.cast("date")).cast("bigint") * DAY_MICROS + of_day * 1_000_000 + part.cast("bigint")


def day_micros(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("bigint") * DAY_MICROS


def _keys(exact: bool) -> list[Column]:
    return [
        F.format_string("part-%02d.parquet", F.col("user_id") % FILES).alias("file_name"),
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("key.segment_context_name"),
        (day_micros(F.col("ts")) if exact else micros(F.col("ts"))).alias("key.frame_timestamp_micros"),
    ]


def raw_camera(events: DataFrame, exact: bool = True) -> DataFrame:
    """Views are camera 1, purchases camera 2."""
    return events.where(F.col("event_type").isin("view", "purchase")).select(
        *_keys(exact),
        F.when(F.col("event_type") == "view", 1).otherwise(2).cast("tinyint").alias("key.camera_name"),
        F.col("props").cast("binary").alias("[CameraImage].image"),
    )


def raw_lidar(events: DataFrame, exact: bool = True) -> DataFrame:
    """Clicks are laser 1, errors laser 2; every seventh range image is missing."""
    there = F.col("event_id") % 7 != 0
    return events.where(F.col("event_type").isin("click", "error")).select(
        *_keys(exact),
        F.when(F.col("event_type") == "click", 1).otherwise(2).cast("int").alias("key.laser_name"),
        F.when(there, F.array(F.col("value"), F.col("value") / 2, F.lit(0.0), F.lit(1.0)).cast("array<float>")).alias(
            "[Lidar].range_image_return1.values"
        ),
        F.when(there, F.array(F.lit(1), F.lit(2), F.lit(2))).alias("[Lidar].range_image_return1.shape"),
    )


def raw_boxes(events: DataFrame) -> DataFrame:
    """One box per event; every tenth event belongs to camera 2; views have an unknown type."""
    code = (
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "error", 3).when(F.col("event_type") == "signup", 4).otherwise(9)
    )
    return events.select(
        *_keys(True),
        F.when(F.col("event_id") % 10 == 0, 2).otherwise(1).cast("tinyint").alias("key.camera_name"),
        code.cast("int").alias("[CameraBoxComponent].type"),
    )


def tensors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, sample_id, split, label, x, rgb (3x4x4), range (2x4x8), rgb_hat, range_hat``, ``hat``."""
    x = F.transform("embedding", lambda e: (e.cast("double") + 1) / 2)
    noisy = F.when(F.col("vec_id") % 7 == 0, F.col("x")).otherwise(
        F.transform("x", lambda v, i: v + F.sin(i.cast("double")) * 0.05)
    )
    split = F.when(F.col("vec_id") % 10 == 0, "val").when(F.col("vec_id") % 10 == 1, "test").otherwise("train")
    return (
        embeddings.select(
            "vec_id", F.format_string("sample_%06d", "vec_id").alias("sample_id"), split.alias("split"), "label",
            "embedding", x.alias("x"),
        )
        .withColumn("hat", noisy)
        .select(
            "vec_id", "sample_id", "split", "label", "embedding", "x", "hat",
            F.slice("x", 1, 48).alias("rgb"), F.col("x").alias("range"),
            # one in eleven samples has no RGB reconstruction, one in thirteen no range reconstruction
            F.when(F.col("vec_id") % 11 != 0, F.slice("hat", 1, 48)).alias("rgb_hat"),
            F.when(F.col("vec_id") % 13 != 0, F.col("hat")).alias("range_hat"),
        )
    )


TILE_H, TILE_W = 12, 16
#: Larger RGB tensors ``3 x 12 x 16`` repeat the 64 values out of step: the number of the value at each pixel.
TILE = np.arange(3 * TILE_H * TILE_W) * 7 % 64


def raw_range(embeddings: DataFrame) -> DataFrame:
    """Interleaved ``4 x 8 x 2`` range images in metres; short distances become missing returns."""
    v = F.transform("embedding", lambda e: F.abs(e.cast("double")) * 150)
    return embeddings.select(
        "vec_id", F.transform(v, lambda m: F.when(m < 7.5, 0.0).otherwise(m)).alias("values"),
        F.lit(4).alias("h"), F.lit(8).alias("w"), F.lit(2).alias("c"),
    )


def probe_rows(embeddings: DataFrame) -> DataFrame:
    """Features with ten presence classes and two counts; parts by ``vec_id``: train, val, eval."""
    part = F.when(F.col("vec_id") % 5 == 3, "val").when(F.col("vec_id") % 5 == 4, "eval").otherwise("train")
    return embeddings.select(
        F.format_string("sample_%06d", "vec_id").alias("sample_id"), part.alias("part"), F.col("vec_id").alias("idx"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.array(*[(F.col("label") == k).cast("tinyint") for k in range(10)]).alias("presence"),
        F.array(F.col("label").cast("double"), (F.col("vec_id") % 7).cast("double")).alias("counts"),
    )


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Long scores with many ties: two classes over labelled documents, plus one without positives."""
    s = F.round(F.col("n_chars") / (F.col("n_chars") + 2000), 2)
    entries = F.array(
        F.struct(F.lit("quality").alias("class"), F.col("quality").alias("label")),
        F.struct(F.lit("toxic").alias("class"), F.col("toxic").alias("label")),
        F.struct(F.lit("never").alias("class"), F.lit(0).alias("label")),
    )
    return documents.join(labels, "doc_id").select(F.col("doc_id").alias("idx"), s.alias("score"), F.inline(entries)).select(
        "class", "idx", "label", "score"
    )


def rd_points(part: DataFrame) -> DataFrame:
    """``curve, idx, mode, quality, rate, psnr_db, mse``; rates are not unique."""
    return part.select(
        F.col("p_brand").alias("curve"), F.col("p_partkey").alias("idx"), F.col("p_type").alias("mode"),
        F.col("p_size").cast("string").alias("quality"), F.col("p_retailprice").alias("rate"),
        F.col("p_size").cast("double").alias("psnr_db"), (F.lit(1.0) / (F.col("p_size") + 1)).alias("mse"),
    )


def file_list(documents: DataFrame) -> DataFrame:
    """One file per document: ``seq, uri, object_path, split, component, file_name, size_bytes``."""
    i = F.col("doc_id")
    split = F.when(i % 10 < 6, "training").when(i % 10 == 6, "validation").when(i % 10 == 7, "testing").otherwise("other")
    component = F.when(i % 3 == 0, "camera_image").otherwise("lidar")
    name = F.concat(F.lit("doc_"), i.cast("string"), F.lit(".parquet"))
    path = F.concat_ws("/", split, component, name)
    return documents.select(
        i.alias("seq"), F.concat(F.lit("gs://bucket/"), path).alias("uri"), path.alias("object_path"),
        split.alias("split"), component.alias("component"), name.alias("file_name"), F.col("n_chars").alias("size_bytes"),
    )


def listing_lines(documents: DataFrame) -> DataFrame:
    """Long-format listing text: object lines, directories, blanks, totals and lines without a size."""
    i = F.col("doc_id")
    uri = F.concat(F.lit("gs://bucket/training/camera_image/doc_"), i.cast("string"), F.lit(".parquet"))
    line = (
        F.when(i % 17 == 0, "")
        .when(i % 17 == 1, F.lit("gs://bucket/training/camera_image/"))
        .when(i % 17 == 2, F.concat(F.lit("TOTAL: 3 objects, "), F.col("n_chars").cast("string"), F.lit(" bytes")))
        .when(i % 17 == 3, uri)
        .when(i % 17 == 4, F.concat(F.lit("gs://bucket/training/dir_"), i.cast("string"), F.lit("/:")))
        .when(i % 17 == 5, F.lit("no object here"))
        .otherwise(F.concat(F.lit("   "), F.col("n_chars").cast("string"), F.lit("  2024-01-01T00:00:00Z  "), uri, F.lit("  ")))
    )
    return documents.select(i.alias("line_no"), line.alias("value"))


def run_table(supplier: DataFrame) -> DataFrame:
    """Training runs: one per supplier."""
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("run_order"),
        F.when(k % 5 == 0, F.concat(F.col("s_name"), F.lit("|b"))).otherwise(F.col("s_name")).alias("run_name"),
        F.when(k % 3 == 0, "range-only").when(k % 3 == 1, "rgb-only").otherwise("fusion").alias("model"),
        (k % 4 + 1).cast("int").alias("epochs"),
        (F.abs(F.col("s_acctbal")) / 10000).alias("final_train_loss"),
        F.when(k % 6 != 0, F.abs(F.col("s_acctbal")) / 9000).alias("final_val_loss"),
        F.lit("cpu").alias("backend"),
    )


def eval_table(supplier: DataFrame) -> DataFrame:
    """Evaluations per run and split, with missing splits and missing modalities."""
    k = F.col("s_suppkey")
    split = F.explode(
        F.array(
            F.when(k % 2 == 0, F.lit("train")), F.when(k % 3 == 0, F.lit("val")), F.when(k % 5 < 2, F.lit("test"))
        )
    )
    base = run_table(supplier).select("run_order", "run_name", "model", F.col("final_train_loss").alias("loss"))
    rows = supplier.select(k.alias("run_order"), split.alias("split")).where("split is not null").join(base, "run_order")
    scale = F.col("loss") * F.length("split")
    has_rgb, has_range = F.col("model") != "range-only", F.col("model") != "rgb-only"
    return rows.select(
        "run_name", "split", (F.col("run_order") % 50 + 1).alias("n_samples"),
        F.when(has_rgb, scale).alias("rgb_mse"), F.when(has_rgb, scale * 20).alias("rgb_psnr"),
        F.when(has_rgb, scale / 4).alias("rgb_ssim"),
        F.when(has_range, scale * 2).alias("range_mse"), F.when(has_range, scale * 30).alias("range_psnr"),
        F.when(has_range, scale * 3).alias("range_depth_mae_m"), F.when(has_range, scale / 3).alias("range_valid_frac"),
    )
