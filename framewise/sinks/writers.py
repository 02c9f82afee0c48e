"""Sinks: sample tables, evaluation rows as CSV / JSON / Markdown cells, label and normalisation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.arrays import fixed6, let
from framewise.functions.tensors import MAX_RANGE_METERS, RANGE_HEIGHT, RANGE_WIDTH, channel_list
from framewise.operators.labels import BENCHMARKABLE, CLASSES

# Column order of the evaluation CSV.
EVAL_CSV_COLUMNS = [
    "sample_id", "rgb_mse", "rgb_mae", "rgb_rmse", "rgb_psnr_db", "rgb_ssim",
    "range_mse", "range_mae", "range_rmse", "range_psnr_db", "range_ssim",
    "range_proxy_psnr_db", "range_proxy_ssim", "range_depth_mae_m", "range_depth_rmse_m",
    "range_delta_lt_1_25", "range_delta_lt_1_25_sq", "range_valid_pixel_fraction",
]


def write_samples(samples: DataFrame, path: str) -> None:
    """Sample rows partitioned by split."""
    samples.write.mode("overwrite").partitionBy("split").parquet(path)


def metric_text(value: Column) -> Column:
    """Shortest single-precision decimal text, never in exponent form; NULL stays NULL, +inf is ``inf``.

    What metrics usually are takes a short path. The rest is a lambda: written out for each column, a row of the CSV is one
    method of twice the size that the JVM compiles, and runs interpreted.
    """
    f = value.cast("float")
    whole, size = f.cast("int"), F.abs(f.cast("double"))
    return (
        F.when(f.isNull(), F.lit(None).cast("string"))
        .when((size >= 1e-3) & (size < 1e7), F.when(whole.cast("float") == f, whole.cast("string")).otherwise(f.cast("string")))
        .when(f == 0, F.substring_index(f.cast("string"), ".", 1))
        .otherwise(let(f, _unusual_text))
    )


def _unusual_text(f: Column) -> Column:
    """Text of what Java writes with an exponent or a word."""
    text, size = f.cast("string"), F.abs(f.cast("double"))
    small = F.rtrim(text.try_cast("decimal(38,37)").cast("string"), F.lit("0"))
    return (
        F.when(F.isnan(f) | (size == F.lit(float("inf"))), F.when(f > 0, "inf").otherwise(text))
        .when(size < 1e-3, small)
        .otherwise(text.try_cast("decimal(38,0)").cast("string"))
    )


def eval_csv_rows(sample_eval: DataFrame) -> DataFrame:
    """The 18 CSV columns as text, NULL for missing metrics; write with ``write_eval_csv``."""
    source = {
        "rgb_mse": "rgb.mse", "rgb_mae": "rgb.mae", "rgb_rmse": "rgb.rmse", "rgb_psnr_db": "rgb.psnr_db", "rgb_ssim": "rgb.ssim",
        "range_mse": "range.mse", "range_mae": "range.mae", "range_rmse": "range.rmse",
        "range_psnr_db": "range.psnr_db", "range_ssim": "range.ssim",
        "range_proxy_psnr_db": "range.psnr_db", "range_proxy_ssim": "range.ssim",
        "range_depth_mae_m": "depth.mae_m", "range_depth_rmse_m": "depth.rmse_m",
        "range_delta_lt_1_25": "depth.d125", "range_delta_lt_1_25_sq": "depth.d125_sq",
        "range_valid_pixel_fraction": "depth.valid_fraction",
    }
    return sample_eval.select("sample_id", *[metric_text(F.col(source[c])).alias(c) for c in EVAL_CSV_COLUMNS[1:]])


def write_eval_csv(sample_eval: DataFrame, path: str) -> None:
    """CSV with header, empty for NULL, quotes doubled."""
    eval_csv_rows(sample_eval).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quote='"', escape='"')


def eval_summary_rows(summary: DataFrame) -> DataFrame:
    """Markdown table lines per split and modality; a split without any modality has one ``None`` line."""

    def text(c: str) -> Column:
        return F.coalesce(metric_text(F.col(c)), F.lit("-"))

    dash = F.lit("-")

    def line(label: str, m: str, depth: list[Column]) -> Column:
        cells = [
            F.lit(label), fixed6(F.col(f"{m}.mean_mse")), fixed6(F.col(f"{m}.mean_mae")), fixed6(F.col(f"{m}.mean_rmse")),
            text(f"{m}.mean_psnr_db"), text(f"{m}.mean_ssim"), *depth, fixed6(F.col(f"{m}.std_mse")),
        ]
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    depth = [text(f"depth.{c}") for c in ("mean_mae_m", "mean_rmse_m", "mean_d125", "mean_d125_sq", "mean_valid_fraction")]
    lines = F.array(
        F.when(F.col("rgb").isNotNull(), F.struct(F.lit(0).alias("line_no"), line("RGB", "rgb", [dash] * 5).alias("line"))),
        F.when(F.col("range").isNotNull(), F.struct(F.lit(1).alias("line_no"), line("Range", "range", depth).alias("line"))),
        F.when(
            F.col("rgb").isNull() & F.col("range").isNull(),
            F.struct(F.lit(0).alias("line_no"), F.lit("| None |" + " - |" * 11).alias("line")),
        ),
    )
    return summary.select("split", "n_samples", F.inline(F.filter(lines, lambda x: x.isNotNull())))


def write_eval_json(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def label_rows(labels: DataFrame) -> DataFrame:
    """Label rows sorted by sample id with their class lists."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    bench = F.array(*[F.lit(c) for c in BENCHMARKABLE])
    return labels.withColumns({"classes": names, "benchmarkable_classes": bench}).orderBy("sample_id")


def normalization_row(spark, channels: list[str], lidar_sensor: int = 1, h: int = RANGE_HEIGHT, w: int = RANGE_WIDTH) -> DataFrame:
    """How range channels were normalised, as one row."""
    return spark.createDataFrame(
        [(lidar_sensor, MAX_RANGE_METERS, h, w, channel_list(channels))],
        "lidar_sensor int, max_range_meters double, height int, width int, output_channels array<string>",
    )


def write_labels(labels: DataFrame, path: str) -> None:
    label_rows(labels).write.mode("overwrite").json(path)
