"""Per-sample and per-split evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.metrics import depth_metrics, error_metrics, ssim
from framewise.functions.tensors import MAX_RANGE_METERS, plane
from framewise.operators import partials


def pair(pred: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions next to their truth."""
    return pred.join(truth, key)


def _with_ssim(errors: Column, similarity: Column) -> Column:
    return F.struct(
        *[errors[k].alias(k) for k in ("mse", "mae", "rmse", "psnr_db")], similarity.cast("double").alias("ssim")
    )


def sample_metrics(
    pairs: DataFrame, rgb_hw: tuple[int, int] | None, range_hw: tuple[int, int] | None, validity_channel: int | None = None,
    max_range_m: float = MAX_RANGE_METERS, range_channels: int = 1,
) -> DataFrame:
    """``sample_id, split, rgb, range, depth`` structs; a missing prediction leaves its struct NULL.

    Columns in: ``rgb_hat, rgb, range_hat, range`` (planar). Range errors use the first ``range_channels`` planes.
    """
    null = F.lit(None)
    rgb = rng = depth = None
    if rgb_hw:
        similarity = ssim(F.col("rgb_hat"), F.col("rgb"), *rgb_hw)
        rgb = F.when(
            F.col("rgb_hat").isNotNull(), _with_ssim(error_metrics(F.col("rgb_hat"), F.col("rgb")), similarity)
        )
    if range_hw:
        n = range_hw[0] * range_hw[1]
        head = [F.slice(F.col(c), 1, n * range_channels) for c in ("range_hat", "range")]
        rng = F.when(F.col("range_hat").isNotNull(), _with_ssim(error_metrics(*head), null))
        depth = F.when(
            F.col("range_hat").isNotNull(),
            depth_metrics(F.col("range_hat"), F.col("range"), n, validity_channel, max_range_m),
        )
    modality = "struct<mse:double,mae:double,rmse:double,psnr_db:double,ssim:double>"
    depth_type = "struct<mae_m:double,rmse_m:double,d125:double,d125_sq:double,valid_fraction:double>"
    return pairs.select(
        "sample_id", "split",
        (rgb if rgb is not None else null).cast(modality).alias("rgb"),
        (rng if rng is not None else null).cast(modality).alias("range"),
        (depth if depth is not None else null).cast(depth_type).alias("depth"),
    )


def modality_summary(col: str) -> list[Column]:
    """Means over rows that have the modality; SSIM over rows that define it; population std of MSE."""
    return [
        F.avg(f"{col}.mse").alias("mean_mse"),
        F.avg(f"{col}.mae").alias("mean_mae"),
        F.avg(f"{col}.rmse").alias("mean_rmse"),
        F.avg(f"{col}.psnr_db").alias("mean_psnr_db"),
        F.avg(f"{col}.ssim").alias("mean_ssim"),
        F.stddev_pop(f"{col}.mse").alias("std_mse"),
    ]


def depth_summary(col: str) -> list[Column]:
    """Each metric over the rows that define it; the valid fraction over all."""
    names = {"mae_m": "mean_mae_m", "rmse_m": "mean_rmse_m", "d125": "mean_d125", "d125_sq": "mean_d125_sq",
             "valid_fraction": "mean_valid_fraction"}
    return [F.avg(f"{col}.{k}").alias(v) for k, v in names.items()]


def summarize(sample_eval: DataFrame, by: str = "split", with_all: bool = False) -> DataFrame:
    """Per split: ``n_samples`` and nullable structs ``rgb, range, depth`` of means."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for m in ("rgb", "range", "depth"):
        parts = depth_summary(m) if m == "depth" else modality_summary(m)
        aggs.append(F.count(f"{m}.{'valid_fraction' if m == 'depth' else 'mse'}").alias(f"{m}_n"))
        aggs.append(F.struct(*parts).alias(m))
    grouped = sample_eval.rollup(by) if with_all else sample_eval.groupBy(by)
    out = grouped.agg(*aggs)
    for m in ("rgb", "range", "depth"):
        out = out.withColumn(m, F.when(F.col(f"{m}_n") > 0, F.col(m))).drop(f"{m}_n")
    return out.withColumn(by, F.coalesce(by, F.lit("all"))) if with_all else out


def combine(modality_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted mean over modality rows ``mse, psnr_db, ssim``; with no rows at all: 0, 0, NULL."""
    means = [
        F.coalesce(F.avg("mse"), F.lit(0.0)).alias("mse"),
        F.coalesce(F.avg("psnr_db"), F.lit(0.0)).alias("psnr_db"),
        F.avg("ssim").alias("ssim"),
    ]
    return modality_rows.groupBy(*by).agg(*means) if by else modality_rows.agg(*means)


def modality_rows(summary: DataFrame, by: str = "split") -> DataFrame:
    """Split summaries to long rows ``by, modality, mse, psnr_db, ssim``."""
    entries = F.array(
        *[
            F.when(
                F.col(m).isNotNull(),
                F.struct(
                    F.lit(m).alias("modality"), F.col(f"{m}.mean_mse").alias("mse"),
                    F.col(f"{m}.mean_psnr_db").alias("psnr_db"), F.col(f"{m}.mean_ssim").alias("ssim"),
                ),
            )
            for m in ("rgb", "range")
        ]
    )
    return summary.select(by, F.inline(F.filter(entries, lambda e: e.isNotNull())))


def evaluate(
    pred: DataFrame, truth: DataFrame, rgb_hw: tuple[int, int] | None, range_hw: tuple[int, int] | None,
    validity_channel: int | None = None, max_range_m: float = MAX_RANGE_METERS,
) -> tuple[DataFrame, DataFrame]:
    """Per-sample metrics and split summaries of predictions ``sample_id, rgb_hat, range_hat``.

    The summaries are summed where the tensors are read (``partials``); they do not read the per-sample rows.
    """
    pairs = pair(pred, truth)
    rows = sample_metrics(pairs, rgb_hw, range_hw, validity_channel, max_range_m)
    return rows, partials.split_means(pairs, rgb_hw, range_hw, validity_channel=validity_channel, max_range_m=max_range_m)


def tensor_stats(df: DataFrame, col: str, pixels: int | None = None, channel: int = 0) -> list[Column]:
    """Aggregates over finite values of an array column or of one of its planes, from per-row partials."""
    values = F.col(col) if pixels is None else plane(F.col(col), channel, pixels)
    finite = F.filter(values.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    count = F.sum(F.size(finite))
    sums = F.sum(F.aggregate(finite, F.lit(0.0), lambda a, v: a + v))
    squares = F.sum(F.aggregate(finite, F.lit(0.0), lambda a, v: a + v * v))
    mean = F.coalesce(F.try_divide(sums, count), F.lit(0.0))
    variance = F.coalesce(F.try_divide(squares, count), F.lit(0.0)) - mean * mean
    return [
        F.coalesce(F.min(F.array_min(finite)), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(F.array_max(finite)), F.lit(0.0)).alias("max"),
        mean.alias("mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
    ]


def stats(df: DataFrame, rgb: str, rng: str, range_pixels: int) -> DataFrame:
    """Rows ``tensor, min, max, mean, std`` for rgb, range channels 0 and 1, plus the valid fraction of channel 0."""
    first = plane(F.col(rng), 0, range_pixels)
    valid = F.try_divide(
        F.sum(F.size(F.filter(first, lambda v: v > 0))).cast("double"), F.sum(F.size(first)).cast("double")
    )
    pieces = {
        "rgb": tensor_stats(df, rgb),
        "range_0": tensor_stats(df, rng, range_pixels, 0),
        "range_1": tensor_stats(df, rng, range_pixels, 1),
    }
    wide = df.agg(*[F.struct(*cols).alias(name) for name, cols in pieces.items()], F.coalesce(valid, F.lit(0.0)).alias("vf"))
    rows = F.array(*[F.struct(F.lit(n).alias("tensor"), F.col(n).alias("s")) for n in pieces])
    return wide.select(F.inline(rows), "vf").select("tensor", "s.*", F.col("vf").alias("valid_fraction"))
