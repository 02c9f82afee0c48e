"""Training runs: epoch losses, seed intervals, run index upkeep, comparison and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.arrays import fixed6, let, positions, round_half_away
from framewise.operators.ordered import first_per_key, running

EVAL_PRIORITY = ("val", "test", "train")
REPORT_ORDER = ("train", "val", "test")


def epoch_loss(batch_losses: DataFrame, by: list[str], loss: str = "loss", weight: str = "batch_size") -> DataFrame:
    """Batch-size weighted mean loss."""
    w = F.col(weight).cast("double")
    return batch_losses.groupBy(*by).agg((F.try_divide(F.sum(F.col(loss) * w), F.sum(w))).alias("loss"))


def seed_ci(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean with the smallest and largest value over seeds; a single seed gives a point estimate."""
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n_seeds")
    )


def upsert(index: DataFrame, new: DataFrame, key: str = "run_id", order: str | None = None) -> DataFrame:
    """Rows of ``index`` that ``new`` does not replace, then ``new``; with ``order``, the latest of ``new`` per key."""
    latest = first_per_key(new, [key], F.col(order), last=True) if order else new
    return index.join(latest.select(key), key, "left_anti").unionByName(latest)


def with_eval(runs: DataFrame, evals: DataFrame, priority: tuple[str, ...] = EVAL_PRIORITY) -> DataFrame:
    """Each run with its first available evaluation in split priority; runs without one keep NULLs."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("split"))
    ranked = evals.withColumn("__p", order).where("__p > 0")
    best = first_per_key(ranked, ["run_name"], F.col("__p")).drop("__p").withColumnRenamed("split", "eval_split")
    return runs.join(best, "run_name", "left")


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def _fixed(value: Column) -> Column:
    """Six decimals, ``inf`` for infinity, ``-`` for NULL. Evaluation metrics are single precision."""
    return (
        F.when(value.isNull(), "-")
        .when(value == F.lit(float("inf")), "inf")
        .otherwise(fixed6(value))
    )


BASE_COLUMNS = ["run_name", "model", "epochs", "final_train_loss", "final_val_loss", "backend"]
EVAL_COLUMNS = ["eval_split", "rgb_mse", "rgb_psnr", "rgb_ssim", "range_mse", "range_psnr", "range_depth_mae_m", "range_valid_frac"]


def comparison(runs: DataFrame, evals: DataFrame) -> DataFrame:
    """Text cells of the comparison table: 14 columns when any evaluation exists, otherwise 6. Order by ``run_order``."""
    base = [
        "run_order",
        escape_pipes(F.col("run_name")).alias("run_name"),
        escape_pipes(F.col("model")).alias("model"),
        F.col("epochs").cast("string").alias("epochs"),
        _fixed(F.col("final_train_loss")).alias("final_train_loss"),
        _fixed(F.col("final_val_loss")).alias("final_val_loss"),
        escape_pipes(F.col("backend")).alias("backend"),
    ]
    joined = with_eval(runs, evals)
    if evals.join(runs.select("run_name"), "run_name", "left_semi").isEmpty():
        return joined.select(*base)
    return joined.select(
        *base, F.coalesce(escape_pipes(F.col("eval_split")), F.lit("-")).alias("eval_split"),
        *[_fixed(F.col(c).cast("float")).alias(c) for c in EVAL_COLUMNS[1:]],
    )


def report_rows(evals: DataFrame) -> DataFrame:
    """Rows per split and modality in the order train, val, test; missing modalities are absent."""
    order = F.array_position(F.array(*[F.lit(s) for s in REPORT_ORDER]), F.col("split")).cast("int")
    none = F.lit(None).cast("double")

    def entry(name: str, i: int, mse: str, psnr: str, similarity: Column, depth: Column, valid: Column) -> Column:
        return F.when(
            F.col(mse).isNotNull(),
            F.struct(
                F.lit(i).alias("modality_order"), F.lit(name).alias("modality"),
                *[
                    _fixed(v.cast("float")).alias(n)
                    for n, v in (
                        ("mean_mse", F.col(mse)), ("mean_psnr", F.col(psnr)), ("mean_ssim", similarity),
                        ("mean_depth_mae_m", depth), ("mean_valid_fraction", valid),
                    )
                ],
            ),
        )

    entries = F.array(
        entry("RGB", 0, "rgb_mse", "rgb_psnr", F.col("rgb_ssim"), none, none),
        entry("Range", 1, "range_mse", "range_psnr", none, F.col("range_depth_mae_m"), F.col("range_valid_frac")),
    )
    return evals.select(
        "run_name", "split", order.alias("split_order"), F.col("n_samples"),
        F.inline(F.filter(entries, lambda e: e.isNotNull())),
    )


def curve_buckets(epochs: DataFrame, by: list[str], epoch: str = "epoch", value: str = "loss", width: int = 10, levels: int = 8) -> DataFrame:
    """``width`` evenly spaced epochs as bucket numbers ``0 .. levels-1`` between their smallest and largest value.

    Epochs are ranked in pieces; only the ``width`` sampled ones of a curve are collected.
    """
    ranked = running(epochs.select(*by, epoch, value), by, [F.col(epoch)], rank="__at")
    sized = epochs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    spots = F.transform(
        positions(width), lambda i: round_half_away(i * (F.col("__n") - 1) / F.lit(float(width - 1))).cast("bigint") + 1
    )
    wanted = sized.select(*by, F.posexplode(spots).alias("__slot", "__at"))
    picked = (
        ranked.join(wanted, [*by, "__at"])
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("__slot", F.col(value).cast("double").alias("v")))).alias("s"))
    )
    values = F.transform("s", lambda e: e["v"])

    def levelled(b: Column) -> Column:
        low, span = F.array_min(b), F.array_max(b) - F.array_min(b)
        flat = F.transform(b, lambda _: F.lit(0))
        scaled = F.transform(
            b, lambda v: round_half_away(F.try_divide(v - low, F.nullif(span, F.lit(0.0))) * (levels - 1)).cast("int")
        )
        return F.when(span < F.lit(2.220446049250313e-16), flat).otherwise(scaled)

    return picked.select(*by, let(values, levelled).alias("buckets"))
