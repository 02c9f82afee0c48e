"""Ranking and regression metrics over long tables; undefined results are NULL with a reason.

Scores: ``class, idx, label, score``. Rows are laid out by leading digits of the score (``radix``), so a table with two
classes, or with one score shared by most rows, still spreads over all tasks, and no sort of the whole table is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.operators.radix import ScoreTree, wins

# Reasons for undefined metrics.
NO_POSITIVE = "requires at least one positive label"
NO_CONTRAST = "requires both positive and negative labels"
NO_F1 = "no positive labels or predictions"
NO_VARIANCE = "target variance is zero"
MAX_DOUBLE = 1.7976931348623157e308
EPSILON = 2.220446049250313e-16


def check_scores(scores: DataFrame) -> DataFrame:
    """Scores must be finite and in [0, 1], labels 0 or 1; anything else raises while rows flow."""
    s = F.col("score").cast("double")
    bad = s.isNull() | F.isnan(s) | (s < 0) | (s > 1)
    label = F.col("label")
    return scores.withColumn(
        "score", F.when(bad, F.raise_error(F.lit("scores must be finite and in [0, 1]"))).otherwise(F.col("score"))
    ).withColumn(
        "label", F.when(label.isin(0, 1), label).otherwise(F.raise_error(F.lit("labels must be 0 or 1")))
    )


def score_tree(scores: DataFrame, by: str = "class", threshold: float = 0.5) -> ScoreTree:
    """The scores in leaves of their order, with the predictions and hits at ``threshold`` counted on the way."""
    on = (F.col("score") >= threshold).cast("int")
    return ScoreTree(scores, by, {"on": on, "on_pos": on * F.col("label").cast("int")})


def average_precision(scores: DataFrame | ScoreTree, by: str = "class") -> DataFrame:
    """Mean precision at the positives, score descending, ties by ``idx``."""
    tree = scores if isinstance(scores, ScoreTree) else ScoreTree(check_scores(scores), by)
    hit = F.when(F.col("label") == 1, F.col("hits") / F.col("rank"))
    found = tree.ranked().groupBy(by).agg(F.avg(hit).alias("value"))
    out = tree.nodes.select(by).distinct().join(found, by, "left")
    return out.withColumn("na_reason", F.when(F.col("value").isNull(), NO_POSITIVE))


def auroc(scores: DataFrame | ScoreTree, by: str = "class") -> DataFrame:
    """Area under the ROC curve; tied pairs count half."""
    won = wins(scores if isinstance(scores, ScoreTree) else ScoreTree(check_scores(scores), by))
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    out = won.select(by, F.try_divide("wins", pairs).alias("value"))
    return out.withColumn("na_reason", F.when(F.col("value").isNull(), NO_CONTRAST))


def threshold_metrics(scores: DataFrame | ScoreTree, threshold: float = 0.5, by: str = "class") -> DataFrame:
    """``f1`` and ``balanced_accuracy`` at ``score >= threshold``, with reasons when undefined.

    A tree knows the counts of the threshold it was made with.
    """
    if isinstance(scores, ScoreTree):
        sums = scores.nodes.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("n", "pos", "on", "on_pos")])
        tp, on, pos = F.col("on_pos"), F.col("on"), F.col("pos")
        counted = sums.select(by, tp.alias("tp"), (F.col("n") - on - pos + tp).alias("tn"), (on - tp).alias("fp"), (pos - tp).alias("fn"))
    else:
        on, is_pos = F.col("score") >= threshold, F.col("label") == 1
        counted = scores.groupBy(by).agg(
            F.count_if(is_pos & on).alias("tp"), F.count_if(~is_pos & ~on).alias("tn"),
            F.count_if(~is_pos & on).alias("fp"), F.count_if(is_pos & ~on).alias("fn"),
        )
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    f1 = F.try_divide(tp * 2, tp * 2 + fp + fn)
    balanced = (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2
    return counted.withColumns({"f1": f1, "balanced_accuracy": balanced}).withColumns(
        {
            "f1_na_reason": F.when(F.col("f1").isNull(), NO_F1),
            "balanced_accuracy_na_reason": F.when(F.col("balanced_accuracy").isNull(), NO_CONTRAST),
        }
    )


def per_class(scores: DataFrame, by: str = "class") -> DataFrame:
    """Long rows ``class, metric, value, na_reason`` for the four classification metrics, from one reading of the scores."""
    tree = score_tree(check_scores(scores), by)
    ap = average_precision(tree, by).withColumn("metric", F.lit("average precision"))
    au = auroc(tree, by).withColumn("metric", F.lit("auroc"))
    th = threshold_metrics(tree, by=by)
    rows = F.array(
        F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value"), F.col("f1_na_reason").alias("na_reason")),
        F.struct(
            F.lit("balanced accuracy").alias("metric"), F.col("balanced_accuracy").alias("value"),
            F.col("balanced_accuracy_na_reason").alias("na_reason"),
        ),
    )
    cols = [by, "metric", "value", "na_reason"]
    return ap.select(*cols).unionByName(au.select(*cols)).unionByName(th.select(by, F.inline(rows)))


def macro(per_class_rows: DataFrame) -> DataFrame:
    """Mean over defined values of each metric; NULL with a reason when none is defined."""
    out = per_class_rows.groupBy("metric").agg(F.avg("value").alias("value"))
    reason = F.concat(F.lit("all "), F.col("metric"), F.lit(" values are undefined"))
    return out.withColumn("na_reason", F.when(F.col("value").isNull(), reason))


def classification(scores: DataFrame) -> DataFrame:
    """Macro mAP, F1, AUROC and balanced accuracy."""
    return macro(per_class(scores))


def log_to_count(pred_log: Column) -> Column:
    """``max(0, expm1(x))``; overflow becomes the largest double."""
    grown = F.expm1(pred_log.cast("double"))
    return F.when(grown == F.lit(float("inf")), F.lit(MAX_DOUBLE)).otherwise(F.greatest(grown, F.lit(0.0)))


def regression(rows: DataFrame, by: str = "target") -> DataFrame:
    """Long rows ``target, metric, value, na_reason`` (mae, rmse, r2) from ``target, truth, pred_log``.

    The total sum of squares comes from the numerically stable variance aggregate, so one pass is enough.
    """
    work = rows.select(
        by, F.greatest(F.col("truth").cast("double"), F.lit(0.0)).alias("t"), log_to_count(F.col("pred_log")).alias("p")
    )
    diff = F.col("t") - F.col("p")
    wide = work.groupBy(by).agg(
        F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.sum(diff * diff).alias("res"), (F.var_pop("t") * F.count(F.lit(1))).alias("tot"),
    )
    r2 = F.when(F.col("tot") > EPSILON, F.lit(1.0) - F.try_divide("res", "tot"))
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("metric"), v.alias("value"), r.alias("na_reason"))
            for n, v, r in (
                ("mae", F.col("mae"), F.lit(None).cast("string")),
                ("rmse", F.col("rmse"), F.lit(None).cast("string")),
                ("r2", r2, F.when(r2.isNull(), NO_VARIANCE)),
            )
        ]
    )
    return wide.select(by, F.inline(entries))
