"""Linear probe on frozen features: one logistic model per class, one linear model per count target."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.functions.arrays import doubles
from framewise.operators import heads as solver
from framewise.operators.baselines import binary_cross_entropy, class_weights, log_loss, standardize
from framewise.operators.ranking import macro, per_class, regression
from framewise.session import stage

# Default regularisation grid.
L2_GRID = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)
TIE = 2.220446049250313e-16
SIGNS = {"average precision": 1.0, "balanced accuracy": 1.0, "rmse": -1.0, "mae": -1.0}


@dataclass(frozen=True)
class ProbeConfig:
    l2: float = 1e-3
    balance_classes: bool = True
    standardize: bool = True
    loss: str = "huber"
    huber_delta: float = 1.0
    max_iter: int = 200


def linear(df: DataFrame, config: ProbeConfig = ProbeConfig(), eval_part: str = "eval") -> DataFrame:
    """``metric, value, na_reason``: losses and macro metrics of the fitted heads on ``eval_part``."""
    scores, counts = heads(df, config, eval_part)
    out = None
    if scores is not None:
        loss = scores.groupBy("part").agg(
            F.avg(binary_cross_entropy(F.col("label"), F.col("score")) * F.col("weight")).alias("value")
        ).select(F.concat("part", F.lit("_classification_loss")).alias("metric"), "value", F.lit(None).cast("string").alias("na_reason"))
        held = scores.where(F.col("part") == eval_part).select("class", "idx", "label", "score")
        out = loss.unionByName(macro(per_class(held)))
    if counts is not None:
        diff = F.col("pred_log") - F.log1p(F.greatest(F.col("truth").cast("double"), F.lit(0.0)))
        loss = counts.groupBy("part").agg(F.avg(log_loss(diff, config.loss, config.huber_delta)).alias("value")).select(
            F.concat("part", F.lit("_regression_loss")).alias("metric"), "value", F.lit(None).cast("string").alias("na_reason")
        )
        reg = loss.unionByName(macro(regression(counts.where(F.col("part") == eval_part))))
        out = reg if out is None else out.unionByName(reg)
    if out is None:
        raise ValueError("probe rows need presence or counts")
    return out


def heads(
    df: DataFrame, config: ProbeConfig, eval_part: str = "eval", grid: tuple[float, ...] | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Scores ``part, class, idx, label, score, weight`` and counts ``part, target, idx, truth, pred_log``.

    All classes, count targets and penalties of ``grid`` are fitted together: each step is one pass over the training
    rows. With a grid both tables have ``l2`` too. The prepared rows are staged, as every pass reads them.
    """
    penalties = list(grid) if grid else [config.l2]
    ready = standardize(df) if config.standardize else df
    ready = ready.where(F.col("part").isin("train", eval_part)).withColumn("features", doubles(F.col("features")))
    ready = stage(ready.select("part", "idx", "features", "presence", "counts"))
    train = ready.where("part = 'train'")
    widths = train.agg(
        F.max(F.size("presence")).alias("p"), F.max(F.size("counts")).alias("c"), F.max(F.size("features")).alias("d"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not widths["n"]:
        raise ValueError("probe training needs at least one row")
    n_classes, n_targets, d = max(widths["p"] or 0, 0), max(widths["c"] or 0, 0), widths["d"]
    if not n_classes + n_targets:
        return None, None
    weights = np.ones(n_classes + n_targets)
    if n_classes and config.balance_classes:
        found = {r["class"]: r["weight"] for r in class_weights(df).collect()}
        weights[:n_classes] = [found[f"class_{k}"] for k in range(n_classes)]
    labels = F.transform(F.col("presence"), lambda v: v.cast("double")) if n_classes else F.array().cast("array<double>")
    logs = (
        F.transform(F.col("counts"), lambda v: F.log1p(F.greatest(v.cast("double"), F.lit(0.0)))) if n_targets else F.array().cast("array<double>")
    )
    n_heads = n_classes + n_targets
    head = np.tile(np.arange(n_heads), len(penalties))
    share = np.where(head < n_classes, 1.0 / max(n_classes, 1), 1.0 / max(n_targets, 1))
    w = solver.fit(
        train.select("features", F.concat(labels, logs).alias("y")), d, ["logistic"] * n_classes + [config.loss] * n_targets, head, weights[head],
        np.repeat(np.array(penalties, float), n_heads), share, max(config.huber_delta, 0.0), config.max_iter,
    )
    out = solver.mapped(F.col("features"), ready, w[:, :-1].T, np.zeros(d))
    scored = ready.withColumn("z", out)

    def entries(first: int, n: int, name: str, value, shown: str, with_weight: bool):
        rows = []
        for g, l2 in enumerate(penalties):
            for k in range(n):
                at = g * n_heads + first + k
                z = F.get("z", F.lit(at)) + F.lit(float(w[at, -1]))
                parts = [F.lit(float(l2)).alias("l2"), F.lit(f"{name}_{k}").alias("class" if with_weight else "target"), *value(k, z)]
                rows.append(F.struct(*parts, *([F.lit(float(weights[first + k])).alias("weight")] if with_weight else [])))
        return F.array(*rows)

    def as_class(k: int, z):
        return F.get("presence", F.lit(k)).cast("int").alias("label"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score")

    def as_count(k: int, z):
        return F.get("counts", F.lit(k)).cast("double").alias("truth"), z.alias("pred_log")

    scores = scored.select("part", "idx", F.inline(entries(0, n_classes, "class", as_class, "score", True))) if n_classes else None
    counts = scored.select("part", "idx", F.inline(entries(n_classes, n_targets, "count", as_count, "pred_log", False))) if n_targets else None
    if grid is None:
        scores, counts = (t.drop("l2") if t is not None else None for t in (scores, counts))
    return scores, counts


def selection_score(metrics: DataFrame) -> DataFrame:
    """Mean of the defined ones of mAP, balanced accuracy, -RMSE and -MAE, per ``l2``."""
    sign = F.try_element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), F.col("metric"))
    return metrics.groupBy("l2").agg(F.avg(F.col("value") * sign).alias("validation_score"))


def pick_l2(candidates: DataFrame) -> DataFrame:
    """The best candidate; scores equal within machine epsilon go to the smaller ``l2``. The grid is tiny."""
    best = candidates.agg(F.max("validation_score")).scalar()
    return candidates.where(best - F.col("validation_score") <= TIE).agg(
        F.min("l2").alias("selected_l2"), F.max("validation_score").alias("validation_score")
    )


def candidates(df: DataFrame, grid: tuple[float, ...] = L2_GRID, config: ProbeConfig = ProbeConfig()) -> DataFrame:
    """``l2, metric, value``: macro metrics of every candidate on the ``val`` part, all fitted in the same passes."""
    grid = tuple(grid or L2_GRID)
    for l2 in grid:
        if not math.isfinite(l2) or l2 < 0:
            raise ValueError(f"invalid L2 candidate: {l2}")
    scores, counts = heads(df, config, "val", grid)
    if scores is None and counts is None:
        raise ValueError("probe rows need presence or counts")
    found = []
    for table, key, measure in ((scores, "class", per_class), (counts, "target", regression)):
        if table is not None:
            both = F.concat_ws(":", F.col("l2").cast("string"), F.col(key))
            named = measure(stage(table.where("part = 'val'").withColumn(key, both).drop("part", "l2", "weight")))
            found.append(named.select(F.substring_index(key, ":", 1).cast("double").alias("l2"), "metric", "value"))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.groupBy("l2", "metric").agg(F.avg("value").alias("value"))


def select_l2(df: DataFrame, grid: tuple[float, ...] = L2_GRID, config: ProbeConfig = ProbeConfig()) -> DataFrame:
    """``l2, validation_score, selected`` over the grid, each candidate scored on the ``val`` part."""
    rows = stage(selection_score(candidates(df, grid, config)))
    chosen = pick_l2(rows.where("validation_score is not null")).first()["selected_l2"]  # one row
    return rows.withColumn("selected", F.coalesce(F.col("l2") == F.lit(chosen), F.lit(False)))


def regularised(df: DataFrame, grid: tuple[float, ...] = L2_GRID, config: ProbeConfig = ProbeConfig()) -> DataFrame:
    """The winner of the grid fitted anew and measured on ``eval``: ``selected_l2, metric, value, na_reason``."""
    chosen = select_l2(df, grid, config).where("selected").first()
    if chosen is None:
        raise ValueError("no candidate has a defined metric")
    measured = linear(df, dataclasses.replace(config, l2=chosen["l2"]))
    return measured.select(F.lit(chosen["l2"]).alias("selected_l2"), "metric", "value", "na_reason")
