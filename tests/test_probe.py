"""Baselines and probes on synthetic signals, and projections against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import baselines, probe

QUICK = probe.ProbeConfig(max_iter=20, loss="mse")
SCHEMA = "sample_id string, part string, idx bigint, features array<double>, presence array<tinyint>, counts array<double>"


def synthetic(spark, noise=False, n=240, shift=False):
    """Features are waves of hidden signals; labels and counts follow the signals unless ``noise``."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(n):
        a, b = math.sin(0.7 * i), math.cos(1.3 * i)
        f = [a + 0.05 * rng.normal(), b + 0.05 * rng.normal(), a * b, math.sin(0.11 * i)]
        part = ("train", "train", "val", "eval")[i % 4]
        if noise:
            p, c = [int(x) for x in rng.integers(0, 2, 2)], [float(x) for x in rng.integers(0, 5, 1)]
        else:
            p, c = [int(a > 0.1), int(b > -0.2)], [float(round(math.expm1(1.0 + 0.8 * a)))]
        if shift and part == "eval":
            p = [0, 0]
        rows.append((f"s{i}", part, i, [float(x) for x in f], p, c))
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def metrics(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_separable_signal(spark):
    m = metrics(probe.linear(synthetic(spark), probe.ProbeConfig(l2=1e-4, max_iter=40)))
    assert m["average precision"] >= 0.9 and m["f1"] >= 0.85 and m["auroc"] >= 0.9 and m["balanced accuracy"] >= 0.85
    assert m["mae"] <= 1.2 and m["rmse"] <= 1.6 and m["r2"] >= 0.75


def test_noise_is_chance(spark):
    assert 0.3 <= metrics(probe.linear(synthetic(spark, noise=True, n=800), QUICK))["auroc"] <= 0.7


def test_constant_baselines(spark):
    plain, shifted = synthetic(spark), synthetic(spark, shift=True)
    m = metrics(baselines.class_prior(plain))
    assert m["auroc"] == 0.5
    m = metrics(baselines.class_prior(shifted))
    assert m["eval_loss"] > m["train_loss"] and m["auroc"] is None
    a, b = metrics(baselines.count_mean(plain, "count-mean")), metrics(baselines.count_mean(plain, "log1p-mean"))
    assert abs(a["rmse"] - b["rmse"]) > 1e-3
    with pytest.raises(ValueError):
        baselines.count_mean(plain, "median")


def test_projections_keep_the_signal(spark):
    df = synthetic(spark)
    prior = metrics(baselines.class_prior(df))["average precision"]
    once, again = (metrics(probe.linear(baselines.random_projection(df, 4, 3), QUICK))["average precision"] for _ in range(2))
    assert abs(once - again) < 1e-9 and once > prior + 0.05
    assert metrics(probe.linear(baselines.pca(df, 3), QUICK))["average precision"] > prior + 0.05


def test_pca_against_numpy(spark):
    df = synthetic(spark)
    got = baselines.pca(df, 6).orderBy("idx").toPandas()
    x = np.array(df.orderBy("idx").toPandas()["features"].tolist())
    train = x[(got["part"] == "train").to_numpy()]
    _, vectors = np.linalg.eigh(np.cov(train.T))
    vectors = vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(4)] < 0, -1, 1)
    want = (x - train.mean(0)) @ vectors
    z = np.array(got["features"].tolist())
    assert np.allclose(z[:, :4], want, atol=1e-6) and (z[:, 4:] == 0).all()


def test_standardize(spark):
    df = baselines.standardize(synthetic(spark)).where("part = 'train'").toPandas()
    x = np.array(df["features"].tolist())
    assert np.allclose(x.mean(0), 0, atol=1e-9) and np.allclose(x.std(0), 1, atol=1e-9)


def test_signs_follow_the_stream():
    state, seen = 5 ^ baselines.PROJECTION_SALT, []
    for _ in range(12):
        state = (state + baselines.GOLDEN_GAMMA) % 2**64
        z = state
        z = ((z ^ (z >> 30)) * baselines.MIX_1) % 2**64
        z = ((z ^ (z >> 27)) * baselines.MIX_2) % 2**64
        seen.append(1.0 if (z ^ (z >> 31)) & 1 else -1.0)
    assert baselines.projection_signs(3, 4, 5).ravel().tolist() == seen
    with pytest.raises(ValueError):
        baselines.projection_signs(3, 0, 5)


def test_l2_selection(spark):
    grid = (1e-4, 10.0)
    rows = probe.select_l2(synthetic(spark), grid, QUICK).collect()
    best = max(rows, key=lambda r: (r["validation_score"], -r["l2"]))
    assert [r["l2"] for r in rows if r["selected"]] == [best["l2"]] and {r["l2"] for r in rows} == set(grid)
    with pytest.raises(ValueError, match="invalid L2"):
        probe.select_l2(synthetic(spark), (-1.0,))
    ties = spark.createDataFrame([(0.1, 0.5), (0.01, 0.5), (1.0, 0.4)], "l2 double, validation_score double")
    assert probe.pick_l2(ties).first()["selected_l2"] == 0.01


def test_class_weights_change_the_fit(spark):
    df = synthetic(spark, n=120)
    fits = []
    for balanced in (True, False):
        scores, _ = probe.heads(df.withColumn("counts", F.lit(None).cast("array<double>")), probe.ProbeConfig(l2=0.1, balance_classes=balanced))
        fits.append([r["score"] for r in scores.orderBy("class", "idx").collect()])
    assert max(abs(a - b) for a, b in zip(*fits)) > 1e-4


@pytest.mark.parametrize("values", [1 << 22, 0])
def test_heads_are_at_the_minimum(spark, monkeypatch, values):
    """Gradients of the stated value at the fitted weights, by differences in plain numpy."""
    from framewise.operators import heads as solver

    monkeypatch.setattr(solver, "HESSIAN_VALUES", values)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3))
    y = np.column_stack([(x[:, 0] + rng.normal(size=90) > 0).astype(float), x[:, 1] * 2 + rng.standard_cauchy(90), x[:, 2]])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, y array<double>").repartition(3)
    heads, weights, l2, share = np.array([0, 1, 2, 1]), np.array([1.5, 1, 1, 1]), np.array([0.1, 0.0, 0.2, 1.0]), np.array([1, 0.5, 0.5, 0.5])
    w = solver.fit(df, 3, ["logistic", "huber", "mse"], heads, weights, l2, share, 0.3, 200)
    one = np.hstack([x, np.ones((90, 1))])

    def value(j, v):
        z, t = one @ v, y[:, heads[j]]
        r = np.abs(z - t)
        loss = [np.logaddexp(0, z) - t * z, np.where(r <= 0.3, r * r / 2, 0.3 * (r - 0.15)), r * r][heads[j]]
        return share[j] * weights[j] * loss.mean() + 0.5 * l2[j] * (v * v).sum()

    for j in range(4):
        for k in range(4):
            e = np.eye(4)[k] * 1e-5
            assert abs(value(j, w[j] + e) - value(j, w[j] - e)) / 2e-5 < 1e-5


def test_a_grid_takes_few_passes(spark, monkeypatch):
    """Eight penalties of five heads: what one head needs, not a pass for each trial of each."""
    from framewise.operators import heads as solver

    passes = []
    plain = solver.summed
    monkeypatch.setattr(solver, "summed", lambda df, size, part: passes.append(size) or plain(df, size, part))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    y = np.column_stack([(x[:, k] + rng.normal(size=200) > 0.5).astype(float) for k in range(3)] + [x[:, 3], np.abs(x[:, 4])])
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "features array<double>, y array<double>").repartition(3)
    heads = np.tile(np.arange(5), len(probe.L2_GRID))
    l2 = np.repeat(np.array(probe.L2_GRID), 5)
    w = solver.fit(df, 6, ["logistic"] * 3 + ["huber"] * 2, heads, np.ones(40), l2, np.ones(40), 1.0, 200)
    assert len(passes) <= 15 and passes[-1] < passes[0]
    monkeypatch.setattr(solver, "HESSIAN_VALUES", 0)
    assert np.allclose(solver.fit(df, 6, ["logistic"] * 3 + ["huber"] * 2, heads, np.ones(40), l2, np.ones(40), 1.0, 200), w, atol=1e-4)


def test_moments_far_from_zero(spark):
    from framewise.operators.heads import moments

    x = np.random.default_rng(0).normal(size=(500, 2)) + 1e6
    n, mean, deviation = moments(spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(4), 2)
    assert n == 500 and np.allclose(mean, x.mean(0), rtol=1e-12) and np.allclose(deviation, x.std(0), rtol=1e-6)


def test_top_directions_without_the_whole_matrix(spark):
    from framewise.operators.heads import top_directions

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 40)) * (0.7 ** np.arange(40)) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(3)
    got = top_directions(df, 40, 3, x.mean(0), 300)
    want = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :3]
    assert np.allclose(np.abs(np.sum(got * want, axis=0)), 1, atol=1e-8)


def test_winner_is_measured_on_eval(spark):
    rows = probe.regularised(synthetic(spark), (1e-4, 10.0), QUICK).collect()
    assert {r["selected_l2"] for r in rows} == {1e-4} and "eval_classification_loss" in {r["metric"] for r in rows}
