"""Fused metric sums and shape-cached resampling against row-by-row results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import resample, tensors
from framewise.operators import evaluate, partials, ratedist


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(spark, n=90, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rgb, rng = r.random(3 * 9 * 10), r.random(2 * 4 * 5) * (r.random(40) > 0.2)
        hat = None if i % 7 == 0 else (rgb if i % 11 == 0 else rgb + r.normal(0, 0.1, rgb.size)).tolist()
        range_hat = None if i % 5 == 0 else (rng + r.normal(0, 0.1, rng.size)).tolist()
        rows.append((f"s{i}", [None, "train", "val", "test"][i % 4], rgb.tolist(), (rng if i % 9 else rng * 0).tolist(), hat, range_hat))
    return spark.createDataFrame(rows, "sample_id string, split string, rgb array<double>, range array<double>, rgb_hat array<double>, range_hat array<double>").repartition(6)


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if hasattr(a, "asDict"):
        return all(close(a[k], b[k]) for k in a.asDict())
    return a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


@pytest.mark.parametrize("with_all, channel", [(False, None), (True, None), (False, 1)])
def test_split_means_are_the_means_of_the_rows(spark, with_all, channel):
    df = pairs(spark)
    want = {r["split"]: r for r in evaluate.summarize(evaluate.sample_metrics(df, (9, 10), (4, 5), channel), with_all=with_all).collect()}
    got = {r["split"]: r for r in partials.split_means(df, (9, 10), (4, 5), with_all=with_all, validity_channel=channel).collect()}
    assert got.keys() == want.keys()
    for k, row in got.items():
        assert close(row, want[k]), (k, row, want[k])


def test_absent_modality_and_empty_table(spark):
    df = pairs(spark).withColumn("rgb_hat", F.lit(None).cast("array<double>"))
    assert all(r["rgb"] is None and r["range"] is not None for r in partials.split_means(df, (9, 10), (4, 5)).collect())
    assert all(r["rgb"] is None for r in partials.split_means(df, None, (4, 5)).collect())
    assert partials.split_means(df.where("false"), (9, 10), (4, 5)).collect() == []


def test_partial_rows_are_few(spark):
    df = pairs(spark, 200)
    rows = partials.split_means(df, (9, 10), (4, 5))
    text = plan(rows)
    assert text.count("MapInArrow") == 1 and "Generate" not in text and "ArrowEvalPython" not in text


def test_spread_of_merged_groups(spark):
    sums = [partials._Sums(("k",), ("mse",)) for _ in range(3)]
    values = np.random.default_rng(3).random(1000) * 1e-3 + 5
    for s, part in zip(sums, np.array_split(values, 3)):
        for piece in np.array_split(part, 7):
            s.add(("a",), piece[:, None])
    batches = [b for s in sums for b in s.flush()]
    df = spark.createDataFrame([r for b in batches for r in b.to_pylist()], partials._Sums(("k",), ("mse",)).schema())
    row = partials._merged(df, ["k"], ("mse",), ("mse",)).first()
    assert row["samples"] == 1000 and math.isclose(row["mse"], values.mean()) and math.isclose(row["mse__std"], values.std(), rel_tol=1e-4)


def operating_frame(spark, channels):
    r = np.random.default_rng(channels)
    n = channels * 20
    rows = []
    for i in range(40):
        rgb, rng, e = r.random(48), r.random(n), r.normal(size=16)
        rows.append((e.tolist(), rgb.tolist(), rng.tolist(), *((rgb + r.normal(0, 0.2, 48)).tolist() for _ in range(2)), *((rng + r.normal(0, 0.2, n)).tolist() for _ in range(2))))
    names = ("embedding", "rgb", "range", "rgb_raw", "rgb_quant", "range_raw", "range_quant")
    return spark.createDataFrame(rows, ", ".join(f"{c} array<double>" for c in names)).repartition(4)


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_operating_points_against_packed_bytes(spark, channels):
    df = operating_frame(spark, channels)
    out = {(r["point"], r["modality"]): r for r in ratedist.operating_points(df, (4, 4), (4, 5), channels).collect()}
    assert len(out) == 6
    for tail, point in (("raw", "raw_f32"), ("quant", "quantized")):
        back = lambda c: tensors.unpack_u8(tensors.pack_range_u8(c, 20), 2)
        p, t = (back(F.col(c)) for c in (f"range_{tail}", "range"))
        want = df.select(F.avg(F.aggregate(F.zip_with(p, t, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x) / 40).alias("m")).first()["m"]
        assert math.isclose(out[point, "range"]["mse"], want, rel_tol=1e-9)
        both = out[point, "combined"]
        assert math.isclose(both["mse"], (out[point, "rgb"]["mse"] + out[point, "range"]["mse"]) / 2)
        assert both["latent_bytes"] == 40 * (64 if tail == "raw" else 38)
    means = partials.point_means(df, (4, 4), (4, 5), channels, F.lit(1), F.lit(1))
    text = plan(means)
    assert text.count("MapInArrow") == 1 and "Generate" not in text and "Inline" not in text


def test_vector_that_cannot_be_quantised_raises(spark):
    df = operating_frame(spark, 2).withColumn("embedding", F.array(F.lit(float("nan"))))
    with pytest.raises(Exception, match="non-empty and finite"):
        ratedist.operating_points(df, (4, 4), (4, 5)).collect()


def reference(v, hs, ws, c, h, w, ch):
    """Pixel by pixel."""
    def at(y, x):
        k = (y * ws + x) * c + ch
        return 0.0 if v is None or k >= len(v) or v[k] is None or ch >= c else v[k]

    out = []
    for r in range(h):
        sy = (r + 0.5) * (hs / h) - 0.5
        y0 = min(max(math.floor(sy), 0), hs - 1)
        y1, ty = min(y0 + 1, hs - 1), min(max(sy - y0, 0.0), 1.0)
        for q in range(w):
            sx = (q + 0.5) * (ws / w) - 0.5
            x0 = min(max(math.floor(sx), 0), ws - 1)
            x1, tx = min(x0 + 1, ws - 1), min(max(sx - x0, 0.0), 1.0)
            top = at(y0, x0) + tx * (at(y0, x1) - at(y0, x0))
            low = at(y1, x0) + tx * (at(y1, x1) - at(y1, x0))
            out.append(top + ty * (low - top))
    return out


def images(spark):
    r = np.random.default_rng(8)
    rows = [(i, (r.random(h * w * c) * 90 - 5).tolist(), h, w, c) for i, (h, w, c) in enumerate([(4, 6, 2), (1, 1, 2), (4, 6, 2), (3, 2, 4), (9, 5, 3)] * 4)]
    rows += [(20, [1.0, None, 3.0], 2, 2, 2), (21, [5.0] * 30, 2, 2, 2), (22, None, 2, 2, 2), (23, [1.0, 2.0], None, None, None), (24, [], 1, 1, 2)]
    return rows, spark.createDataFrame(rows, "id int, v array<double>, h int, w int, c int").repartition(3)


@pytest.mark.parametrize("h, w, channel", [(3, 4, 0), (8, 11, 1), (1, 1, 0)])
def test_resampling_of_mixed_shapes(spark, h, w, channel):
    rows, df = images(spark)
    size = [F.col(c) for c in "hwc"]
    got = {r["id"]: r["o"] for r in df.select("id", tensors.bilinear(F.col("v"), *size, h, w, channel).alias("o")).collect()}
    for i, v, hs, ws, c in rows:
        want = [0.0] * (h * w) if hs is None else reference(v, hs, ws, c, h, w, channel)
        assert got[i] == want, i


def test_stack_is_its_planes(spark):
    rows, df = images(spark)
    size = [F.col(c) for c in "hwc"]
    v = F.col("v")
    parts = F.flatten(F.array(
        tensors.max_norm(tensors.bilinear(v, *size, 5, 7, 1)), tensors.validity(v, *size, 5, 7), tensors.clamp_scale(tensors.bilinear(v, *size, 5, 7, 0), 75.0)
    ))
    stack = tensors.range_chw(v, *size, 5, 7, ["intensity", "mask", "range"], 75.0)
    for r in df.select("id", stack.alias("a"), parts.alias("b")).collect():
        assert r["a"] == r["b"], r["id"]


def test_taps_are_made_once_per_shape(spark):
    resample.linear_taps.cache_clear()
    frames = np.random.default_rng(0).random((50, 6, 7))
    resample.blended(frames, 3, 4)
    resample.blended(frames, 3, 4)
    assert resample.linear_taps.cache_info().misses == 2 and resample.linear_taps.cache_info().hits == 2
    _, df = images(spark)
    text = plan(df.select(tensors.validity(F.col("v"), *[F.col(c) for c in "hwc"], 4, 4).alias("m")))
    assert "transform" not in text.lower() and text.count("ArrowEvalPython") == 1
