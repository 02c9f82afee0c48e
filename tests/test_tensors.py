"""Array columns against numpy and against small worked cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import int8, tensors
from framewise.functions.hashing import seed_state, split_hash
from framewise.functions.metrics import depth_metrics, error_metrics, ssim, window_starts


def one(spark, **arrays):
    cols = ", ".join(f"{k} array<double>" for k in arrays)
    return spark.createDataFrame([tuple([float(x) for x in v] for v in arrays.values())], cols)


def value(df, col):
    return df.select(col.alias("v")).first()["v"]


def np_bilinear(v, hs, ws, c, h, w, ch):
    img = np.asarray(v, dtype=float).reshape(hs, ws, c)[:, :, ch]
    out = np.zeros((h, w))
    for r in range(h):
        sy = (r + 0.5) * hs / h - 0.5
        y0 = min(max(int(np.floor(sy)), 0), hs - 1)
        y1, ty = min(y0 + 1, hs - 1), min(max(sy - y0, 0), 1)
        for q in range(w):
            sx = (q + 0.5) * ws / w - 0.5
            x0 = min(max(int(np.floor(sx)), 0), ws - 1)
            x1, tx = min(x0 + 1, ws - 1), min(max(sx - x0, 0), 1)
            out[r, q] = (img[y0, x0] * (1 - tx) + img[y0, x1] * tx) * (1 - ty) + (img[y1, x0] * (1 - tx) + img[y1, x1] * tx) * ty
    return out.ravel()


@pytest.mark.parametrize("h,w", [(3, 5), (9, 14), (6, 7), (1, 1)])
def test_bilinear(spark, h, w):
    v = np.random.default_rng(h).random(6 * 7 * 3) * 50
    got = value(one(spark, v=v), tensors.bilinear(F.col("v"), 6, 7, 3, h, w, 1))
    assert np.allclose(got, np_bilinear(v, 6, 7, 3, h, w, 1))


def test_missing_raw_values_count_as_zero(spark):
    got = value(one(spark, v=[4, 4]), tensors.bilinear(F.col("v"), 1, 2, 2, 1, 2, 0))
    assert got == [4.0, 0.0]


def test_bad_shapes_raise(spark):
    with pytest.raises(Exception, match="invalid range image shape"):
        value(one(spark, v=[1, 2]), tensors.bilinear(F.col("v"), 1, 2, 1, 1, 2, 0))
    with pytest.raises(ValueError):
        tensors.channel_list(["colour"])
    with pytest.raises(ValueError):
        tensors.channel_list([])


def test_validity_golden(spark):
    df = one(spark, v=[0, 0, 10, 1])
    mask = tensors.validity(F.col("v"), 1, 2, 2, 1, 4)
    assert value(df, mask) == [0.0, 0.0, 1.0, 1.0]
    s = value(df, tensors.validity_stats(mask))
    assert (s["valid_pixels"], s["total_pixels"], s["valid_fraction"]) == (2, 4, 0.5)


def test_range_stack_golden(spark):
    v = [75.0, 1, 0, 2, 37.5, 3, 0, 4]
    got = value(one(spark, v=v), tensors.range_chw(F.col("v"), 2, 2, 2, 2, 2, ["range", "validity"]))
    assert got == [1.0, 0.0, 0.5, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert tensors.channel_index(["range", "valid"], "mask") == 1
    assert tensors.channel_index(["range"], "mask") is None


def test_pack_and_unpack(spark):
    df = one(spark, v=[0.1, 0.5, 1.2, -1, 0.25, 0.999])
    rounded, cut = value(df, tensors.pack_rgb_u8(F.col("v"))), value(df, tensors.pack_rgb_u8(F.col("v"), "truncate"))
    assert rounded == [26, 255, 64, 128, 0, 255] and cut == [25, 255, 63, 127, 0, 254]
    packed = tensors.pack_range_u8(F.col("v"), 3)
    assert value(df, packed) == [26, 0, 0, 128, 64, 0, 255, 255, 0]
    assert np.allclose(value(df, tensors.unpack_u8(packed, 2)), np.array([26, 128, 255, 0, 64, 255]) / 255)
    single = one(spark, v=[0.0, 1.0])
    assert value(single, tensors.pack_range_u8(F.col("v"), 2)) == [0, 0, 0, 255, 0, 0]
    assert np.allclose(value(one(spark, v=[255, 0, 51]), tensors.rgb_chw(F.col("v"))), [1, 0, 0.2])


def test_max_norm(spark):
    assert value(one(spark, v=[1, 2, 4]), tensors.max_norm(F.col("v"))) == [0.25, 0.5, 1.0]
    assert value(one(spark, v=[0, -2]), tensors.max_norm(F.col("v"))) == [0.0, -2.0]


def test_error_metrics_golden(spark):
    same = value(one(spark, p=[0.25, 0.5], t=[0.25, 0.5]), error_metrics(F.col("p"), F.col("t")))
    assert (same["mse"], same["mae"], same["rmse"], same["psnr_db"]) == (0, 0, 0, float("inf"))
    far = value(one(spark, p=[0, 0], t=[1, 1]), error_metrics(F.col("p"), F.col("t")))
    assert (far["mse"], far["psnr_db"]) == (1, 0)
    half = value(one(spark, p=[2, 2, 0, 0], t=[0, 0, 0, 0]), error_metrics(F.col("p"), F.col("t")))
    assert (half["mae"], half["mse"]) == (1, 2)
    with pytest.raises(Exception, match="equal length"):
        value(one(spark, p=[1], t=[1, 2]), error_metrics(F.col("p"), F.col("t")))


def test_depth_metrics_golden(spark):
    df = one(spark, p=[0.1, 0.5, 0.6, 0.2, 0, 0, 0, 0], t=[0.2, 0.4, 0.6, 0.8, 1, 0, 1, 0])
    m = value(df, depth_metrics(F.col("p"), F.col("t"), 4, 1))
    assert np.allclose([m["valid_fraction"], m["mae_m"], m["rmse_m"], m["d125"], m["d125_sq"]], [0.5, 3.75, 5.303301, 0.5, 0.5], atol=1e-5)
    m = value(one(spark, p=[0, 0.1, 0.5], t=[0, 0.2, 0.4]), depth_metrics(F.col("p"), F.col("t"), 3))
    assert np.allclose([m["valid_fraction"], m["mae_m"], m["rmse_m"], m["d125"], m["d125_sq"]], [2 / 3, 7.5, 7.5, 0.0, 0.5])
    m = value(one(spark, p=[1, 1], t=[0, 0]), depth_metrics(F.col("p"), F.col("t"), 2))
    assert m["valid_fraction"] == 0 and m["mae_m"] is None and m["d125"] is None


def np_ssim(p, t, h, w):
    k = np.array([0.299, 0.587, 0.114])
    x, y = (np.tensordot(k, np.asarray(v).reshape(3, h, w), 1) for v in (p, t))
    if h <= 8 and w <= 8:
        wins = [(x, y)]
    else:
        s = min(8, h, w)
        wins = [(x[r : r + s, c : c + s], y[r : r + s, c : c + s]) for r in window_starts(h, s) for c in window_starts(w, s)]
    out = []
    for a, b in wins:
        ma, mb, cov = a.mean(), b.mean(), ((a - a.mean()) * (b - b.mean())).mean()
        out.append((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (a.var() + b.var() + 9e-4)))
    return np.mean(out)


@pytest.mark.parametrize("h,w", [(8, 8), (4, 6), (13, 22), (9, 3), (16, 16)])
def test_ssim(spark, h, w):
    rng = np.random.default_rng(h * w)
    p, t = rng.random(3 * h * w), rng.random(3 * h * w)
    got = value(one(spark, p=p, t=t), ssim(F.col("p"), F.col("t"), h, w))
    assert abs(got - np_ssim(p, t, h, w)) < 1e-9
    assert abs(value(one(spark, p=p, t=p), ssim(F.col("p"), F.col("t"), h, w)) - 1) < 1e-9


def test_ssim_contrast_and_starts(spark):
    n = 3 * 64
    assert value(one(spark, p=[0] * n, t=[1] * n), ssim(F.col("p"), F.col("t"), 8, 8)) < 0.2
    assert window_starts(8, 8) == [0] and window_starts(13, 8) == [0, 4, 5] and window_starts(16, 8) == [0, 4, 8]


def test_int8_golden(spark):
    const = one(spark, v=[3.25] * 64)
    meta = int8.int8_meta(F.col("v"))
    m = value(const, meta)
    assert (m["scale"], m["zero_point"], m["min_value"], m["max_value"]) == (1.0, 0, 3.25, 3.25)
    codes = int8.quantize(F.col("v"), meta)
    assert value(const, codes) == [0] * 64 and value(const, int8.dequantize(codes, meta)) == [3.25] * 64
    m = value(one(spark, v=[-1, 0.25, 2.5]), int8.int8_meta(F.col("v"), "symmetric"))
    assert (m["zero_point"], m["min_value"], m["max_value"]) == (0, -2.5, 2.5)
    fixed = F.struct(
        F.lit(1 / 127).cast("float").alias("scale"), F.lit(0).cast("tinyint").alias("zero_point"),
        F.lit(-1.0).cast("float").alias("min_value"), F.lit(1.0).cast("float").alias("max_value"),
    )
    assert value(one(spark, v=[-4, -1, 0, 1, 4]), int8.quantize(F.col("v"), fixed)) == [-127, -127, 0, 127, 127]
    with pytest.raises(Exception, match="finite"):
        value(one(spark, v=[1, float("inf")]), int8.int8_meta(F.col("v")))
    with pytest.raises(ValueError):
        int8.int8_meta(F.col("v"), "other")


def test_int8_round_trip_error_is_bounded(spark):
    v = np.random.default_rng(3).normal(size=200)
    for policy in int8.POLICIES:
        meta = int8.int8_meta(F.col("v"), policy)
        back = value(one(spark, v=v), int8.dequantize(int8.quantize(F.col("v"), meta), meta))
        step = value(one(spark, v=v), meta)["scale"]
        assert np.abs(np.array(back) - v).max() <= step * 0.51 + 1e-6


def np_hash(seed, text):
    h = seed_state(seed)
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def test_split_hash_golden(spark):
    ids = ["sample-001", "sample-002", "über", "a"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    for seed in (42, 99, 2**63):
        got = {r["id"]: (r["h"]["hi"] << 32) | r["h"]["lo"] for r in df.select("id", split_hash(F.col("id"), seed).alias("h")).collect()}
        assert got == {i: np_hash(seed, i) for i in ids}
    assert np_hash(42, "sample-001") == 0xFCA6579FC925C913
    assert np_hash(42, "sample-002") == 0xFCA6589FC925CAC6
    assert np_hash(99, "sample-001") == 0x4DD73199ADD6DFA6
