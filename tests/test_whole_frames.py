"""Frames laid out in the tasks."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from framewise.functions import tensors
from framewise.functions.metrics import shaped, ssim_scores
from framewise.operators import partials
from framewise.plans import evaluation, full_frames, views


def test_places_give_the_frames(spark):
    rng = np.random.default_rng(1)
    hw = (8, 64)
    at = {"rgb": full_frames.places(3, *hw), "range": full_frames.places(2, *hw)}
    rows = [(s, *[rng.random(64).tolist() if rng.random() < 0.8 else None for _ in range(4)]) for s in ("train", "val") * 20]
    names = ("rgb_hat", "rgb", "range_hat", "range")
    spell = ", ".join(["split string", *(f"{c} array<double>" for c in names)])
    wide = [(r[0], *[None if v is None else np.array(v)[at[n.split("_")[0]]].tolist() for n, v in zip(names, r[1:])]) for r in rows]
    short, whole = (
        partials.split_means(spark.createDataFrame(x, spell), hw, hw, with_all=True, **more).orderBy("split").collect()
        for x, more in ((rows, {"places": at}), (wide, {}))
    )
    assert short == whole and len(short) == 3


def test_place_of_a_pixel():
    frame = full_frames.places(3, 128, 256).reshape(3, 128, 256)
    for p, r, c in ((0, 0, 0), (1, 5, 9), (2, 127, 255)):
        assert frame[p, r, c] == (11 * p + 5 * r + 7 * c) % 64


def test_frame_queries_send_vectors_to_their_tasks(spark, sf_dir):
    """A plan that builds whole frames before the Arrow pass has a sequence over their rows."""
    for name in ("frame_split_summary",):
        plan = full_frames.reg.queries[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "array_repeat" not in plan and "flatten" not in plan


def test_similarity_from_blocks_is_that_of_every_window():
    rng = np.random.default_rng(2)
    for h, w in ((12, 16), (8, 8), (8, 20), (10, 13)):
        x, y = rng.random((3, 3 * h * w)), rng.random((3, 3 * h * w))
        luma = [np.einsum("npij,p->nij", v.reshape(3, 3, h, w), (0.299, 0.587, 0.114)) for v in (x, y)]
        starts = [sorted({*range(0, n - 8, 4), n - 8}) for n in (h, w)]
        want = np.zeros(3)
        for r in starts[0]:
            for c in starts[1]:
                a, b = (v[:, r : r + 8, c : c + 8].reshape(3, -1) for v in luma)
                mx, my = a.mean(axis=1), b.mean(axis=1)
                top = (2 * mx * my + 1e-4) * (2 * ((a * b).mean(axis=1) - mx * my) + 9e-4)
                want += top / ((mx * mx + my * my + 1e-4) * (a.var(axis=1) + b.var(axis=1) + 9e-4))
        np.testing.assert_allclose(ssim_scores(h, w)(x, y), want / (len(starts[0]) * len(starts[1])), rtol=1e-9)


def test_similarity_of_a_full_batch_works_on_small_parts():
    """All frames of a batch at once take 92 MB for both columns, before any of the sums."""
    n, size = 10_000, 64
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.random.default_rng(3).random(n * size)))
    scores, done = ssim_scores(views.TILE_H, views.TILE_W), 0
    tracemalloc.start()
    for rows, (x, y) in shaped(vectors, vectors, places=views.TILE):
        np.testing.assert_allclose(scores(x, y), 1)
        done += len(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == n and peak < 24 << 20


def test_windows_are_tiled_in_the_task(spark, sf_dir):
    """What enters the Arrow pass has the vector's 64 values, not the frame's 576."""
    plan = evaluation.ssim_windows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 64)" not in plan and "similarity(" in plan


def test_both_planes_are_those_of_each_function(spark):
    df = spark.createDataFrame([(i, [float((i * k) % 7 - 2) for k in range(24)]) for i in range(200)], "i int, v array<double>")
    dims = (F.lit(3), F.lit(4), F.lit(2))
    each = df.select("i", F.concat(tensors.bilinear(F.col("v"), *dims, 6, 5, 1), tensors.validity(F.col("v"), *dims, 6, 5)).alias("p"))
    both = df.select("i", tensors.bilinear_and_validity(F.col("v"), *dims, 6, 5, 1).alias("p"))
    assert each.orderBy("i").collect() == both.orderBy("i").collect()
