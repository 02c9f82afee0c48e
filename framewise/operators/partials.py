"""Metrics summed where they are measured.

One Arrow pass reads the wide rows, each tensor once, and gives back one short row of counts, sums and squared deviations for
each task and group. Frames are neither copied for each metric nor sent back to the JVM; the partial rows merge in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.functions.metrics import depth_rows, error_rows, shaped, ssim_scores
from framewise.functions.tensors import MAX_RANGE_METERS

ERRORS = ("mse", "mae", "rmse", "psnr_db")
DEPTHS = ("mae_m", "rmse_m", "d125", "d125_sq", "valid_fraction")
POINT_METRICS = ("mse", "psnr_db", "ssim", "f32_mse", "f32_psnr_db", "f32_ssim", "depth_mae_m")
SUMMARY_METRICS = tuple(f"rgb_{m}" for m in (*ERRORS, "ssim")) + tuple(f"range_{m}" for m in (*ERRORS, "ssim")) + tuple(f"depth_{m}" for m in DEPTHS)
#: Groups a task keeps before it gives their sums away; a group may have several partial rows.
KEPT_GROUPS = 10_000


class _Sums:
    """For each key: rows, bytes, and for each metric how many, their sum and the squares about their mean."""

    def __init__(self, keys: tuple[str, ...], metrics: tuple[str, ...]):
        self.keys, self.metrics = keys, metrics
        self.groups: dict[tuple, list] = {}

    def add(self, key: tuple, values: np.ndarray, size: int = 0) -> None:
        """``values`` has a row for each sample and a column for each metric; NaN is left out."""
        there = ~np.isnan(values)
        n = there.sum(axis=0)
        with np.errstate(invalid="ignore"):
            total = np.where(there, values, 0.0).sum(axis=0)
            mean = total / np.maximum(n, 1)
            square = np.where(there & np.isfinite(values), values - np.where(np.isfinite(mean), mean, 0.0), 0.0) ** 2
        state = self.groups.setdefault(key, [0, 0, *(np.zeros(len(self.metrics)) for _ in range(3))])
        spread, before = square.sum(axis=0), state[2]
        with np.errstate(invalid="ignore", divide="ignore"):
            apart = mean - state[3] / before
            spread = spread + np.where((before > 0) & (n > 0) & np.isfinite(apart), apart, 0.0) ** 2 * before * n / np.maximum(before + n, 1)
        self.groups[key] = [state[0] + len(values), state[1] + size, before + n, state[3] + total, state[4] + spread]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.groups:
            columns = [pa.array([k[i] for k in self.groups], pa.string()) for i in range(len(self.keys))]
            states = list(self.groups.values())
            columns += [pa.array([s[i] for s in states], pa.int64()) for i in range(2)]
            columns += [pa.array([float(s[2 + j][i]) for s in states]) for i in range(len(self.metrics)) for j in range(3)]
            yield pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in self.schema().split(", ")])
            self.groups.clear()

    def schema(self) -> str:
        parts = [f"{m}__{p} double" for m in self.metrics for p in ("n", "sum", "sq")]
        return ", ".join([*(f"{k} string" for k in self.keys), "samples long", "bytes long", *parts])


def _merged(partials: DataFrame, keys: list[str], metrics: tuple[str, ...], spread: tuple[str, ...] = (), rollup: bool = False) -> DataFrame:
    """Rows and bytes, each metric's mean, and its population deviation as ``<metric>__std`` for those in ``spread``."""
    grouped = partials.rollup(*keys) if rollup else partials.groupBy(*keys)
    sums = [F.sum(f"{m}__{p}").alias(f"{m}__{p}") for m in metrics for p in ("n", "sum", "sq")]
    between = [F.sum(F.try_divide(F.col(f"{m}__sum") * F.col(f"{m}__sum"), F.col(f"{m}__n"))).alias(f"{m}__between") for m in spread]
    out = grouped.agg(F.sum("samples").alias("samples"), F.sum("bytes").alias("bytes"), *sums, *between)
    n, total = (lambda m: F.col(f"{m}__n")), (lambda m: F.col(f"{m}__sum"))
    squares = {m: F.col(f"{m}__sq") + F.greatest(F.col(f"{m}__between") - F.try_divide(total(m) * total(m), n(m)), F.lit(0.0)) for m in spread}
    return out.select(
        *keys, "samples", "bytes", *[F.try_divide(total(m), n(m)).alias(m) for m in metrics], *[n(m).cast("long").alias(f"{m}__n") for m in metrics],
        *[F.sqrt(F.try_divide(squares[m], n(m))).alias(f"{m}__std") for m in spread],
    )


def _summed(df: DataFrame, sums: Callable[[], _Sums], measure: Callable[[pa.RecordBatch, _Sums], None]) -> DataFrame:
    """The partial rows of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = sums()
        for batch in batches:
            measure(batch, state)
            if len(state.groups) > KEPT_GROUPS:
                yield from state.flush()
        yield from state.flush()

    return df.mapInArrow(run, sums().schema())


def as_u8(values: np.ndarray) -> np.ndarray:
    """Values as an 8-bit file gives them back: clamped, rounded half up to 255 steps."""
    out = np.maximum(np.fmin(values, 1.0), 0.0)  # NaN counts as 1
    out *= 255.0
    out += 0.5
    np.floor(out, out=out)
    out /= 255.0
    return out


def point_means(
    df: DataFrame, rgb_hw: tuple[int, int], range_hw: tuple[int, int], range_channels: int, raw: Column, quant: Column, places: dict[str, np.ndarray] | None = None,
) -> DataFrame:
    """Per point and modality: samples, bytes and the means of ``POINT_METRICS``.

    In: ``rgb, range`` and ``rgb_raw, range_raw, rgb_quant, range_quant``; ``raw`` and ``quant`` are a row's sizes in bytes.
    ``places`` as for ``split_means``.
    """
    places = places or {}
    pixels = range_hw[0] * range_hw[1]
    head = min(range_channels, 2) * pixels
    similar = ssim_scores(*rgb_hw)
    points = {"raw": "raw_f32", "quant": "quantized"}

    def two_planes(v: np.ndarray) -> np.ndarray:
        return np.pad(v[:, : 2 * pixels], ((0, 0), (0, max(0, 2 * pixels - v.shape[1]))))

    def measure(batch: pa.RecordBatch, sums: _Sums) -> None:
        sizes = {k: int(np.sum(batch.column(f"{k}_bytes").fill_null(0).to_numpy(zero_copy_only=False))) for k in points}
        for tail, point in points.items():
            for modality in ("rgb", "range"):
                out = np.full((batch.num_rows, len(POINT_METRICS)), np.nan)
                for rows, (p, t) in shaped(batch.column(f"{modality}_{tail}"), batch.column(modality), places=places.get(modality)):
                    if modality == "rgb":
                        p8, t8 = as_u8(p), as_u8(t)
                        out[rows, 2], out[rows, 5] = similar(p8, t8), similar(p, t)
                    else:
                        p8, t8 = as_u8(two_planes(p)), as_u8(two_planes(t))
                        out[rows, 6] = depth_rows(p[:, :head], t[:, :head], pixels)[:, 0]
                        p, t = p[:, :head], t[:, :head]
                    out[rows, 0], out[rows, 1] = error_rows(p8, t8)[:, [0, 3]].T
                    out[rows, 3], out[rows, 4] = error_rows(p, t)[:, [0, 3]].T
                sums.add((point, modality), out, sizes[tail])

    wide = df.select("rgb", "range", *[f"{m}_{k}" for k in points for m in ("rgb", "range")], raw.alias("raw_bytes"), quant.alias("quant_bytes"))
    keys = ("point", "modality")
    return _merged(_summed(wide, lambda: _Sums(keys, POINT_METRICS), measure), [*keys], POINT_METRICS)


def split_means(
    pairs: DataFrame, rgb_hw: tuple[int, int] | None, range_hw: tuple[int, int] | None, *, by: str = "split", with_all: bool = False,
    validity_channel: int | None = None, max_range_m: float = MAX_RANGE_METERS, range_channels: int = 1, finite: bool = False,
    places: dict[str, np.ndarray] | None = None,
) -> DataFrame:
    """What ``evaluate.summarize`` gives for the per-sample metrics of ``pairs``, without making those rows.

    ``finite`` leaves the PSNR of perfect predictions out of its mean. Where ``rgb`` or ``range`` has ``places``, its columns hold
    short vectors, and the task lays out the frames: pixel k is value ``places[k]``. So frames are not sent to it.
    """
    places = places or {}
    similar = ssim_scores(*rgb_hw) if rgb_hw else None
    pixels = range_hw[0] * range_hw[1] if range_hw else 0

    def measure(batch: pa.RecordBatch, sums: _Sums) -> None:
        out = np.full((batch.num_rows, len(SUMMARY_METRICS)), np.nan)
        if similar is not None:
            for rows, (p, t) in shaped(batch.column("rgb_hat"), batch.column("rgb"), places=places.get("rgb")):
                out[rows, :4], out[rows, 4] = error_rows(p, t), similar(p, t)
        if pixels:
            for rows, (p, t) in shaped(batch.column("range_hat"), batch.column("range"), places=places.get("range")):
                out[rows, 5:9] = error_rows(p[:, : pixels * range_channels], t[:, : pixels * range_channels])
                out[rows, 10:15] = depth_rows(p, t, pixels, validity_channel, max_range_m)
        if finite:
            out[np.isinf(out)] = np.nan
        groups: dict[str | None, list[int]] = {}
        for i, k in enumerate(batch.column("by").to_pylist()):
            groups.setdefault(k, []).append(i)
        for k, rows in groups.items():
            sums.add((k,), out[rows])

    columns = [c for c, used in (("rgb_hat", rgb_hw), ("rgb", rgb_hw), ("range_hat", range_hw), ("range", range_hw)) if used]
    wide = pairs.select(F.col(by).cast("string").alias("by"), *columns)
    partials = _summed(wide, lambda: _Sums((by,), SUMMARY_METRICS), measure)
    means = _merged(partials, [by], SUMMARY_METRICS, ("rgb_mse", "range_mse"), rollup=with_all)

    def errors(m: str) -> Column:
        parts = [F.col(f"{m}_{k}").alias(f"mean_{k}") for k in (*ERRORS, "ssim")] + [F.col(f"{m}_mse__std").alias("std_mse")]
        return F.when(F.col(f"{m}_mse__n") > 0, F.struct(*parts)).alias(m)

    depth = F.when(F.col("depth_valid_fraction__n") > 0, F.struct(*[F.col(f"depth_{k}").alias(f"mean_{k}") for k in DEPTHS])).alias("depth")
    out = means.select(by, F.col("samples").alias("n_samples"), errors("rgb"), errors("range"), depth)
    return out.withColumn(by, F.coalesce(by, F.lit("all"))) if with_all else out
