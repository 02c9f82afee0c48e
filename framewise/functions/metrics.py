"""Reconstruction metrics of one sample, as struct columns over array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise.functions.arrays import doubles
from framewise.functions.tensors import MAX_RANGE_METERS

# Fixed values of the similarity metric.
SSIM_WINDOW, SSIM_STEP = 8, 4
SSIM_C1, SSIM_C2 = 1e-4, 9e-4
LUMA_WEIGHTS = (0.299, 0.587, 0.114)
DELTA = 1.25
#: Values of one column that are worked on together; bounds memory.
CHUNK_VALUES = 1 << 19


def shaped(*columns: pa.Array, places: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows where every column is there, by shape: their numbers, and one matrix per column.

    Rows of one length are handled together, so a table of frames is one matrix a batch. NaN ranks above all numbers.
    With ``places``, a row stands for the frame that holds its value of that number at each pixel.
    """
    there = np.ones(len(columns[0]), bool)
    for c in columns:
        there &= np.asarray(c.is_valid())
    lengths = np.stack([np.asarray(c.value_lengths().fill_null(0)) for c in columns], axis=1)
    for shape in np.unique(lengths[there], axis=0) if there.any() else []:
        if (shape != shape[0]).any() or shape[0] < 1:
            raise ValueError("tensors must be non-empty and of equal length")
        rows = np.flatnonzero(there & (lengths == shape).all(axis=1))
        if places is not None and int(places.max()) >= shape[0]:
            raise ValueError("a frame has pixels beyond its vector")
        size = int(shape[0]) if places is None else len(places)
        for part in np.array_split(rows, -(-len(rows) * size // CHUNK_VALUES)):
            at = pa.array(part)
            made = [c.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(part), -1) for c in columns]
            yield part, made if places is None else [m.take(places, axis=1) for m in made]


def _structs(out: np.ndarray, names: tuple[str, ...]) -> pa.Array:
    """A row of ``out`` as a struct; NaN stands for null, and a row without any value is null."""
    missing = np.isnan(out)
    fields = [pa.array(out[:, k], mask=missing[:, k]) for k in range(len(names))]
    return pa.StructArray.from_arrays(fields, list(names), mask=pa.array(missing.all(axis=1)))


def error_rows(x: np.ndarray, y: np.ndarray, max_val: float = 1.0) -> np.ndarray:
    """mse, mae, rmse and psnr of each row of two matrices."""
    d = x - y
    mse = np.einsum("ij,ij->i", d, d) / d.shape[1]
    with np.errstate(divide="ignore"):
        psnr = 10.0 * np.log10(float(max_val) ** 2 / mse)
    return np.stack([mse, np.abs(d).mean(axis=1), np.sqrt(mse), psnr], axis=1)


def depth_rows(x: np.ndarray, y: np.ndarray, pixels: int, validity_channel: int | None = None, max_range_m: float = MAX_RANGE_METERS) -> np.ndarray:
    """mae_m, rmse_m, d125, d125_sq and valid fraction of each row; NaN where no pixel is valid."""
    limit = 0.0 if validity_channel is None else 0.5
    first = (validity_channel or 0) * pixels
    guide, x, y = (np.where(np.isnan(v), np.inf, v) for v in (y[:, first : first + pixels], x[:, :pixels], y[:, :pixels]))
    guide = np.pad(guide, ((0, 0), (0, y.shape[1] - guide.shape[1])), constant_values=-np.inf)
    used = (guide > limit) & (y > 0)
    x, y = np.clip(x, 0.0, 1.0) * max_range_m, np.where(used, np.clip(y, 0.0, 1.0) * max_range_m, 1.0)
    d = np.where(used, x - y, 0.0)
    ratio = np.maximum(np.abs(x / y), np.abs(y / np.maximum(np.abs(x), 1e-6)))
    n = used.sum(axis=1)
    some = np.where(n > 0, n, np.nan)
    near, nearer = ((used & (ratio < bound)).sum(axis=1) for bound in (DELTA, DELTA * DELTA))
    return np.stack([np.abs(d).sum(axis=1) / some, np.sqrt(np.einsum("ij,ij->i", d, d) / some), near / some, nearer / some, n / pixels], axis=1)


def _once(measure):
    """The function as one that the optimiser neither copies into an aggregate nor evaluates twice."""
    return measure.asNondeterministic()


def error_metrics(pred: Column, truth: Column, max_val: float = 1.0) -> Column:
    """``struct(mse, mae, rmse, psnr_db)``; a perfect match has PSNR +inf.

    Like the other metrics it works on Arrow batches, so that all metrics of a row share one pass to Python and back.
    """
    if max_val <= 0:
        raise ValueError("max_val must be positive")

    @F.arrow_udf("struct<mse:double,mae:double,rmse:double,psnr_db:double>")
    def measured(p: pa.Array, t: pa.Array) -> pa.Array:
        out = np.full((len(p), 4), np.nan)
        for rows, (x, y) in shaped(p, t):
            out[rows] = error_rows(x, y, max_val)
        return _structs(out, ("mse", "mae", "rmse", "psnr_db"))

    return _once(measured)(doubles(pred), doubles(truth))


def depth_metrics(
    pred: Column, truth: Column, pixels: int, validity_channel: int | None = None, max_range_m: float = MAX_RANGE_METERS
) -> Column:
    """Metric errors of channel 0 over valid pixels; every metric but the fraction is NULL when none is valid."""
    @F.arrow_udf("struct<mae_m:double,rmse_m:double,d125:double,d125_sq:double,valid_fraction:double>")
    def measured(p: pa.Array, t: pa.Array) -> pa.Array:
        out = np.full((len(p), 5), np.nan)
        for rows, (x, y) in shaped(p, t):
            out[rows] = depth_rows(x, y, pixels, validity_channel, max_range_m)
        return _structs(out, ("mae_m", "rmse_m", "d125", "d125_sq", "valid_fraction"))

    return _once(measured)(doubles(pred), doubles(truth))


def window_starts(length: int, window: int, step: int = SSIM_STEP) -> list[int]:
    """Window positions along one side; the last one is flush with the edge."""
    if length <= window:
        return [0]
    return sorted({*range(0, length - window, step), length - window})


def ssim_scores(h: int, w: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Similarity of each row of two matrices of planar RGB frames of ``h x w``, on luma.

    A full frame visits every pixel four times in overlapping windows; window sums come from blocks of ``SSIM_STEP`` pixels
    a side where windows are made of those, else from running totals.
    """
    if h <= SSIM_WINDOW and w <= SSIM_WINDOW:
        win_h, win_w, rows, cols = h, w, [0], [0]
    else:
        side = min(SSIM_WINDOW, h, w)
        win_h, win_w, rows, cols = side, side, window_starts(h, side), window_starts(w, side)
    rows_at, cols_at = np.array(rows), np.array(cols)
    blocks = win_h == win_w == SSIM_WINDOW == 2 * SSIM_STEP and h % SSIM_STEP == 0 and w % SSIM_STEP == 0

    def window_means(v: np.ndarray) -> np.ndarray:
        if blocks:
            narrow = sum(v[:, :, k::SSIM_STEP] for k in range(1, SSIM_STEP)) + v[:, :, ::SSIM_STEP]
            small = sum(narrow[:, k::SSIM_STEP] for k in range(1, SSIM_STEP)) + narrow[:, ::SSIM_STEP]
            pairs = small[:, 1:] + small[:, :-1]
            return (pairs[:, :, 1:] + pairs[:, :, :-1]) / (win_h * win_w)
        sums = np.zeros((len(v), h + 1, w + 1))
        np.cumsum(np.cumsum(v, axis=1), axis=2, out=sums[:, 1:, 1:])
        low_r, low_c = rows_at[:, None], cols_at[None, :]
        high_r, high_c = low_r + win_h, low_c + win_w
        inside = sums[:, high_r, high_c] - sums[:, low_r, high_c] - sums[:, high_r, low_c] + sums[:, low_r, low_c]
        return inside / (win_h * win_w)

    def luma(values: np.ndarray) -> np.ndarray:
        planes = values.reshape(-1, 3, h, w)
        out = planes[:, 0] * LUMA_WEIGHTS[0]
        for k in (1, 2):
            out += planes[:, k] * LUMA_WEIGHTS[k]
        return out

    def scores(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        if p.shape[1] != 3 * h * w:
            raise ValueError(f"tensors must be planar RGB of {h}x{w}")
        x, y = luma(p), luma(t)
        mx, my = window_means(x), window_means(y)
        cov = window_means(x * y) - mx * my
        spread = window_means(x * x) + window_means(y * y) - mx * mx - my * my
        top = (2 * mx * my + SSIM_C1) * (2 * cov + SSIM_C2)
        return (top / ((mx * mx + my * my + SSIM_C1) * (spread + SSIM_C2))).mean(axis=(1, 2))

    return scores


def ssim(pred: Column, truth: Column, h: int, w: int, places: np.ndarray | None = None) -> Column:
    """Mean windowed structural similarity of planar RGB tensors on luma.

    With ``places`` the columns hold short vectors, and the task lays out the tensors: pixel k is value ``places[k]``.
    """
    scores = ssim_scores(h, w)

    @F.arrow_udf("double")
    def similarity(p: pa.Array, t: pa.Array) -> pa.Array:
        out = np.full(len(p), np.nan)
        for rows, (x, y) in shaped(p, t, places=places):
            out[rows] = scores(x, y)
        return pa.array(out, mask=np.isnan(out))

    return _once(similarity)(doubles(pred), doubles(truth))
