"""Separable resampling of range images on Arrow batches.

An output image is ``A X B^T`` for a source image X: A and B hold two weights in each row, so they are kept as the two source indices
and the weight of the second. They depend on the shapes only and are made once per shape; all rows of a batch with one
shape are one array, whose columns and then rows are blended with a few numpy steps and no expression per pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of source or result that are worked on together.
CHUNK_VALUES = 1 << 21


@lru_cache(maxsize=256)
def linear_taps(n_src: int, n_dst: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per output index: both source indices and the weight of the second, with half-pixel centres and clamped edges."""
    s = (np.arange(n_dst) + 0.5) * (n_src / n_dst) - 0.5
    low = np.clip(np.floor(s).astype(np.int64), 0, n_src - 1)
    return low, np.minimum(low + 1, n_src - 1), np.clip(s - low, 0.0, 1.0)


@lru_cache(maxsize=256)
def nearest_taps(n_src: int, n_dst: int) -> np.ndarray:
    """Per output index the source index, halves away from zero."""
    s = (np.arange(n_dst) + 0.5) * (n_src / n_dst) - 0.5
    return np.clip((np.sign(s) * np.floor(np.abs(s) + 0.5)).astype(np.int64), 0, n_src - 1)


def blended(images: np.ndarray, h: int, w: int) -> np.ndarray:
    """``[n, H, W]`` to ``[n, h, w]``."""
    top, bottom, down = linear_taps(images.shape[1], h)
    left, right, across = linear_taps(images.shape[2], w)
    first = images[:, :, left]
    columns = first + across * (images[:, :, right] - first)
    upper = columns[:, top]
    return upper + down[:, None] * (columns[:, bottom] - upper)


def picked(images: np.ndarray, h: int, w: int) -> np.ndarray:
    """``[n, H, W]`` to the nearest values at ``[n, h, w]``."""
    return images[:, nearest_taps(images.shape[1], h)][:, :, nearest_taps(images.shape[2], w)]


def _images(values: pa.Array, *dims: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of one shape, and their images ``[n, H, W, C]``; rows without values or shape, or with no valid one, are left out.

    Values that are null or beyond the end of the row are 0, and those beyond the shape are not read.
    """
    shape = np.stack([np.asarray(d.cast(pa.int64()).fill_null(0)) for d in dims], axis=1)
    there = np.asarray(values.is_valid()) & (shape > 0).all(axis=1)
    lengths = np.asarray(values.value_lengths().fill_null(0)).astype(np.int64)
    for h, w, c in np.unique(shape[there], axis=0) if there.any() else []:
        size = int(h * w * c)
        rows = np.flatnonzero(there & (shape == (h, w, c)).all(axis=1))
        for part in np.array_split(rows, max(1, -(-len(rows) * size // CHUNK_VALUES))):
            flat = values.take(pa.array(part)).flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
            own = lengths[part]
            if (own == size).all():
                image = flat.reshape(len(part), size)
            else:
                image, at = np.zeros((len(part), size)), 0
                for i, n in enumerate(own):
                    image[i, : min(n, size)] = flat[at : at + min(n, size)]
                    at += n
            yield part, image.reshape(len(part), h, w, c)


def _planes(out: np.ndarray) -> pa.Array:
    """A row of ``out`` as a list."""
    ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.reshape(-1)))


def planes_of(make: Callable[[np.ndarray], np.ndarray], pixels: int, planes: int, least_channels: int):
    """An Arrow function of values and three sizes that lays out the planes that ``make`` gives for images ``[n, H, W, C]``.

    Rows without an image give zeros. Results leave the worker a few rows at a time, as one may be a thousand times its input.
    """

    step = max(1, CHUNK_VALUES // max(1, planes * pixels))

    @F.arrow_udf("array<double>")
    def resampled(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch[0]), step):
                part = [column.slice(at, step) for column in batch]
                out = np.zeros((len(part[0]), planes * pixels))
                for rows, images in _images(*part):
                    if images.shape[3] >= least_channels:
                        out[rows] = make(images).reshape(len(rows), -1)
                yield _planes(out)

    return resampled.asNondeterministic()


def checked(values: Column, sizes: tuple[Column, Column, Column], least_channels: int, function) -> Column:
    """The function's result; an impossible shape raises."""
    h, w, c = sizes
    bad = (h < 1) | (w < 1) | (c < least_channels)
    reason = F.concat(F.lit("invalid range image shape "), F.concat_ws("x", h, w, c))
    return F.when(bad, F.raise_error(reason)).otherwise(function(values.cast("array<double>"), h, w, c))
