"""Array columns for range images and RGB tensors. Shapes may be literals or per-row columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise.functions import resample
from framewise.functions.arrays import clamp, doubles, let, positions, round_half_away

# Fixed values of the sample format.
MAX_RANGE_METERS = 75.0
RGB_HEIGHT, RGB_WIDTH = 128, 256
RANGE_HEIGHT, RANGE_WIDTH = 64, 256
CHANNEL_NAMES = {
    "range": "range",
    "distance": "range",
    "intensity": "intensity",
    "validity": "validity",
    "valid": "validity",
    "mask": "validity",
    "validity_mask": "validity",
    "validity-mask": "validity",
}


def _col(n: Column | int) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def rgb_chw(pixels: Column) -> Column:
    """Interleaved ``[H, W, 3]`` bytes-as-integers to planar floats in ``[0, 1]``."""

    def planes(px: Column) -> Column:
        count = F.floor(F.size(px) / F.lit(3)).cast("int")
        return F.flatten(
            F.transform(
                F.array(F.lit(0), F.lit(1), F.lit(2)),
                lambda c: F.transform(positions(count), lambda i: F.get(px, i * 3 + c) / F.lit(255.0)),
            )
        )

    return let(pixels, planes)


def bilinear(
    values: Column, h_src: Column | int, w_src: Column | int, c_src: Column | int, h: int, w: int, channel: int,
) -> Column:
    """One channel of an interleaved image resampled to ``h x w``: half-pixel centres, edge clamp, missing = 0."""

    def make(images: np.ndarray) -> np.ndarray:
        if channel >= images.shape[3]:
            return np.zeros((len(images), h, w))
        return resample.blended(images[..., channel], h, w)

    sizes = tuple(map(_col, (h_src, w_src, c_src)))
    return resample.checked(values, sizes, 2, resample.planes_of(make, h * w, 1, 2))


def validity(
    values: Column, h_src: Column | int, w_src: Column | int, c_src: Column | int, h: int, w: int
) -> Column:
    """1 where the nearest raw range value is positive, else 0, at ``h x w``."""

    def make(images: np.ndarray) -> np.ndarray:
        return (~(resample.picked(images[..., 0], h, w) <= 0)).astype(np.float64)  # NaN ranks above all numbers

    sizes = tuple(map(_col, (h_src, w_src, c_src)))
    return resample.checked(values, sizes, 1, resample.planes_of(make, h * w, 1, 1))


def bilinear_and_validity(
    values: Column, h_src: Column | int, w_src: Column | int, c_src: Column | int, h: int, w: int, channel: int,
) -> Column:
    """The planes of ``bilinear`` and of ``validity``, from one reading of the image."""

    def make(images: np.ndarray) -> np.ndarray:
        there = channel < images.shape[3]
        first = resample.blended(images[..., channel], h, w) if there else np.zeros((len(images), h, w))
        return np.stack([first, ~(resample.picked(images[..., 0], h, w) <= 0)], axis=1)

    sizes = tuple(map(_col, (h_src, w_src, c_src)))
    return resample.checked(values, sizes, 2, resample.planes_of(make, h * w, 2, 2))


def validity_stats(mask: Column) -> Column:
    """``struct(valid_pixels, total_pixels, valid_fraction)``; an empty mask has fraction 0."""
    valid = F.size(F.filter(mask, lambda v: v > 0)).cast("bigint")
    count = F.size(mask).cast("bigint")
    fraction = F.when(count > 0, F.try_divide(valid.cast("double"), count.cast("double"))).otherwise(F.lit(0.0))
    return F.struct(valid.alias("valid_pixels"), count.alias("total_pixels"), fraction.alias("valid_fraction"))


def clamp_scale(values: Column, divisor: float = MAX_RANGE_METERS) -> Column:
    """Divide by a physical maximum and clamp to ``[0, 1]``."""
    return F.transform(values, lambda v: clamp(v / F.lit(divisor), 0.0, 1.0))


def max_norm(values: Column) -> Column:
    """Divide by the largest value when that is positive, clamped to ``[0, 1]``; otherwise unchanged."""

    def scaled(v: Column) -> Column:
        peak = F.greatest(F.lit(0.0), F.coalesce(F.array_max(v), F.lit(0.0)))
        return let(
            peak,
            lambda m: F.when(m > 0, F.transform(v, lambda x: clamp(x / F.nullif(m, F.lit(0.0)), 0.0, 1.0))).otherwise(v),
        )

    return let(values, scaled)


def channel_list(channels: list[str]) -> list[str]:
    """Canonical channel names; unknown names or an empty list are errors."""
    if not channels:
        raise ValueError("no range channel is named")
    out = []
    for name in channels:
        key = name.strip().lower()
        if key not in CHANNEL_NAMES:
            raise ValueError(f"{name} is no range channel")
        out.append(CHANNEL_NAMES[key])
    return out


def channel_index(channels: list[str], name: str) -> int | None:
    """Position of a channel in the configured order, or None."""
    wanted = channel_list([name])[0]
    known = channel_list(channels)
    return known.index(wanted) if wanted in known else None


def range_chw(
    values: Column, h_src: Column | int, w_src: Column | int, c_src: Column | int, h: int, w: int,
    channels: list[str], max_range: float = MAX_RANGE_METERS,
) -> Column:
    """Planar range tensor in the configured channel order, all planes from one reading of the image."""
    names = channel_list(channels)

    def scaled(v: np.ndarray, divisor: np.ndarray | float) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            part = v / divisor
        return np.where(np.isnan(part), 1.0, np.clip(part, 0.0, 1.0))

    def make(images: np.ndarray) -> np.ndarray:
        planes = []
        for name in names:
            if name == "range":
                planes.append(scaled(resample.blended(images[..., 0], h, w), max_range))
            elif name == "intensity":
                v = resample.blended(images[..., 1], h, w)
                peak = v.max(axis=(1, 2), keepdims=True)
                planes.append(np.where(peak <= 0, v, scaled(v, peak)))
            else:
                planes.append((~(resample.picked(images[..., 0], h, w) <= 0)).astype(np.float64))
        return np.stack(planes, axis=1)

    least = 1 if set(names) == {"validity"} else 2
    sizes = tuple(map(_col, (h_src, w_src, c_src)))
    return resample.checked(values, sizes, least, resample.planes_of(make, h * w, len(names), least))


def plane(values: Column, channel: int, pixels: Column | int) -> Column:
    """One channel of a planar tensor."""
    return F.slice(values, F.lit(channel) * _col(pixels) + 1, _col(pixels))


def _to_u8(v: Column, rounding: str) -> Column:
    scaled = clamp(v.cast("double"), 0.0, 1.0) * F.lit(255.0)
    if rounding == "round":
        return round_half_away(scaled).cast("int")
    if rounding == "truncate":
        return F.floor(scaled).cast("int")
    raise ValueError("rounding must be 'round' or 'truncate'")


def pack_rgb_u8(values: Column, rounding: str = "round") -> Column:
    """Planar RGB floats to interleaved 8-bit integers."""

    def body(px: Column) -> Column:
        count = F.floor(F.size(px) / F.lit(3)).cast("int")
        return F.flatten(
            F.transform(
                positions(count),
                lambda i: F.array(*[_to_u8(F.get(px, i + count * c), rounding) for c in range(3)]),
            )
        )

    return let(values, body)


def pack_range_u8(values: Column, pixels: Column | int, rounding: str = "round") -> Column:
    """Planar range floats to interleaved ``[depth, second channel or 0, 0]`` 8-bit integers."""
    n = _col(pixels)

    def body(px: Column) -> Column:
        return F.flatten(
            F.transform(
                positions(n),
                lambda i: F.array(
                    _to_u8(F.get(px, i), rounding),
                    _to_u8(F.coalesce(F.get(px, i + n), F.lit(0.0)), rounding),
                    F.lit(0),
                ),
            )
        )

    return let(values, body)


def unpack_u8(packed: Column, channels: int) -> Column:
    """Interleaved 8-bit triples to the first ``channels`` planes, as floats in ``[0, 1]``."""

    def body(px: Column) -> Column:
        count = F.floor(F.size(px) / F.lit(3)).cast("int")
        return F.flatten(F.array(*[_plane_from_triples(px, count, c) for c in range(channels)]))

    return let(packed, body)


def _plane_from_triples(px: Column, count: Column, channel: int) -> Column:
    return F.transform(positions(count), lambda i: F.get(px, i * 3 + F.lit(channel)) / F.lit(255.0))


def abs_error(pred: Column, truth: Column, gain: float = 4.0) -> Column:
    """Amplified absolute difference, element by element."""
    return F.zip_with(doubles(pred), doubles(truth), lambda p, t: F.abs(t - p) * F.lit(gain))
