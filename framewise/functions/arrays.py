"""Small array building blocks shared by the tensor, metric and quantisation columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``.

    A plain column used inside a lambda is evaluated again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_doubles(values: Iterable[float]) -> Column:
    """A constant ``array<double>`` from one string literal that is folded at planning time."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def positions(n: Column | int) -> Column:
    """``0 .. n-1``; ``n`` must be positive."""
    return F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - F.lit(1))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(F.least(x, high), low)


def round_half_away(x: Column) -> Column:
    """Round to an integral double, halves away from zero, without going through decimals."""
    d = x.cast("double")
    return F.signum(d) * F.floor(F.abs(d) + F.lit(0.5)).cast("double")


def fixed6(x: Column) -> Column:
    """Six decimals of the exact binary value, halves to even, as C's ``%.6f``; ``format_string`` rounds halves of the shortest text up.

    The fraction is cut at 38 bits: the upper part times a million is exact, the lower part only decides which half it lies in.
    NaN, infinities and values of 2^63 and above are left to ``format_string``.
    """
    d = x.cast("double")
    size = F.abs(d)
    whole = F.floor(size)
    fraction = size - whole.cast("double")
    upper = F.floor(fraction * F.lit(float(1 << 38))).cast("double") / F.lit(float(1 << 38))
    scaled = upper * F.lit(1e6)
    steps = F.floor(scaled)
    to_half, lower = F.lit(0.5) - (scaled - steps.cast("double")), (fraction - upper) * F.lit(1e6)
    up = (lower > to_half) | ((lower == to_half) & (steps % 2 == 1))
    millionths = steps + up.cast("long")
    over = millionths == 1_000_000
    sign = F.when(F.startswith(d.cast("string"), F.lit("-")), "-").otherwise("")
    digits = F.lpad(F.when(over, F.lit(0)).otherwise(millionths).cast("string"), 6, "0")
    text = F.concat(sign, (whole + over.cast("long")).cast("string"), F.lit("."), digits)
    return F.when(size < F.lit(float(1 << 63)), text).otherwise(F.format_string("%.6f", d))


def is_finite(x: Column) -> Column:
    d = x.cast("double")
    return ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def digest(values: Column, prefix: str = "") -> list[Column]:
    """Length, sum and position-weighted sum of an array: an order-sensitive fingerprint."""
    d = doubles(values)
    weighted = F.transform(d, lambda x, i: x * (i + F.lit(1)))
    return [
        F.size(values).alias(f"{prefix}n"),
        (F.round(total(d), 6) + F.lit(0.0)).alias(f"{prefix}total"),
        (F.round(total(weighted), 5) + F.lit(0.0)).alias(f"{prefix}weighted"),
    ]
