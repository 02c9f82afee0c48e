"""Per-vector int8 quantisation. Arithmetic is kept in single precision so that codes match exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise.functions.arrays import clamp, is_finite, let, round_half_away

POLICIES = ("symmetric", "asymmetric")
HEADER_BYTES = 22  # fixed: f32 scale, i8 zero point, f32 min, f32 max, u8 policy, u64 length


def _f(x: Column) -> Column:
    return x.cast("float")


def check_policy(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")


def _unfit(v: Column) -> Column:
    return (F.size(v) < 1) | F.exists(v, lambda x: x.isNull() | ~is_finite(x))


def payload_size(values: Column, policy: str = "asymmetric") -> Column:
    """Bytes of a quantised vector: header and one byte for each value; what cannot be quantised raises."""
    check_policy(policy)
    return (
        F.when(_unfit(values), F.raise_error(F.lit("vector must be non-empty and finite")).cast("int")).otherwise(F.size(values)) + HEADER_BYTES
    ).cast("bigint")


def int8_meta(values: Column, policy: str = "asymmetric") -> Column:
    """``struct(scale, zero_point, min_value, max_value)``; empty or non-finite vectors raise."""
    check_policy(policy)

    def unconstant(lo: Column, hi: Column) -> Column:
        if policy == "symmetric":
            peak = F.greatest(F.abs(lo), F.abs(hi))
            return let(
                peak,
                lambda m: F.struct(
                    _f(m / F.lit(127.0)).alias("scale"),
                    F.lit(0).cast("tinyint").alias("zero_point"),
                    (-m).alias("min_value"),
                    m.alias("max_value"),
                ),
            )
        scale = _f(_f(hi - lo) / F.lit(255.0))
        return let(
            scale,
            lambda s: F.struct(
                s.alias("scale"),
                clamp(round_half_away(_f(F.lit(-128.0).cast("float") - _f(F.try_divide(lo, s)))), -128.0, 127.0)
                .cast("tinyint")
                .alias("zero_point"),
                lo.alias("min_value"),
                hi.alias("max_value"),
            ),
        )

    def from_bounds(b: Column) -> Column:
        constant = F.struct(
            F.lit(1.0).cast("float").alias("scale"),
            F.lit(0).cast("tinyint").alias("zero_point"),
            b["lo"].alias("min_value"),
            b["hi"].alias("max_value"),
        )
        return F.when(b["lo"] == b["hi"], constant).otherwise(unconstant(b["lo"], b["hi"]))

    def from_values(v: Column) -> Column:
        bounds = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
        return F.when(_unfit(v), F.raise_error(F.lit("vector must be non-empty and finite"))).otherwise(
            let(bounds, from_bounds)
        )

    return let(values.cast("array<float>"), from_values)


def quantize(values: Column, meta: Column) -> Column:
    """``array<tinyint>`` codes; a constant vector has all codes 0."""

    def codes(b: Column) -> Column:
        m = b["m"]

        def code(x: Column) -> Column:
            clipped = clamp(x, m["min_value"], m["max_value"])
            shifted = _f(F.try_divide(clipped, m["scale"])) + m["zero_point"].cast("float")
            return clamp(round_half_away(shifted), -128.0, 127.0).cast("tinyint")

        return F.when(m["min_value"] == m["max_value"], F.transform(b["v"], lambda _: F.lit(0).cast("tinyint"))).otherwise(
            F.transform(b["v"], code)
        )

    return let(F.struct(values.cast("array<float>").alias("v"), meta.alias("m")), codes)


def dequantize(codes: Column, meta: Column) -> Column:
    """``array<float>`` restored from codes; a constant vector restores exactly."""

    def values(b: Column) -> Column:
        m = b["m"]

        def value(q: Column) -> Column:
            centred = (q.cast("int") - m["zero_point"].cast("int")).cast("float")
            return clamp(centred * m["scale"], m["min_value"], m["max_value"])

        return F.when(m["min_value"] == m["max_value"], F.transform(b["q"], lambda _: m["min_value"])).otherwise(
            F.transform(b["q"], value)
        )

    return let(F.struct(codes.alias("q"), meta.alias("m")), values)
