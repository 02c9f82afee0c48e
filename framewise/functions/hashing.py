"""Split hash: a seeded 64-bit byte hash kept as two unsigned 32-bit halves, so ANSI mode never overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash that results must agree with.
OFFSET_BASIS = 0xCBF29CE484222325
PRIME = 0x00000100000001B3
SEED_ROTATION = 17

_MASK64 = (1 << 64) - 1
_MASK32 = (1 << 32) - 1


def seed_state(seed: int) -> int:
    """Hash state after the seed: it depends on the seed alone, so the driver folds its eight bytes once."""
    seed &= _MASK64
    state = OFFSET_BASIS ^ (((seed << SEED_ROTATION) | (seed >> (64 - SEED_ROTATION))) & _MASK64)
    for byte in seed.to_bytes(8, "little"):
        state = ((state ^ byte) * PRIME) & _MASK64
    return state


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of ``text`` as ``array<bigint>``."""
    hexed = F.hex(text.cast("binary"))
    starts = F.sequence(F.lit(1), F.octet_length(text) * 2, F.lit(2))
    return F.transform(starts, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("bigint"))


def split_hash(text: Column, seed: int) -> Column:
    """``struct(hi, lo)``; ordering by it is ordering by the unsigned 64-bit value."""
    start = seed_state(seed)
    low = PRIME & _MASK32

    def step(state: Column, byte: Column) -> Column:
        mixed = state["lo"].bitwiseXOR(byte)
        product = mixed * F.lit(low)
        # PRIME = 2**40 + low: the 2**40 part moves the low half into the high half, shifted by 8 bits.
        high = state["hi"] * F.lit(low) + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(
            high.bitwiseAND(F.lit(_MASK32)).alias("hi"),
            product.bitwiseAND(F.lit(_MASK32)).alias("lo"),
        )

    initial = F.struct(F.lit(start >> 32).cast("bigint").alias("hi"), F.lit(start & _MASK32).cast("bigint").alias("lo"))
    return F.aggregate(utf8_bytes(text), initial, step)
