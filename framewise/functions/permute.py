"""A keyed bijection of ``0 .. n-1``: a shuffled place for every row number, by integer arithmetic alone.

A place is a pair of digits ``(left, right)`` in a grid of ``a`` by ``b`` cells, the smallest near-square one that holds ``n``. Each round adds
a keyed function of one digit to the other, modulo its size, which can be undone; so the rounds permute the grid. A number that lands
on one of the fewer than ``a`` cells beyond ``n`` goes through the rounds again until it does not, which keeps it a bijection of 0 .. n-1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
PRIME = (1 << 31) - 1
#: Passes through the rounds that a column may take; a number needs a second one in about one of sqrt(n) cases.
PASSES = 64
LARGEST = 1 << 60


class Permutation:
    def __init__(self, n: int, seed: int):
        if not 0 <= n <= LARGEST:
            raise ValueError(f"between 0 and {LARGEST} rows can be permuted")
        self.n = n
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = self.round_keys(seed)

    @staticmethod
    def round_keys(seed: int) -> list[tuple[int, int]]:
        """A factor and a summand for each round, below ``PRIME``, from a multiplicative generator that the seed starts."""
        state, out = (seed * 48271 + 11) % PRIME or 1, []
        for _ in range(ROUNDS):
            pair = []
            for _ in range(2):
                for _ in range(3):
                    state = state * 48271 % PRIME
                pair.append(state)
            out.append((pair[0] or 1, pair[1]))
        return out

    def _mixed(self, digit: int, key: tuple[int, int]) -> int:
        x = (digit % PRIME * key[0] + key[1]) % PRIME
        return (x ^ (x >> 15)) * 48271 % PRIME

    def _once(self, x: int) -> int:
        left, right = x // self.b, x % self.b
        for i, key in enumerate(self.keys):
            if i % 2 == 0:
                left = (left + self._mixed(right, key)) % self.a
            else:
                right = (right + self._mixed(left, key)) % self.b
        return left * self.b + right

    def place(self, number: int) -> int:
        """The place of a row number."""
        number = self._once(number)
        while number >= self.n:
            number = self._once(number)
        return number

    def back(self, place: int) -> int:
        """The row number at a place."""
        while True:
            left, right = place // self.b, place % self.b
            for i, key in reversed(list(enumerate(self.keys))):
                if i % 2 == 0:
                    left = (left - self._mixed(right, key)) % self.a
                else:
                    right = (right - self._mixed(left, key)) % self.b
            place = left * self.b + right
            if place < self.n:
                return place

    def column(self, number: Column) -> Column:
        """``place`` as an expression. A number outside ``0 .. n-1``, or a null, is an error."""
        keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(f).cast("bigint").alias("f"), F.lit(s).cast("bigint").alias("s")) for i, (f, s) in enumerate(self.keys)])

        def mixed(digit: Column, key: Column) -> Column:
            x = F.pmod(F.pmod(digit, F.lit(PRIME)) * key["f"] + key["s"], F.lit(PRIME))
            return F.pmod(x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(48271), F.lit(PRIME))

        def step(at: Column, key: Column) -> Column:
            left = F.when(key["even"], F.pmod(at["l"] + mixed(at["r"], key), F.lit(self.a))).otherwise(at["l"])
            right = F.when(key["even"], at["r"]).otherwise(F.pmod(at["r"] + mixed(at["l"], key), F.lit(self.b)))
            return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

        def once(x: Column) -> Column:
            start = F.struct(F.call_function("div", x, F.lit(self.b)).alias("l"), F.pmod(x, F.lit(self.b)).cast("bigint").alias("r"))
            return F.aggregate(keys, start, step, lambda at: at["l"] * F.lit(self.b) + at["r"])

        inside = F.coalesce((number >= 0) & (number < self.n), F.lit(False))
        checked = F.when(inside, number.cast("bigint")).otherwise(F.raise_error(F.lit(f"row number outside 0 .. {self.n - 1}")).cast("bigint"))
        again = lambda x, _: F.when(x < self.n, x).otherwise(once(x))
        first = F.transform(F.array(checked), once)
        walked = F.get(F.transform(first, lambda x: F.when(x < self.n, x).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), x, again))), F.lit(0))
        return F.get(
            F.transform(F.array(walked), lambda x: F.when(x < self.n, x).otherwise(F.raise_error(F.lit("no place within the passes")).cast("bigint"))), F.lit(0)
        )
