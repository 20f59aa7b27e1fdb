"""Stable 64-bit row priorities: the finaliser of a public counter generator, in column functions.

Products wrap at 64 bits. Columns are signed and overflow is an error in ANSI mode, so a product is made of parts that stay under 63 bits;
priorities are compared as unsigned numbers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator's step and its two multipliers.
STEP = 0x9E3779B97F4A7C15
FIRST, SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = (1 << 32) - 1


def _signed(number: int) -> int:
    number &= (1 << 64) - 1
    return number - (1 << 64) if number >> 63 else number


def _times(x: Column, factor: int) -> Column:
    """x * factor, the low 64 bits."""
    low, high = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32)
    quarters = [factor >> (16 * i) & 0xFFFF for i in range(4)]
    first, second = low * quarters[0], low * quarters[1]
    sum_low = first.bitwiseAND(F.lit(_LOW)) + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    half = lambda part, a, b: part * quarters[a] + F.shiftleft((part * quarters[b]).bitwiseAND(F.lit(0xFFFF)), 16)
    top = F.shiftrightunsigned(first, 32) + F.shiftrightunsigned(second, 16) + F.shiftrightunsigned(sum_low, 32) + half(low, 2, 3) + half(high, 0, 1)
    return F.shiftleft(top, 32).bitwiseOR(sum_low.bitwiseAND(F.lit(_LOW)))


def stable_priority(seed: int, key: Column, step: bool = True) -> Column:
    """The 64 bits of a row's priority, as a signed number. step: the seed is moved by one step of the generator, as selections of contexts
    do; those of building ladders do without."""
    x = key.cast("long").bitwiseXOR(F.lit(_signed(seed + STEP if step else seed)))
    x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 30)), FIRST)
    x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 27)), SECOND)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 31))


def unsigned_order(bits: Column) -> Column:
    """A signed number in the order of the unsigned one."""
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_text(bits: Column) -> Column:
    """The unsigned number in decimal digits."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + F.lit(Decimal(1 << 64))).otherwise(wide).cast("decimal(20,0)").cast("string")
