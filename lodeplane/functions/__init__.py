"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_if_missing(c: Column) -> Column:
    """Null, NaN and 0 count as 1: weights and masses; negative values stay."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit(1.0)).otherwise(c)


def side(b: str = "") -> Column:
    """Side of the square around a bounding box."""
    return F.greatest(F.col(f"{b}xmax") - F.col(f"{b}xmin"), F.col(f"{b}ymax") - F.col(f"{b}ymin"), F.lit(1e-6))


def relative(v: str, low: str, high: str, width: Column) -> Column:
    """Place of a coordinate in the square, 0 up to 0.999999."""
    return F.least(F.greatest((F.col(v) - (F.col(low) + F.col(high)) / 2.0) / width + 0.5, F.lit(0.0)), F.lit(0.999999))


def next_pow2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def grid_side(items: int) -> int:
    """Side of the least square grid that holds the items."""
    root = int(items**0.5)
    while root * root < items:
        root += 1
    while root > 0 and (root - 1) * (root - 1) >= items:
        root -= 1
    return root


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of unsigned 32-bit numbers held as longs, by 16-bit halves so that nothing overflows."""
    low, mask = F.lit(0xFFFF).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    al, ah = a.bitwiseAND(low), F.shiftrightunsigned(a, 16).bitwiseAND(low)
    bl, bh = b.bitwiseAND(low), F.shiftrightunsigned(b, 16).bitwiseAND(low)
    cross = (ah * bl + al * bh).bitwiseAND(low)
    return (al * bl + F.shiftleft(cross, 16)).bitwiseAND(mask)


def uniform(seed: int, k: Column) -> Column:
    """The k-th number (from 0) of the 32-bit mixing generator with this seed, in [0, 1).

    The state moves on by a fixed step, so each number follows from seed and k alone and rows need no order.
    """
    mask = F.lit(0xFFFFFFFF).cast("long")
    first = (F.lit(seed & 0xFFFFFFFF).cast("long") + _mul32((k + 1).cast("long").bitwiseAND(mask), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(mask)

    def second(a: Column) -> Column:
        return _mul32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))

    def third(t: Column) -> Column:
        return t.bitwiseXOR((t + _mul32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask))

    def last(t: Column) -> Column:
        return t.bitwiseXOR(F.shiftrightunsigned(t, 14)).bitwiseAND(mask).cast("double") / F.lit(4294967296.0)

    return let(let(let(first, second), third), last)


def let(value: Column, body) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
