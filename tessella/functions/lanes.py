"""Lane arithmetic of fixed-width integers, without the errors that ANSI mode raises on overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrap(x: Column, bits: int, signed: bool = True) -> Column:
    """x modulo 2^bits, as a number of that width."""
    m = 1 << bits
    low = F.pmod(x.cast("decimal(38,0)"), F.lit(m).cast("decimal(38,0)")).cast("long")
    return F.when(low >= m >> 1, low - m).otherwise(low) if signed else low


def add_wrap(a: Column, b: Column, bits: int, signed: bool = True) -> Column:
    return wrap(a.cast("decimal(38,0)") + b, bits, signed)


def _range(bits: int, signed: bool) -> tuple[int, int]:
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)


def saturate(x: Column, bits: int, signed: bool = True) -> Column:
    low, high = _range(bits, signed)
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def add_saturated(a: Column, b: Column, bits: int, signed: bool = True) -> Column:
    return saturate(a.cast("long") + b, bits, signed)


def subtract_saturated(a: Column, b: Column, bits: int, signed: bool = True) -> Column:
    return saturate(a.cast("long") - b, bits, signed)


def average_round(a: Column, b: Column) -> Column:
    return F.shiftright(a.cast("long") + b + 1, 1)


def shift_left(x: Column, n: Column, bits: int) -> Column:
    """Counts of the width or more give 0, where Spark would wrap the count."""
    moved = F.call_function("shiftleft", x.cast("long"), F.pmod(n, F.lit(bits)).cast("int"))
    return F.when(n >= bits, F.lit(0).cast("long")).otherwise(wrap(moved, bits, signed=False))


def shift_right(x: Column, n: Column, bits: int) -> Column:
    moved = F.call_function("shiftright", x.cast("long"), F.pmod(n, F.lit(bits)).cast("int"))
    return F.when(n >= bits, F.lit(0).cast("long")).otherwise(moved)


def mul_high(a: Column, b: Column, bits: int = 16) -> Column:
    return F.shiftright(a.cast("long") * b, bits)


def mul_high_round(a: Column, b: Column, bits: int = 16) -> Column:
    return F.shiftright(a.cast("long") * b + (1 << bits - 2), bits - 1)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def select(a: Column, b: Column, mask: Column) -> Column:
    """b where the mask is set, else a."""
    return F.when(mask, b).otherwise(a)


def interleave(a: Column, b: Column) -> Column:
    """a[0], b[0], a[1], b[1], ... of two arrays of one length."""
    return F.flatten(F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: F.array(p["x"], p["y"])))


def lookup(table: Column, index: Column) -> Column:
    return F.transform(index, lambda i: F.element_at(table, (i + 1).cast("int")))


def sum_of_lanes(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(c, F.greatest(a, b)))


def median5(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """Drop the smallest and the largest of four; the fifth decides between what is left."""
    low, high = F.greatest(F.least(a, b), F.least(c, d)), F.least(F.greatest(a, b), F.greatest(c, d))
    return median3(e, low, high)


def half_up(x: Column) -> Column:
    """Integer half, rounding up."""
    return F.floor((x + 1) / 2).cast("long")


# Fused arithmetic, roots and reciprocals -------------------------------------------------------------


def mul_add(a: Column, b: Column, c: Column) -> Column:
    return a * b + c


def nmul_add(a: Column, b: Column, c: Column) -> Column:
    return c - a * b


def mul_subtract(a: Column, b: Column, c: Column) -> Column:
    return a * b - c


def nmul_subtract(a: Column, b: Column, c: Column) -> Column:
    return -(a * b) - c


def reciprocal(x: Column) -> Column:
    return F.when(x != 0, 1 / x)


def reciprocal_sqrt(x: Column) -> Column:
    return F.when(x > 0, 1 / F.sqrt(x))


# Conversions -----------------------------------------------------------------------------------------


def nearest_int(x: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(x).cast("int")


def float_bits(x: Column) -> Column:
    """The bits of a 32-bit float as an unsigned number."""
    return F.conv(_float_hex(x), 16, 10).cast("long")


def _float_hex(x: Column) -> Column:
    """Hexadecimal bits of a normal 32-bit float, from its sign, exponent and fraction."""
    size = F.abs(x.cast("float").cast("double"))
    exponent = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))).cast("int")
    # the logarithm may be off by one at powers of two
    exponent = F.when(F.pow(F.lit(2.0), exponent) > size, exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= size, exponent + 1).otherwise(exponent)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << 23)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).otherwise((exponent.cast("long") + 127) * (1 << 23) + fraction)
    return F.hex(bits + F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)))


def u8_from_u32(x: Column) -> Column:
    """The low bytes of four lanes, as an array of bytes becomes one of numbers."""
    return F.transform(x, lambda v: F.pmod(v.cast("long"), F.lit(256)))


def u32_from_u8(x: Column) -> Column:
    """Four bytes, the first the lowest, as one unsigned number."""
    return F.aggregate(F.reverse(x), F.lit(0).cast("long"), lambda s, v: s * 256 + v)


# Parts and lane shifts -------------------------------------------------------------------------------


def broadcast_lane(x: Column, lane: int) -> Column:
    """One lane in all places."""
    return F.transform(x, lambda _: F.element_at(x, lane + 1))


def half(x: Column, upper: bool) -> Column:
    n = F.floor(F.size(x) / 2).cast("int")
    return F.slice(x, (n + 1) if upper else F.lit(1), n)


def shift_lanes(x: Column, n: int) -> Column:
    """Lanes moved n places up (down for a negative n), zeros coming in."""
    size = F.size(x)
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.get(x, F.when(i - n < 0, size).otherwise(i - n)), F.lit(0)))


def combine_shift_right(high: Column, low: Column, n: int) -> Column:
    """Lanes n and following of low with high behind it, as many as low has."""
    return F.slice(F.concat(low, high), n + 1, F.size(low))
