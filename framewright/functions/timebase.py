"""Ticks and rational timebases (num / den seconds a tick)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


def valid(num: Column, den: Column) -> Column:
    return (num > 0) & (den > 0)


def to_seconds(pts: Column, num: Column, den: Column) -> Column:
    return pts.cast("double") * num / den


def from_seconds(seconds: Column, num: Column, den: Column) -> Column:
    """Whole ticks, cut toward zero; beyond 64 bits the nearest end, NaN 0."""
    ticks = seconds * den / num
    return F.when(F.isnan(ticks), F.lit(0).cast("long")).when(ticks >= float(LONG_MAX), F.lit(LONG_MAX)).when(ticks <= float(LONG_MIN), F.lit(LONG_MIN)).otherwise(ticks.cast("long"))


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient cut toward zero of decimals without a fraction; a multiple of the divisor divides without a rest."""
    return _whole((a - a % b) / b)


def _low_64(x: Column) -> Column:
    """The low 64 bits of a whole decimal as a long, which is the number itself unless it is larger."""
    top, half = (F.lit(str(n)).cast("decimal(38,0)") for n in (2**64, 2**63))
    low = (x % top + top) % top
    return F.when(low >= half, low - top).otherwise(low).cast("decimal(20,0)").cast("long")


def scale(pts: Column, num: Column, den: Column, to_num: Column, to_den: Column) -> Column:
    """pts * to_num / to_den * den / num, cut after each division (so parts of a second are lost where to_den is the rate).

    As 128-bit numbers have it, of which the low 64 bits are left; no numbers of 32 bits in a timebase overflow. The second
    product can have 39 digits, so whole parts of its quotient are taken ahead of it, and only modulo 2^64.
    """
    top = F.lit(str(2**64)).cast("decimal(38,0)")
    by_den, by_num = den.cast("decimal(10,0)"), _whole(num)
    first = _div(_whole(pts.cast("decimal(19,0)") * to_num.cast("decimal(10,0)")), _whole(to_den))
    whole, rest = _div(first, by_num), first % by_num
    low = _whole((whole % top).cast("decimal(20,0)") * by_den)
    return _low_64(low + _div(_whole(rest.cast("decimal(10,0)") * by_den), by_num))


def rescale(pts: Column, num: Column, den: Column, to_num: Column, to_den: Column) -> Column:
    """The tick of timebase ``to`` at or before pts (toward zero): one exact division, null beyond 64 bits.

    The product can have 39 digits, so the upper half of its factor is divided first and its rest joins the lower half.
    """
    by = lambda a, b: (a.cast("decimal(10,0)") * b.cast("decimal(10,0)")).cast("decimal(20,0)")
    half = F.lit(str(2**32)).cast("decimal(10,0)")
    up, down, ticks = by(num, to_den), _whole(by(den, to_num)), pts.cast("decimal(19,0)")
    high, low = _div(_whole(up), _whole(half)).cast("decimal(10,0)"), (up % half).cast("decimal(10,0)")
    first = _whole(ticks * high)
    whole, rest = _div(first, down), (first % down).cast("decimal(20,0)")
    tail = _div(_whole(rest * half) + _whole(ticks * low), down)
    # Beyond this the result has more than 64 bits.
    return F.when(F.abs(whole) < F.lit(2**33), whole.cast("decimal(11,0)") * half + tail).try_cast("long")


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in at most 48 steps, enough for 32-bit numbers; an error where it would take more."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b")))
    return F.when(done["b"] == 0, done["a"]).otherwise(F.raise_error(F.lit("numbers too large for gcd")))
