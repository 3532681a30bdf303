"""Numbers in byte strings, both byte orders, as column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _swapped(digits: Column, width: int) -> Column:
    """Hex digits of ``width`` bytes in the other byte order."""
    return F.concat(*(F.substr(digits, F.lit(2 * i + 1), F.lit(2)) for i in reversed(range(width))))


def hex_at(data: Column, at: int | Column, width: int, little: bool = True) -> Column:
    """Hex digits, most significant first, of the number of ``width`` bytes from 0-based ``at``. Null if cut short."""
    start = (F.lit(at) if isinstance(at, int) else at) + 1
    part = F.substr(data, start.cast("int"), F.lit(width))
    digits = F.when(F.octet_length(part) == width, F.hex(part))
    return _swapped(digits, width) if little else digits


def unsigned(digits: Column) -> Column:
    """Up to 7 bytes as a long."""
    return F.conv(digits, 16, 10).cast("long")


def unsigned_64(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def signed(digits: Column, width: int) -> Column:
    """Two's complement of up to 8 bytes as a long."""
    if width == 8:
        # The upper half is brought below zero in decimals, where nothing overflows.
        value = unsigned_64(digits)
        return F.when(value >= F.lit(str(2**63)).cast("decimal(20,0)"), value.cast("decimal(21,0)") - F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(value).cast("long")
    value = unsigned(digits)
    half = 1 << (8 * width - 1)
    return F.when(value >= half, value - 2 * half).otherwise(value)


def float_32(digits: Column) -> Column:
    """An IEEE single from its bits. Each is exact as a double, and the cast back is exact too."""
    bits = unsigned(digits)
    return float_32_of(bits)


def float_32_of(bits: Column) -> Column:
    sign = F.when(F.shiftright(bits, 31).bitwiseAND(1) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF)
    normal = sign * (F.lit(1.0) + fraction / F.lit(8388608.0)) * F.pow(F.lit(2.0), exponent - 127)
    small = sign * fraction * F.pow(F.lit(2.0), F.lit(-149))
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal).cast("float")


def float_64(digits: Column) -> Column:
    """An IEEE double from its 16 hex digits, most significant first."""
    high, low = unsigned(F.substr(digits, F.lit(1), F.lit(8))), unsigned(F.substr(digits, F.lit(9), F.lit(8)))
    sign = F.when(F.shiftright(high, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(high, 20).bitwiseAND(2047)
    fraction = high.bitwiseAND(0xFFFFF) * F.lit(2.0**-20) + low * F.lit(2.0**-52)
    special = F.when(fraction == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    normal = sign * (F.lit(1.0) + fraction) * F.pow(F.lit(2.0), exponent - 1023)
    return F.when(exponent == 2047, special).when(exponent == 0, sign * fraction * F.lit(2.0**-1022)).otherwise(normal)


def little_endian(value: Column, width: int) -> Column:
    """A whole number as ``width`` bytes in two's complement, least significant first; higher bits are cut off."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(_swapped(F.substr(digits, F.lit(17 - 2 * width), F.lit(2 * width)), width))


def big_endian(value: Column, width: int) -> Column:
    """As little_endian, most significant first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.substr(digits, F.lit(17 - 2 * width), F.lit(2 * width)))


def float_bytes(value: Column, width: int, little: bool = True) -> Column:
    """An IEEE single (4) or double (8) as bytes; null for null."""
    kind = ("<" if little else ">") + f"f{width}"

    @F.arrow_udf(T.BinaryType())
    def pack(values: pa.Array) -> pa.Array:
        numbers = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).astype(kind)
        packed = pa.Array.from_buffers(pa.binary(width), len(numbers), [None, pa.py_buffer(numbers.tobytes())]).cast(pa.binary())
        return pc.if_else(values.is_valid(), packed, None)

    return pack(value.cast("double"))


def joined(parts: Column) -> Column:
    """An array of byte strings as one, in time proportional to the whole."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))
