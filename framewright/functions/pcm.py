"""PCM samples: integer and float scales, and byte strings of samples.

Scalars are built-in expressions. Whole packets are converted by Arrow functions over the packets' buffers; there
are expressions for that too (``*_sql``), which need no Python but are slower on long packets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.binary import float_32_of

#: Full scale of the integer formats, by bits.
SCALE = {16: 32768.0, 24: 8388608.0}
DEPTHS = (16, 24, 32)


def normalize_16(sample: Column) -> Column:
    return (sample.cast("double") / SCALE[16]).cast("float")


def normalize_24(shifted: Column) -> Column:
    """``shifted``: the sample times 256, as a 32-bit integer holds it."""
    return (F.shiftright(shifted.cast("int"), 8).cast("double") / SCALE[24]).cast("float")


def _clamped(value: Column, scale: float) -> Column:
    """Scaled, clamped and cut toward zero; NaN is 0."""
    scaled = value.cast("double") * scale
    return F.when(F.isnan(value), F.lit(0)).otherwise(F.greatest(F.least(scaled, F.lit(scale - 1)), F.lit(-scale)).cast("int"))


def denormalize_16(value: Column) -> Column:
    return _clamped(value, SCALE[16])


def denormalize_24(value: Column) -> Column:
    """The sample times 256."""
    return F.shiftleft(_clamped(value, SCALE[24]), 8)


def clamp(value: Column) -> Column:
    """To -1 .. 1; NaN stays."""
    one = F.lit(1.0).cast("float")
    return F.when(F.isnan(value), value).otherwise(F.greatest(F.least(value, one), -one))


def length_error(data: Column, depth: Column) -> Column:
    """What is wrong with a byte string of samples, or null."""
    known = depth.isin(*DEPTHS)
    bad = F.octet_length(data) % F.when(known, (depth / 8).cast("int")).otherwise(1) != 0
    return F.when(~known, F.lit("unsupported bit depth")).when(bad, F.concat(F.lit("invalid pcm"), depth.cast("string"), F.lit(" length")))


def samples_sql(data: Column, depth: int) -> Column:
    """Samples of a byte string as an array: integers for 16 and 24 bits, floats for 32."""
    groups = F.regexp_extract_all(F.hex(data), F.lit("(" + "." * (depth // 4) + ")"), F.lit(1))

    def value(w: Column) -> Column:
        turned = F.concat(*(F.substr(w, F.lit(i), F.lit(2)) for i in range(depth // 4 - 1, 0, -2)))
        bits = F.conv(turned, 16, 10).cast("long")
        if depth == 32:
            return float_32_of(bits)
        return F.when(bits >= 1 << (depth - 1), bits - (1 << depth)).otherwise(bits).cast("int")

    return F.transform(groups, value)


def bytes_16_sql(samples: Column) -> Column:
    """Integers as little-endian 16-bit bytes."""
    return _packed(samples, 16)


def bytes_24_sql(samples: Column) -> Column:
    return _packed(samples, 24)


def _packed(samples: Column, depth: int) -> Column:
    def digits(v: Column) -> Column:
        h = F.lpad(F.hex(v.cast("long").bitwiseAND((1 << depth) - 1)), depth // 4, "0")
        return F.concat(*(F.substr(h, F.lit(i), F.lit(2)) for i in range(depth // 4 - 1, 0, -2)))

    return F.unhex(F.array_join(F.transform(samples, digits), ""))


def decode_array(data: bytes, depth: int) -> np.ndarray:
    """Bytes to 32-bit floats. The length must fit the depth."""
    if depth not in DEPTHS:
        raise ValueError("unsupported bit depth")
    if len(data) % (depth // 8):
        raise ValueError(f"invalid pcm{depth} length")
    if depth == 16:
        return (np.frombuffer(data, "<i2") / SCALE[16]).astype(np.float32)
    if depth == 32:
        return np.frombuffer(data, "<f4")
    b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
    whole = (b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)
    return ((whole >> 8) / SCALE[24]).astype(np.float32)


def encode_array(values: np.ndarray, depth: int) -> bytes:
    if depth not in DEPTHS:
        raise ValueError("unsupported bit depth")
    if depth == 32:
        return np.clip(values, -1, 1).astype("<f4").tobytes()  # NaN stays
    scaled = np.nan_to_num(values.astype(np.float64) * SCALE[depth], nan=0.0, posinf=np.inf, neginf=-np.inf)
    whole = np.trunc(np.clip(scaled, -SCALE[depth], SCALE[depth] - 1)).astype("<i4")
    if depth == 16:
        return whole.astype("<i2").tobytes()
    return np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


@F.arrow_udf(T.ArrayType(T.FloatType()))
def to_floats(data: pa.Array, depth: pa.Array) -> pa.Array:
    """Packets' samples as floats; null where the length or depth is wrong."""
    out = []
    for d, n in zip(data, depth.to_pylist(), strict=True):
        ok = d.is_valid and n in DEPTHS and len(d.as_buffer()) % (n // 8) == 0
        out.append(decode_array(d.as_py(), n) if ok else None)
    return pa.array(out, pa.list_(pa.float32()))


@F.arrow_udf(T.BinaryType())
def from_floats(samples: pa.Array, depth: pa.Array) -> pa.Array:
    out = []
    for s, n in zip(samples, depth.to_pylist(), strict=True):
        ok = s.is_valid and n in DEPTHS
        out.append(encode_array(s.values.to_numpy(zero_copy_only=False), n) if ok else None)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def transcode(data: pa.Array, depth: pa.Array, target: pa.Array) -> pa.Array:
    """Packets in another depth. Equal depths pass bytes on unchanged; what can't be decoded is null."""
    out = []
    for d, n, t in zip(data, depth.to_pylist(), target.to_pylist(), strict=True):
        if not d.is_valid or n not in DEPTHS or t not in DEPTHS:
            out.append(None)
        elif n == t:
            out.append(d.as_py())
        else:
            raw = d.as_py()
            out.append(None if len(raw) % (n // 8) else encode_array(decode_array(raw, n), t))
    return pa.array(out, pa.binary())
