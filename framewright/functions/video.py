"""Pictures as bytes: planes, colours and frame rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Divisors of the chroma planes' width and height, by format; a grey picture has none.
CHROMA = {"YUV420": (2, 2), "YUV422": (2, 1), "YUV444": (1, 1), "GRAY8": None}


def plane_sizes(format: str, width: int, height: int) -> tuple[int, int]:
    """Bytes of the luma plane and of each chroma plane; odd sizes round up."""
    by = CHROMA[format]
    return width * height, (-(-width // by[0])) * (-(-height // by[1])) if by else 0


def picture_size(format: str, width: int, height: int) -> int:
    luma, chroma = plane_sizes(format, width, height)
    return luma + 2 * chroma


def planes(data: Column, format: Column, width: Column, height: Column) -> Column:
    """A struct of y, u and v; null where the bytes aren't a whole picture of the format, u and v empty for grey ones."""
    wide = F.when(format == "YUV444", width).otherwise(F.floor((width + 1) / 2))
    high = F.when(format == "YUV420", F.floor((height + 1) / 2)).otherwise(height)
    luma, chroma = width * height, F.when(format == "GRAY8", F.lit(0).cast("long")).otherwise(wide * high)
    cut = lambda at, n: F.substr(data, (at + 1).cast("int"), n.cast("int"))
    whole = format.isin(*CHROMA) & (F.octet_length(data) == luma + 2 * chroma)
    return F.when(whole, F.struct(cut(F.lit(0), luma).alias("y"), cut(luma, chroma).alias("u"), cut(luma + chroma, chroma).alias("v")))


def _picture(data: bytes, format: str, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma and both chroma planes, these brought to the luma's size by repeating."""
    luma, chroma = plane_sizes(format, width, height)
    raw = np.frombuffer(data, np.uint8)
    y = raw[:luma].reshape(height, width)
    if not chroma:
        grey = np.full_like(y, 128)
        return y, grey, grey
    by = CHROMA[format]
    full = lambda p: np.repeat(np.repeat(p.reshape(-(-height // by[1]), -(-width // by[0])), by[1], axis=0), by[0], axis=1)[:height, :width]
    return y, full(raw[luma : luma + chroma]), full(raw[luma + chroma : luma + 2 * chroma])


def rgb_of(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whole-number BT.601 with the luma from 16 to 235."""
    c, d, e = y.astype(np.int32) - 16, u.astype(np.int32) - 128, v.astype(np.int32) - 128
    parts = (298 * c + 409 * e + 128, 298 * c - 100 * d - 208 * e + 128, 298 * c + 516 * d + 128)
    return np.stack([np.clip(p >> 8, 0, 255) for p in parts], axis=-1).astype(np.uint8)


def _each(data: pa.Array, *columns: pa.Array, work) -> pa.Array:
    out = []
    for d, *x in zip(data, *(c.to_pylist() for c in columns), strict=True):
        format, width, height = x[:3]
        ok = d.is_valid and None not in x and format in CHROMA and width > 0 and height > 0 and len(d.as_buffer()) == picture_size(format, width, height)
        out.append(work(d.as_py(), *x) if ok else None)
    return pa.array(out, pa.binary())


@F.arrow_udf(T.BinaryType())
def yuv_to_rgb(data: pa.Array, format: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Planar pictures as RGB24, row by row; null where the bytes aren't a whole picture."""
    return _each(data, format, width, height, work=lambda d, f, w, h: rgb_of(*_picture(d, f, w, h)).tobytes())


def area_scaled(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """A plane in another size: each new value the mean, rounded half up, of the area that it covers, parts of values by their share."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        """Sums over n equal parts of the last axis, in units of 1 / n of a value: whole numbers."""
        size = x.shape[-1]
        total = np.concatenate([np.zeros((*x.shape[:-1], 1), np.int64), np.cumsum(x.astype(np.int64), axis=-1)], axis=-1)
        at, rest = np.divmod(np.arange(n + 1) * size, n)
        ends = total[..., at] * n + rest * x[..., np.minimum(at, size - 1)]
        return np.diff(ends, axis=-1)

    total = along(along(plane, width).swapaxes(0, 1), height).swapaxes(0, 1)
    area = plane.shape[0] * plane.shape[1]
    return ((2 * total + area) // (2 * area)).astype(np.uint8)


@F.arrow_udf(T.BinaryType())
def scaled(data: pa.Array, format: pa.Array, width: pa.Array, height: pa.Array, to_width: pa.Array, to_height: pa.Array) -> pa.Array:
    """Planar pictures in another size, each plane by areas; null where the bytes aren't a whole picture or a size isn't positive."""

    def work(d: bytes, f: str, w: int, h: int, w2: int, h2: int) -> bytes | None:
        if w2 <= 0 or h2 <= 0:
            return None
        luma, chroma = plane_sizes(f, w, h)
        raw, by = np.frombuffer(d, np.uint8), CHROMA[f]
        out = [area_scaled(raw[:luma].reshape(h, w), w2, h2)]
        if by:
            wide, high = -(-w // by[0]), -(-h // by[1])
            out += [area_scaled(raw[at : at + chroma].reshape(high, wide), -(-w2 // by[0]), -(-h2 // by[1])) for at in (luma, luma + chroma)]
        return b"".join(x.tobytes() for x in out)

    return _each(data, format, width, height, to_width, to_height, work=work)


@F.arrow_udf(T.BinaryType())
def adjusted(data: pa.Array, format: pa.Array, width: pa.Array, height: pa.Array, brightness: pa.Array, contrast: pa.Array) -> pa.Array:
    """Pictures whose luma is moved: (y - 128) * contrast + 128 * brightness, cut to a whole number and to 0 .. 255; colours stay."""

    def work(d: bytes, f: str, w: int, h: int, b: float, c: float) -> bytes:
        table = np.clip(np.trunc((np.arange(256) - 128) * float(c) + 128 * float(b)), 0, 255).astype(np.uint8)
        return table[np.frombuffer(d, np.uint8, w * h)].tobytes() + d[w * h :]

    return _each(data, format, width, height, brightness, contrast, work=work)


def convert_fps(frames: DataFrame, rate: tuple[Column, Column], target: tuple[int, int], k: str = "k") -> DataFrame:
    """Frames at ``target`` (frames, seconds) a second: each new frame shows the one that is on at its time. Adds ``source_k``, the frame it was.

    Frame m of the target is at m / target seconds, so a frame is shown by every m from its own time on to the next one's: its
    copies follow from its number, nothing moves and no frame looks at another. Frames with a rate that isn't positive go.
    """
    to, per = target
    if to <= 0 or per <= 0:
        raise ValueError("a frame rate must be positive")
    num, den = (x.cast("long") for x in rate)
    # m * (num * per) / (den * to) has the whole part k.
    up, down = den * to, num * per
    first = lambda x: F.floor((x * up + down - 1).cast("decimal(38,0)") / down).cast("long")
    rows = frames.filter((num > 0) & (den > 0)).withColumnRenamed(k, "source_k")
    start, stop = first(F.col("source_k")), first(F.col("source_k") + 1)
    return rows.withColumn(k, F.explode(F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))))
