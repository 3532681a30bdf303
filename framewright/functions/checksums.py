"""Checksums of whole files from those of their parts.

crc32 is linear: a part's checksum, moved by the bytes that follow it, adds (xor) to the file's. Moving by n bytes is a
multiplication by x^(8n) in the field of the checksum's polynomial, and as x has the order 2^32 - 1 there, moving backwards is
one as well. So each part is moved back by where it ends, the parts' values are added up in any order and in as many steps as Spark
likes, and the sum is moved on by the file's length: an aggregate whose state is one number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the polynomial, its lowest bit first.
POLYNOMIAL = 0xEDB88320
ORDER = 2**32 - 1


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials, whose highest bit is the power 0."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for _ in range(32):
        out ^= np.where(a & np.uint64(1 << 31), b, np.uint64(0))
        a = (a << np.uint64(1)) & np.uint64(ORDER)
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(POLYNOMIAL), b >> np.uint64(1))
    return out


def _powers() -> np.ndarray:
    """x^(2^i) for i below 32."""
    out = [np.array([1 << 30], np.uint64)]
    for _ in range(31):
        out.append(_times(out[-1], out[-1]))
    return np.concatenate(out)


_POWERS = _powers()


def moved_by(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums of parts that ``n`` bytes follow; negative n moves back."""
    left, out = ((n.astype(object) * 8) % ORDER).astype(np.uint64), crc.astype(np.uint64)
    for i in range(32):
        odd = left >> np.uint64(i) & np.uint64(1) == 1
        if odd.any():
            out[odd] = _times(out[odd], np.full(int(odd.sum()), _POWERS[i], np.uint64))
    return out


@F.arrow_udf(T.LongType())
def moved(crc: pa.Array, n: pa.Array) -> pa.Array:
    """``moved_by`` of columns; null where one is."""
    at, by = (x.fill_null(0).to_numpy(zero_copy_only=False) for x in (crc, n))
    none = np.asarray(crc.is_null()) | np.asarray(n.is_null())
    return pa.array(moved_by(at, by).astype(np.int64), pa.int64(), mask=none)
