"""IMA ADPCM: four bits a sample, the change against a predicted value in steps whose size follows the changes.

The predictor and the step's index are carried from sample to sample within a block, and a block states its own start:
for each channel the first sample (16 bits), the index and a zero byte. Then come groups of four bytes a channel in turn (with one
channel simply bytes), the low half of a byte first. So blocks don't depend on each other: a batch's blocks are decoded side
by side, one numpy step for the i-th sample of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sizes of steps by index, and what a code's low three bits add to the index.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)

_STEPS, _MOVES = np.array(STEPS, np.int32), np.array(INDEX_STEPS, np.int32)
#: Codes of a group, and its bytes, a channel.
GROUP, GROUP_BYTES = 8, 4


def _moved(value: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next value and index after a code."""
    step = _STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
    return value, np.clip(index + _MOVES[code & 7], 0, len(STEPS) - 1)


def _code(value: np.ndarray, index: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The code whose change comes nearest to ``wanted`` from below."""
    step, gap = _STEPS[index], wanted - value
    code, gap = np.where(gap < 0, 8, 0), np.abs(gap)
    for bit in (4, 2, 1):
        more = gap >= step
        code, gap, step = code | np.where(more, bit, 0), np.where(more, gap - step, gap), step >> 1
    return code


def unpacked(data: np.ndarray, channels: int) -> np.ndarray:
    """Blocks (rows of bytes after their heads) as codes (block, sample, channel)."""
    codes = np.stack([data & 15, data >> 4], axis=-1).reshape(len(data), -1)
    if channels == 1:
        return codes[:, :, None]
    whole = codes.shape[1] // (GROUP * channels) * GROUP * channels
    return codes[:, :whole].reshape(len(data), -1, channels, GROUP).transpose(0, 1, 3, 2).reshape(len(data), -1, channels)


def packed(codes: np.ndarray) -> np.ndarray:
    """The bytes of codes (block, sample, channel); what is missing in the last group, or byte, is code 0."""
    blocks, n, channels = codes.shape
    group = GROUP if channels > 1 else 2
    codes = np.pad(codes, ((0, 0), (0, -n % group), (0, 0)))
    flat = codes.reshape(blocks, -1, group, channels).transpose(0, 1, 3, 2).reshape(blocks, -1)
    return (flat[:, 0::2] | flat[:, 1::2] << 4).astype(np.uint8)


def decode_blocks(blocks: np.ndarray, channels: int) -> np.ndarray:
    """Blocks of equal size (rows of bytes) as samples (block, sample, channel), 16 bits."""
    head = np.ascontiguousarray(blocks[:, : 4 * channels]).reshape(-1, channels, 4)
    value = head[:, :, :2].copy().view("<i2")[:, :, 0].astype(np.int32)
    index = np.minimum(head[:, :, 2], len(STEPS) - 1).astype(np.int32)
    codes = unpacked(blocks[:, 4 * channels :], channels)
    out = np.empty((len(blocks), codes.shape[1] + 1, channels), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[1]):
        value, index = _moved(value, index, codes[:, i].astype(np.int32))
        out[:, i + 1] = value
    return out


def encode_blocks(samples: np.ndarray) -> np.ndarray:
    """Blocks of samples (block, sample, channel) as rows of bytes. A block begins with the step nearest to its first change from below."""
    blocks, n, channels = samples.shape
    wanted = samples.astype(np.int32)
    value = wanted[:, 0]
    first = np.abs(wanted[:, 1] - value) if n > 1 else np.zeros_like(value)
    index = np.maximum(np.searchsorted(_STEPS, first, side="right") - 1, 0).astype(np.int32)
    head = np.zeros((blocks, channels, 4), np.uint8)
    head[:, :, :2] = np.ascontiguousarray(value.astype("<i2")).view(np.uint8).reshape(blocks, channels, 2)
    head[:, :, 2] = index
    codes = np.zeros((blocks, n - 1, channels), np.uint8)
    for i in range(1, n):
        code = _code(value, index, wanted[:, i])
        codes[:, i - 1] = code
        value, index = _moved(value, index, code)
    return np.concatenate([head.reshape(blocks, -1), packed(codes)], axis=1)


def _by_shape(keys: list) -> dict:
    """Places of equal keys; a null key has none."""
    out: dict = {}
    for i, k in enumerate(keys):
        if k is not None:
            out.setdefault(k, []).append(i)
    return out


def _decoded(data: list[bytes | None], channels: list[int | None], block: list[int | None]) -> list[np.ndarray | None]:
    """Samples (sample, channel) of packets of blocks; null for one that a block's head doesn't fit, or without channels."""
    parts: list[list] = [[] for _ in data]
    bad, shapes = set(), []
    for i, (d, ch, size) in enumerate(zip(data, channels, block, strict=True)):
        if d is None or not ch or not size or size <= 4 * ch or 0 < len(d) % size < 4 * ch:
            bad.add(i)
            continue
        shapes += [(i, at, min(size, len(d) - at), ch) for at in range(0, len(d), size)]
    for (size, ch), places in _by_shape([(size, ch) for _, _, size, ch in shapes]).items():
        rows = np.stack([np.frombuffer(data[shapes[p][0]], np.uint8, size, shapes[p][1]) for p in places])
        for p, samples in zip(places, decode_blocks(rows, ch), strict=True):
            parts[shapes[p][0]].append((shapes[p][1], samples))
    return [None if i in bad else np.concatenate([s for _, s in sorted(x, key=lambda y: y[0])]) if x else np.zeros((0, channels[i]), np.int16) for i, x in enumerate(parts)]


@F.arrow_udf(T.BinaryType())
def to_pcm16(data: pa.Array, channels: pa.Array, block: pa.Array) -> pa.Array:
    """Packets of whole ADPCM blocks (the last may be shorter) as 16-bit PCM; null where a block is cut off within its head."""
    found = _decoded([d.as_py() for d in data], channels.to_pylist(), block.to_pylist())
    return pa.array([None if x is None else x.astype("<i2").tobytes() for x in found], pa.binary())


@F.arrow_udf(T.BinaryType())
def from_pcm16(data: pa.Array, channels: pa.Array, block: pa.Array) -> pa.Array:
    """16-bit PCM packets as ADPCM blocks of ``block`` bytes; the last one is as short as its samples allow.

    A packet begins a block, so packets that aren't a file's last should hold whole ones. Null where the length isn't one of whole frames.
    """
    raw, ch, size = [d.as_py() for d in data], channels.to_pylist(), block.to_pylist()
    ok = [d is not None and c and s and s > 4 * c and len(d) % (2 * c) == 0 for d, c, s in zip(raw, ch, size, strict=True)]
    shapes, parts = [], [[] for _ in raw]
    for i, good in enumerate(ok):
        if good:
            per, n = frames_of(size[i], ch[i]), len(raw[i]) // (2 * ch[i])
            shapes += [(i, at, min(per, n - at), ch[i]) for at in range(0, n, per)]
    for (n, c), places in _by_shape([(n, c) for _, _, n, c in shapes]).items():
        rows = np.stack([np.frombuffer(raw[shapes[p][0]], "<i2", n * c, shapes[p][1] * 2 * c).reshape(n, c) for p in places])
        for p, block_bytes in zip(places, encode_blocks(rows), strict=True):
            parts[shapes[p][0]].append((shapes[p][1], block_bytes.tobytes()))
    return pa.array([b"".join(x for _, x in sorted(p)) if good else None for good, p in zip(ok, parts, strict=True)], pa.binary())


def frames_of(block: int, channels: int) -> int:
    """Samples a channel in a block of so many bytes; a block without a whole head has none."""
    if block < 4 * channels:
        return 0
    group = GROUP_BYTES * channels if channels > 1 else 1
    return 1 + (block - 4 * channels) // group * (GROUP if channels > 1 else 2)
