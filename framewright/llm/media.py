"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, stored as NPY tiles with difference hashes.

Images are decoded to arrays of shape (height, width) or (height, width, 3), 8-bit. Resizing averages the
source area under each target pixel, read off an integral image, so its cost doesn't depend on the factor.
A tile is the array in the NPY format (version 1.0). Its difference hash compares neighbours in a 9 x 8 grey
version. Bytes that are no image of these formats give null, not an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.names import col
from framewright.llm.store import stored

#: Payloads are padded with this byte to a positive multiple of UNIT and laid out in rows of WIDTH samples.
PAD, UNIT, WIDTH = 255, 576, 24
HASH_W, HASH_H = 9, 8
_TOKEN = rb"(?:\s|#[^\n]*\n)+"
_NETPBM = re.compile(rb"P([1-6])" + _TOKEN + rb"(\d{1,9})" + _TOKEN + rb"(\d{1,9})(?:" + _TOKEN + rb"(\d{1,5}))?")


def decode_netpbm(data: bytes) -> np.ndarray | None:
    """PBM, PGM and PPM, plain and raw; samples of more than 8 bits are scaled to 8. Null if malformed."""
    found = _NETPBM.match(data)
    if not found:
        return None
    kind, w, h = int(found[1]), int(found[2]), int(found[3])
    bits = kind in (1, 4)
    if bits:
        end = found.end(3)
        top = 1
    elif found[4] is None:
        return None
    else:
        end, top = found.end(4), int(found[4])
    if not w or not h or not 0 < top < 65536:
        return None
    depth = 3 if kind in (3, 6) else 1
    shape = (h, w, 3) if depth == 3 else (h, w)
    body = data[end + 1 :]
    if kind <= 3:
        plain = re.sub(rb"#[^\n]*", b" ", body)
        found_values = re.findall(rb"[01]" if bits else rb"\d+", plain)
        if len(found_values) < w * h * depth:
            return None
        values = np.array(found_values[: w * h * depth], dtype=np.int64)
    elif bits:
        row = (w + 7) // 8
        if len(body) < row * h:
            return None
        values = np.unpackbits(np.frombuffer(body, np.uint8, row * h).reshape(h, row), axis=1)[:, :w].ravel().astype(np.int64)
    else:
        kind_of = np.dtype(">u2" if top > 255 else np.uint8)
        if len(body) < w * h * depth * kind_of.itemsize:
            return None
        values = np.frombuffer(body, kind_of, w * h * depth)
        if top == 255:
            return values.reshape(shape)
        values = values.astype(np.int64)
    if values.max(initial=0) > top:
        return None
    if bits:
        values = 1 - values  # in PBM a 1 is black
    return ((values * 255 + top // 2) // top).astype(np.uint8).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray | None:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits, rows from the bottom or the top. Null if malformed."""
    if len(data) < 54 or data[:2] != b"BM":
        return None
    offset, header, w, h, planes, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    rows = abs(h)
    if header < 40 or w <= 0 or not rows or planes != 1 or packing or bits not in (8, 24, 32):
        return None
    stride = (w * bits // 8 + 3) // 4 * 4
    if len(data) < offset + stride * rows:
        return None
    grid = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)[:, : w * bits // 8]
    if h > 0:
        grid = grid[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        if n > 256 or len(data) < 14 + header + 4 * n or grid.max(initial=0) >= n:
            return None
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + header).reshape(n, 4)[:, 2::-1]
        return palette[grid]
    return grid.reshape(rows, w, bits // 8)[:, :, 2::-1]


def decode_image(data: bytes | None) -> np.ndarray | None:
    if not data:
        return None
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def npy_bytes(array: np.ndarray) -> bytes:
    head = "{'descr': '|u1', 'fortran_order': False, 'shape': (%s), }" % ", ".join(map(str, array.shape))
    fill = -(10 + len(head) + 1) % 64
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head) + fill + 1) + head.encode() + b" " * fill + b"\n" + array.tobytes()


def npy_array(data: bytes) -> np.ndarray:
    if data[:8] != b"\x93NUMPY\x01\x00":
        raise ValueError("not an NPY tile of version 1.0")
    n = struct.unpack_from("<H", data, 8)[0]
    shape = re.search(rb"'shape': \(([\d, ]+)\)", data[10 : 10 + n])
    if shape is None or b"'|u1'" not in data[10 : 10 + n]:
        raise ValueError("not a tile of 8-bit samples")
    return np.frombuffer(data, np.uint8, offset=10 + n).reshape([int(x) for x in shape[1].split(b",") if x.strip()])


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * (n / parts)
    whole = np.minimum(at.astype(np.int64), n - 1)
    return whole, at - whole


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the source areas under the target's pixels, as doubles. Grey or colour."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], width, height) for c in range(image.shape[2])], axis=2)
    h, w = image.shape
    (y, fy), (x, fx) = _edges(h, height), _edges(w, width)
    # The integral image's rows at the target's edges only: sums of whole rows between them, plus shares.
    total = np.zeros((h + 1, w + 1))
    np.cumsum(image, axis=0, dtype=np.float64, out=total[1:, 1:])
    rows = total[y, 1:] + fy[:, None] * image[y]
    along = np.zeros((height + 1, w + 1))
    np.cumsum(rows, axis=1, out=along[:, 1:])
    sums = along[:, x] + fx * rows[:, x]
    return np.diff(np.diff(sums, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 points of the grey 9 x 8 version is brighter than its right neighbour."""
    small = area_resize(image, HASH_W, HASH_H)
    if small.ndim == 3:
        small = small @ np.array([0.299, 0.587, 0.114])
    # Rounding makes equal means equal whatever the order of the sums.
    small = np.round(small, 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def tiles(df: DataFrame, content: str, tile: tuple[int, int] | None = None) -> DataFrame:
    """``df`` with media_width, media_height, media_channels, tile (NPY bytes), dhash.

    ``tile`` (width, height) resizes; without it the tile has the image's own samples. Null content and
    content that can't be decoded give nulls. An existing column of such a name is replaced, all others stay.
    """
    schema = "media_width int, media_height int, media_channels int, tile binary, dhash string"

    @F.pandas_udf(schema)
    def decode(contents):
        import pandas as pd

        out = []
        for data in contents:
            image = decode_image(bytes(data)) if data is not None else None
            if image is None:
                out.append((None,) * 5)
                continue
            small = image if tile is None else np.round(area_resize(image, *tile)).astype(np.uint8)
            out.append((image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, npy_bytes(small), difference_hash(image)))
        return pd.DataFrame(out, columns=["media_width", "media_height", "media_channels", "tile", "dhash"], dtype=object)

    own = "__media"
    while own in df.columns:
        own += "_"
    df = df.withColumn(own, decode(col(content)))
    return df.withColumns({c.split()[0]: F.col(f"{own}.{c.split()[0]}") for c in schema.split(", ")}).drop(own)


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * ((-len(text)) % UNIT or (0 if text else UNIT))


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as a grey Netpbm image, decoded and kept as an NPY tile."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, media = [], []
                for t in part.column("text").cast(pa.binary()):
                    raw = t.as_py() or b""
                    image = decode_image(encode_pgm(np.frombuffer(payload_of(raw), np.uint8).reshape(-1, WIDTH)))
                    sizes.append(len(raw))
                    media.append(npy_bytes(image))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    return slim.mapInArrow(store, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_digests(media: DataFrame) -> DataFrame:
    """Reads tiles (doc_id, n_bytes, media) back: what they hold and their difference hash."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for m in part.column("media"):
                    data = m.as_py()
                    image = npy_array(data)
                    payload = image.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image)))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                arrays = [part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as a tile in a Parquet table of the shared folder, reads it back and digests it.

    A null text is an empty one: one unit of padding. Rows with a null or repeated id are rows like any
    other; equal texts give equal values. A long text is one image, of as many rows as it needs, held whole by its task.
    An empty table gives an empty result. Other columns aren't read.
    """
    return media_digests(stored(text_media(docs, doc_id, text), "media"))

