"""Spark data source ``y4m``: raw video with a head of text; a row per frame, or with ``include=header`` per file; and the same to write.

A file's frames have one size, so the n-th begins at a computed byte: a long file is read by many tasks, each of which reads the head and the frames that begin in its
range. Where frames carry parameters of their own and so don't lie at equal distances, a task walks from frame head to frame head, passing
over pictures. Options: path, include (frames or header), range (most bytes of a task, or a 1024th of all if that is more), on_error (fail or skip).

Written rows are path, k, data, width, height, rate_num, rate_den, format, each file's together and in order (``by_file``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framewright.functions.video import picture_size
from framewright.sources.files import filesystem, listed, ranges
from framewright.sources.writer import FolderWriter

HEADER = "path string, name string, width long, height long, rate_num long, rate_den long, format string, frames long, duration double, error string"
FRAMES = "path string, name string, k long, pts long, data binary, width long, height long, rate_num long, rate_den long, format string"
RANGE_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 8 << 20, 8192
MOST_LINE = 4096
# The head's first word, a frame's, and colour spaces; what follows them (as in 420jpeg) says where chroma lies.
MAGIC, FRAME = b"YUV4MPEG2", b"FRAME"
COLOURS = {"420": "YUV420", "422": "YUV422", "444": "YUV444", "mono": "GRAY8"}


class Y4mError(ValueError):
    """A file that can't be read, with the reason as its text."""


@dataclass
class Y4mHead:
    width: int
    height: int
    rate_num: int
    rate_den: int
    format: str
    data_at: int

    @property
    def picture(self) -> int:
        return picture_size(self.format, self.width, self.height)

    @property
    def stride(self) -> int:
        """Bytes from frame to frame, if none has parameters."""
        return len(FRAME) + 1 + self.picture


def read_head(start: bytes) -> Y4mHead:
    """The head of a file's first bytes. Without a colour space it is 4:2:0, without a rate 25 frames a second."""
    line, end, _ = start.partition(b"\n")
    words = line.split(b" ")
    if words[0] != MAGIC:
        raise Y4mError(f"expected {MAGIC.decode()}, found {words[0][:16].decode('utf-8', 'replace')}")
    if not end:
        raise Y4mError("unexpected EOF")
    fields = {w[:1].decode("latin-1"): w[1:].decode("latin-1") for w in words[1:] if w}
    try:
        width, height = int(fields["W"]), int(fields["H"])
        num, den = (int(x) for x in fields.get("F", "25:1").split(":"))
    except (KeyError, ValueError):
        raise Y4mError("bad head") from None
    colour = fields.get("C", "420")
    format = COLOURS.get(colour) or COLOURS.get(colour[:3])
    if format is None or "p1" in colour:
        raise Y4mError(f"colour space {colour} is not supported")
    if width <= 0 or height <= 0 or num <= 0 or den <= 0:
        raise Y4mError("width, height and rate must be positive")
    return Y4mHead(width, height, num, den, format, len(line) + 1)


def _frames(f, head: Y4mHead, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Frames (number, picture) that begin in the range."""
    if (size - head.data_at) % head.stride == 0:
        at = max(0, -(-(start - head.data_at) // head.stride))
        even, held = True, []
        while even and head.data_at + at * head.stride < min(end, size):
            f.seek(head.data_at + at * head.stride)
            raw = f.read(head.stride)
            even = raw[: len(FRAME) + 1] == FRAME + b"\n"
            if even:
                yield at, raw[len(FRAME) + 1 :]
            held.append(at)
            at += 1
        if even:
            return
        if len(held) > 1:
            raise Y4mError(f"frame {held[-1]} is not where it should be")
    k, at = 0, head.data_at
    while at < min(end, size):
        f.seek(at)
        line, found, _ = f.read(MOST_LINE).partition(b"\n")
        if not line.startswith(FRAME) or not found:
            raise Y4mError("expected FRAME" if found else "unexpected EOF")
        if at >= start:
            f.seek(at + len(line) + 1)
            data = f.read(head.picture)
            if len(data) < head.picture:
                raise Y4mError("unexpected EOF")
            yield k, data
        k, at = k + 1, at + len(line) + 1 + head.picture


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.header = options.get("include", "frames") == "header"
        self.skip = options.get("on_error", "fail") == "skip"

    def partitions(self) -> list[InputPartition]:
        if not self.options.get("path"):
            raise ValueError("option path is missing")
        return ranges(listed(self.options["path"].split(","), (".y4m",)), int(self.options.get("range", RANGE_BYTES)), self.header)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, name, size, start, end in partition.files:
            try:
                for row in self._rows(path, name, size, start, end):
                    rows.append(row)
                    held += len(row[4]) if not self.header else 0
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield _batch(rows, _ARROW_HEADER if self.header else _ARROW_FRAMES)
                        rows, held = [], 0
            except Y4mError as e:
                if self.header:
                    rows.append((path, name, *[None] * 7, str(e)))
                elif not self.skip:
                    raise Y4mError(f"{path}: {e}") from e
        if rows:
            yield _batch(rows, _ARROW_HEADER if self.header else _ARROW_FRAMES)

    def _rows(self, path: str, name: str, size: int, start: int, end: int) -> Iterator[tuple]:
        system, place = filesystem(path)
        with system.open_input_file(place) as f:
            head = read_head(f.read(MOST_LINE))
            about = (head.width, head.height, head.rate_num, head.rate_den, head.format)
            if not self.header:
                yield from ((path, name, k, k, data, *about) for k, data in _frames(f, head, size, start, end))
                return
            # Frames at equal distances are counted by the file's size, others one by one.
            whole, rest = divmod(size - head.data_at, head.stride)
            f.seek(head.data_at + max(0, whole - 1) * head.stride)
            even = not rest and (not whole or f.read(len(FRAME) + 1) == FRAME + b"\n")
            n = whole if even else sum(1 for _ in _frames(f, head, size, 0, size))
            yield path, name, *about, n, n * head.rate_den / head.rate_num, None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
_ARROW_FRAMES, _ARROW_HEADER = (pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")]) for ddl in (FRAMES, HEADER))


class _Writer(FolderWriter):
    columns = ("data", "width", "height", "rate_num", "rate_den", "format")

    def head(self, row: dict[str, Any]) -> bytes:
        width, height, num, den, self.format = (row[c].as_py() for c in self.columns[1:])
        colour = {v: k for k, v in COLOURS.items()}.get(self.format)
        if colour is None:
            raise ValueError(f"{row['path']}: {self.format} pictures can't be in a Y4M file")
        self.size, self.name = picture_size(self.format, width, height), row["path"]
        return MAGIC + f" W{width} H{height} F{num}:{den} Ip A1:1 C{colour}\n".encode()

    def body(self, row: dict[str, Any]) -> list[Any]:
        data = row["data"].as_buffer() if row["data"].is_valid else b""
        if len(data) != self.size:
            raise ValueError(f"{self.name}: a picture of {len(data)} bytes, not {self.size}")
        return [FRAME + b"\n", data]


class Y4mSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return HEADER if self.options.get("include", "frames") == "header" else FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Y4mSource)


def by_file(frames: DataFrame) -> DataFrame:
    """Frames, each file's in one task and in order: one shuffle."""
    return frames.repartition("path").sortWithinPartitions("path", "k")


def write_files(frames: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes frames (path, k, data, width, height, rate_num, rate_den, format) below ``folder``."""
    register(frames.sparkSession)
    by_file(frames.select("path", "k", "data", "width", "height", "rate_num", "rate_den", "format")).write.format("y4m").mode(mode).save(folder)
