"""Spark data sources ``wav`` and ``rawpcm``: rows of packets, or with ``include=header`` rows of files; and the same to write.

Reading: partitions are planned from the listing alone: small files are packed together, a long one is cut into ranges
of its bytes. A task reads the heads of its files and gives the packets that begin in its range; pts comes from the
offset, and a file's first packet has its metadata. Options: path (a file, folder or pattern), include (packets or header), limit (most bytes of a packet), range
(most bytes of a task), on_error (fail or skip: leave out files that can't be read; in header mode bad files are
always rows with an error). rawpcm also takes channels, sample_rate and depth, 2, 44100 and 16 if not given.

Writing (``df.write.format("wav").mode("append").save(folder)``) puts packets (path, k, data, channels, sample_rate,
bit_depth, file_size[, metadata]) into a file per path, below the folder under that very path. ``by_file`` brings packets
into the order that this needs: a file's packets stand in one task, one after another. They stream through it; the size
is known before the head is written, so nothing is patched; metadata goes behind the data. Files get their names when the
job is done; a failed job leaves none. Existing files are an error, with ``mode("overwrite")`` they are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framewright.functions.formats import INFO_TAGS, header_of, list_chunk_of
from framewright.operators.packets import PACKET_BYTES
from framewright.sources.files import filesystem, listed, ranges, sizes
from framewright.sources.riff import ADPCM, FLOAT, PCM, WavError, WavHead, read_head
from framewright.sources.writer import FolderWriter

PACKETS = "path string, name string, k long, data binary, size long, pts long, channels int, sample_rate long, bit_depth int, format_code int, block_size int, data_size long, frames long, metadata map<string,string>"
HEADER = "path string, name string, channels int, sample_rate long, bit_depth int, format_code int, data_size long, frames long, duration double, codec string, supported boolean, metadata map<string,string>, error string"
RANGE_BYTES = 64 << 20
#: Bytes of packets, and rows, handed to Spark at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 8192
#: A file's first bytes that are read at once.
HEAD_BYTES = 4096
MOST_BYTES = 2**32 - 2**16
_CODEC = {24: "pcm_s24le", 32: "pcm_f32le"}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], raw: bool) -> None:
        self.options, self.raw = options, raw
        self.header = options.get("include", "packets") == "header"
        self.limit = int(options.get("limit", PACKET_BYTES))
        self.skip = options.get("on_error", "fail") == "skip"

    def _head(self, f: pa.NativeFile, size: int) -> WavHead:
        if not self.raw:
            return read_head(_reads(f), size)
        depth = int(self.options.get("depth", 16))
        head = WavHead(int(self.options.get("channels", 2)), int(self.options.get("sample_rate", 44100)), depth, FLOAT if depth == 32 else PCM, 0, size)
        if head.error():
            raise WavError(head.error())
        return head

    def partitions(self) -> list[InputPartition]:
        path = self.options.get("path")
        if not path:
            raise ValueError("option path is missing")
        return ranges(listed(path.split(","), (".raw", ".pcm") if self.raw else (".wav",)), int(self.options.get("range", RANGE_BYTES)), self.header)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held, schema = [], 0, _ARROW_HEADER if self.header else _ARROW_PACKETS
        for row in self._rows(partition):
            rows.append(row)
            held += 0 if self.header else len(row[3])
            if held >= BATCH_BYTES or len(rows) == BATCH_ROWS:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    def _rows(self, partition: InputPartition) -> Iterator[tuple]:
        for path, name, size, start, end in partition.files:
            with _opened(path) as f:
                if self.header:
                    yield self._header_row(f, path, name, size)
                    continue
                try:
                    head = self._head(f, size)
                except WavError as e:
                    if self.skip:
                        continue
                    raise WavError(f"{path}: {e}") from e
                packet = max(head.block, self.limit - self.limit % head.block)
                # Packets that begin in the range; what is before the data counts as its first byte.
                first, last = (-(-max(0, at - head.data_at) // packet) for at in (start if start else 0, end))
                for k, part in _parts(f, head, packet, first, min(last, -(-head.data_size // packet))):
                    about = list(head.metadata.items()) if k == 0 else None
                    yield path, name, k, part, len(part), head.frames_in(k * packet), head.channels, head.sample_rate, head.bit_depth, head.format_code, head.block, head.data_size, head.frames_in(head.data_size), about

    def _header_row(self, f: pa.NativeFile, path: str, name: str, size: int) -> tuple:
        try:
            h = self._head(f, size)
        except WavError as e:
            return (path, name, *[None] * 8, False, [], str(e))
        frames = h.frames_in(h.data_size)
        return (path, name, h.channels, h.sample_rate, h.bit_depth, h.format_code, h.data_size, frames, frames / h.sample_rate, "adpcm_ima_wav" if h.format_code == ADPCM else _CODEC.get(h.bit_depth, "pcm_s16le"), h.supported, list(h.metadata.items()), None)


def _opened(path: str) -> pa.NativeFile:
    system, at = filesystem(path)
    return system.open_input_file(at)


def _reads(f: pa.NativeFile) -> Callable[[int, int], bytes]:
    """``read(at, n)`` of a file whose first bytes are fetched in one go."""
    start = f.read(HEAD_BYTES)
    return lambda at, n: start[at : at + n] if at + n <= len(start) else (f.seek(at), f.read(n))[1]


def _parts(f: pa.NativeFile, head: WavHead, packet: int, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    if first < last:
        f.seek(head.data_at + first * packet)
        for k in range(first, last):
            yield k, f.read(min(packet, head.data_size - k * packet))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_TEXTS = pa.map_(pa.string(), pa.string())
_ARROW_PACKETS = pa.schema([("path", pa.string()), ("name", pa.string()), ("k", pa.int64()), ("data", pa.binary()), ("size", pa.int64()), ("pts", pa.int64()), ("channels", pa.int32()), ("sample_rate", pa.int64()), ("bit_depth", pa.int32()), ("format_code", pa.int32()), ("block_size", pa.int32()), ("data_size", pa.int64()), ("frames", pa.int64()), ("metadata", _TEXTS)])
_ARROW_HEADER = pa.schema([("path", pa.string()), ("name", pa.string()), ("channels", pa.int32()), ("sample_rate", pa.int64()), ("bit_depth", pa.int32()), ("format_code", pa.int32()), ("data_size", pa.int64()), ("frames", pa.int64()), ("duration", pa.float64()), ("codec", pa.string()), ("supported", pa.bool_()), ("metadata", _TEXTS), ("error", pa.string())])


class _Writer(FolderWriter):
    columns = ("data", "channels", "sample_rate", "bit_depth", "file_size", "metadata")

    def __init__(self, options: dict[str, str], raw: bool, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.raw, self.name, self.left, self.last = raw, "", 0, b""

    def head(self, row: dict[str, Any]) -> bytes:
        self.name, self.left, self.last = row["path"], row["file_size"].as_py(), b""
        if self.raw:
            return b""
        if self.left >= MOST_BYTES:
            raise ValueError(f"{self.name}: a WAV file can't hold 4 GiB")
        chunk = list_chunk_of(dict(row["metadata"].as_py() or []))
        self.last = b"\0" * (self.left % 2) + chunk
        return header_of(row["channels"].as_py(), row["sample_rate"].as_py(), row["bit_depth"].as_py(), self.left, len(chunk))

    def body(self, row: dict[str, Any]) -> list[Any]:
        data = row["data"].as_buffer()
        self.left -= len(data)
        return [data]

    def tail(self) -> bytes:
        if self.left:
            raise ValueError(f"{self.name}: {self.left} bytes of its packets are missing; bring packets into order with by_file")
        return self.last


class WavSource(DataSource):
    raw = False

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return HEADER if self.options.get("include", "packets") == "header" else PACKETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), self.raw)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), self.raw, overwrite)


class RawPcmSource(WavSource):
    raw = True

    @classmethod
    def name(cls) -> str:
        return "rawpcm"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
    spark.dataSource.register(RawPcmSource)


def by_file(packets: DataFrame) -> DataFrame:
    """Packets (path, k, data, ...) with file_size, each file's in one task and in order: one shuffle, and one of sizes unless they are there."""
    if "file_size" in packets.columns:
        return packets.repartition("path").sortWithinPartitions("path", "k")
    totals = packets.groupBy(F.col("path").alias("of")).agg(F.sum(F.octet_length("data").cast("long")).alias("file_size"))
    sized = packets.join(totals, F.col("path") == F.col("of")).drop("of")
    return sized.repartition("path").sortWithinPartitions("path", "k")


def write_files(packets: DataFrame, folder: str, container: str = "wav", mode: str = "append") -> DataFrame:
    """Writes packets (path, k, data, channels, sample_rate, bit_depth[, metadata]) below ``folder``; gives path and size of its files.

    Nulls in ``data`` are left out; a file without bytes isn't written. A column file_size, the bytes of all of a file's packets, saves adding
    them up, for which packets are made a second time.
    """
    if container not in ("wav", "raw", "pcm"):
        raise ValueError(f"unsupported '{container}' format")
    columns = [c for c in ("path", "k", "data", "channels", "sample_rate", "bit_depth", "file_size", "metadata") if c in packets.columns]
    register(packets.sparkSession)
    by_file(packets.select(*columns).filter("octet_length(data) > 0")).write.format("wav" if container == "wav" else "rawpcm").mode(mode).save(folder)
    return sizes(packets.sparkSession, folder)


def renamed(path: str, extension: str) -> F.Column:
    """A column of paths with another extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("." + extension))


def convert(spark: SparkSession, source: str, folder: str, container: str = "wav", depth: int | None = None, source_format: str = "wav", **options: str) -> DataFrame:
    """Converts a file, folder or pattern: read, transcode, mux, write. Gives path and size of the files of ``folder``.

    A file keeps its place below the source folder. Two files that would get one name are an error, and so are files
    that exist, and samples that can't be decoded; nothing is written then. Empty files have no packets and no output.
    """
    from framewright.functions import adpcm, pcm

    register(spark)
    heads = spark.read.format(source_format).options(path=source, include="header", **options).load()
    named = heads.groupBy(renamed("name", container).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"), F.max("path").alias("other")).filter("n > 1").limit(1).collect()
    if named:
        raise ValueError(f"{named[0]['one']} and {named[0]['other']} would both be {named[0]['target']}")
    packets = spark.read.format(source_format).options(path=source, **options).load().withColumn("path", renamed("name", container))
    # A file's size follows from its head, so nothing is read or decoded twice.
    packets = packets.withColumn("file_size", F.col("data_size") if depth is None else F.col("frames") * F.col("channels") * (depth // 8))
    if depth is not None:
        # ADPCM is 16-bit PCM once decoded; its packets hold whole blocks.
        coded = F.col("bit_depth") == 4
        if source_format == "wav":
            plain = F.when(coded, adpcm.to_pcm16(F.when(coded, F.col("data")), "channels", "block_size")).otherwise(F.col("data"))
            packets = packets.withColumns({"data": plain, "bit_depth": F.when(coded, 16).otherwise(F.col("bit_depth"))})
        wrong = F.coalesce(pcm.length_error(F.col("data"), F.col("bit_depth")), F.when(F.col("data").isNull(), "invalid adpcm block"))
        data = F.when(wrong.isNull(), pcm.transcode("data", "bit_depth", F.lit(depth))).otherwise(F.raise_error(F.concat("name", F.lit(": "), wrong)))
        packets = packets.withColumns({"data": data, "bit_depth": F.lit(depth)})
    return write_files(packets, folder, container)
