"""Structured Streaming over folders of raw PCM and WAV files and over packet events.

pts comes from the offset in the file, so a file's packets need no state, whatever batch they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import packets as pk
from framewright.sources.riff import WavError, read_head


def packet_stream(spark: SparkSession, folder: str, depth: int = 16, channels: int = 2, limit: int = pk.PACKET_BYTES, files_per_trigger: int = 1000) -> DataFrame:
    """path, k, data, size, pts of new raw PCM files."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return pk.packetize(files, "content", F.lit(depth), F.lit(channels), limit, ("path",))


def pcm_stream(packets: DataFrame, depth: int, target: int) -> DataFrame:
    """Packets of a stream in another depth."""
    return pk.transcode(packets, F.lit(depth), F.lit(target))


def windowed_sizes(events: DataFrame, time: str = "ts", size: str = "size", key: str = "stream_id", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes a stream and window; with a watermark, so that closed windows leave the state."""
    w = F.window(F.col(time), window)
    per = events.withWatermark(time, late).groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n_packets"), F.sum(size).alias("n_bytes"))
    return per.select(F.col("w.start").alias("start"), key, "n_packets", "n_bytes")


def wav_stream(spark: SparkSession, folder: str, limit: int = pk.PACKET_BYTES, files_per_trigger: int = 1000, on_error: str = "fail") -> DataFrame:
    """path, k, data, size, pts, channels, sample_rate, bit_depth, format_code of new WAV files; as the source ``wav`` reads them.

    With ``on_error`` "skip" files that can't be read are left out. A file is read whole by its task.
    """
    schema = "path string, k long, data binary, size long, pts long, channels int, sample_rate long, bit_depth int, format_code int"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                try:
                    head = read_head(lambda at, n, raw=raw: raw[at : at + n], len(raw))
                except WavError as e:
                    if on_error == "skip":
                        continue
                    raise WavError(f"{path}: {e}") from e
                step = max(head.block, limit - limit % head.block)
                parts = [raw[head.data_at + a : head.data_at + min(a + step, head.data_size)] for a in range(0, head.data_size, step)]
                n = len(parts)
                same = [pa.array([x] * n, t) for x, t in ((head.channels, pa.int32()), (head.sample_rate, pa.int64()), (head.bit_depth, pa.int32()), (head.format_code, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(parts, pa.binary()), pa.array(map(len, parts), pa.int64()), pa.array([k * step // head.block for k in range(n)], pa.int64()), *same], names=names)

    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.[wW][aA][vV]").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(cut, schema)
