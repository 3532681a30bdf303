"""A demuxer as a table function: one file's bytes in, its packets out, for SQL's ``lateral``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from framewright.sources.riff import FLOAT, PCM, WavError, WavHead, read_head

#: What packets have, and what only those of WAV files have besides.
_PACKET = StructType().add("k", LongType()).add("data", BinaryType()).add("size", LongType()).add("pts", LongType())
_FORMAT = StructType().add("channels", IntegerType()).add("sample_rate", LongType()).add("bit_depth", IntegerType()).add("format_code", IntegerType())


class _Demux:
    """``demux(content, container, depth, channels, limit)``; the container and the limit are constants, depth and channels only count for raw bytes."""

    @staticmethod
    def analyze(content: AnalyzeArgument, container: AnalyzeArgument, depth: AnalyzeArgument, channels: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        if container.value not in ("wav", "raw"):
            raise ValueError(f"unsupported '{container.value}' format")
        if not isinstance(limit.value, int) or limit.value <= 0:
            raise ValueError("the limit must be a positive constant")
        return AnalyzeResult(_PACKET if container.value == "raw" else StructType([*_PACKET, *_FORMAT]))

    def eval(self, content: bytes | None, container: str, depth: int | None, channels: int | None, limit: int) -> Iterator[tuple]:
        if not content:
            return
        wav = container == "wav"
        head = read_head(lambda at, n: content[at : at + n], len(content)) if wav else WavHead(int(channels or 0), 1, int(depth or 0), FLOAT if depth == 32 else PCM, 0, len(content))
        if head.error():
            raise WavError(head.error())
        step = max(head.block, limit - limit % head.block)
        about = (head.channels, head.sample_rate, head.bit_depth, head.format_code) if wav else ()
        for k, at in enumerate(range(0, head.data_size, step)):
            data = content[head.data_at + at : head.data_at + min(at + step, head.data_size)]
            yield (k, data, len(data), head.frames_in(at), *about)


Demux = udtf(_Demux, useArrow=True)


def register(spark: SparkSession, name: str = "demux") -> None:
    """Makes the function known to SQL: ``select f.path, p.* from files f, lateral demux(f.content, 'wav', null, null, 65536) p``."""
    spark.udtf.register(name, Demux)
