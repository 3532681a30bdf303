"""Which codecs a container holds, as a table of edges, and lookups by joins with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Containers, and the codecs of each kind that they hold.
HELD = {
    "mp4": {"video": ["h264", "h265"], "audio": ["aac", "mp3"], "subtitle": ["mov_text"]},
    "mkv": {"video": ["h264", "h265", "vp9", "av1"], "audio": ["aac", "vorbis", "opus", "mp3"], "subtitle": ["srt", "ass", "vtt"]},
    "mov": {"video": ["h264", "h265"], "audio": ["aac", "mp3"], "subtitle": ["mov_text"]},
    "webm": {"video": ["vp8", "vp9", "av1"], "audio": ["vorbis", "opus"], "subtitle": ["vtt"]},
    "avi": {"video": ["mpeg4", "h264"], "audio": ["mp3", "aac"]},
    "ogv": {"video": ["theora"], "audio": ["vorbis"]},
    "flv": {"video": ["h264", "vp6"], "audio": ["mp3"]},
    "mxf": {"video": ["mpeg2", "h264", "h265"], "audio": ["pcm_s16le", "aac"]},
    "ts": {"video": ["h264", "h265", "mpeg2"], "audio": ["aac", "mp2"]},
    "mp3": {"audio": ["mp3"]},
    "aac": {"audio": ["aac"]},
    "opus": {"audio": ["opus"]},
    "flac": {"audio": ["flac"]},
    "wav": {"audio": ["pcm_s16le", "pcm_s24le", "pcm_f32le"]},
    "raw": {"audio": ["pcm_s16le", "pcm_s24le", "pcm_f32le"]},
    "pcm": {"audio": ["pcm_s16le", "pcm_s24le", "pcm_f32le"]},
    "m4a": {"audio": ["aac", "alac"]},
    "alac": {"audio": ["alac"]},
    "ogg": {"audio": ["vorbis", "opus"]},
}
CONTAINERS = list(HELD)


def edge_list() -> list[tuple[str, str, str]]:
    return [(container, kind, codec) for container, kinds in HELD.items() for kind, codecs in kinds.items() for codec in codecs]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_list(), "container string, kind string, codec string").distinct()


def containers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CONTAINERS], "container string")


def supported(asked: DataFrame, spark: SparkSession, container: str = "container", kind: str = "kind", codec: str = "codec") -> DataFrame:
    return _joined(asked, spark, container, kind, codec, "left_semi")


def unsupported(asked: DataFrame, spark: SparkSession, container: str = "container", kind: str = "kind", codec: str = "codec") -> DataFrame:
    return _joined(asked, spark, container, kind, codec, "left_anti")


def _joined(asked: DataFrame, spark: SparkSession, container: str, kind: str, codec: str, how: str) -> DataFrame:
    known = F.broadcast(edges(spark))  # 64 rows
    on = (asked[container] == known["container"]) & (asked[kind] == known["kind"]) & (asked[codec] == known["codec"])
    return asked.join(known, on, how)


def container_error(extension: Column) -> Column:
    return F.when(~extension.isin(*CONTAINERS), F.concat(F.lit("'"), extension, F.lit("' is not supported")))


def codec_error(container: Column, kind: str, codec: Column) -> Column:
    """As an expression: the table is one constant map, so a job's row needs no join. Null without a codec."""
    of_kind = [(c, kinds[kind]) for c, kinds in HELD.items() if kind in kinds]
    table = F.create_map(*(x for c, codecs in of_kind for x in (F.lit(c), F.array(*map(F.lit, codecs)))))
    held = F.coalesce(F.array_contains(F.try_element_at(table, container), codec), F.lit(False))
    word = "format" if kind == "subtitle" else "codec"
    return F.when(codec.isNull(), F.lit(None)).otherwise(F.coalesce(container_error(container), F.when(~held, F.concat(F.lit(f"{word} '"), codec, F.lit("' not supported in '"), container, F.lit("'")))))
