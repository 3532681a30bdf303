"""Views over the provided tables that give media-shaped input: each grows with the table it is made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the job table.
EXTENSIONS = "mp4 mkv mov webm avi ogv flv mxf ts mp3 aac opus flac wav raw pcm m4a alac ogg y4m WAV".split()
TOKENS = "codec=pcm_s16le codec=pcm_s24le codec=pcm_f32le codec=aac codec=h264 track=0 track=all track=* track=+3 track=-1 track=x volume=a=b bare codec= track= \
channels=2 sample_rate=48000 volume=0.5 scale=2 width=640 height=480 fps=25 bitrate=1M aspect_ratio=16:9 rotate=90 brightness=1.1 contrast=0.9 language=en default=yes shift=-2 \
font_size=12 color=red position=top encoding=utf-8 translate=de normalize trim=1-2 fade=in reverse speed=2 filter_chain=a,b codec=srt codec=mov_text".split()
TOKEN_OF = (("tok1", 1, 1), ("tok2", 7, 3), ("tok3", 11, 5), ("tok4", 3, 13))
RATES = (0, 8000, 11025, 16000, 22050, 44100, 48000, 96000, 192000, 4294967295)
DEPTHS, CODES = (0, 4, 8, 16, 24, 32, 12), (1, 3, 17, 65534)
STREAMS = [(0, 10, "audio", "pcm_s16le"), (1, 11, "video", "h264"), (2, 12, "subtitle", "srt"), (3, 13, "audio", "aac"), (4, 14, "video", "vp9"), (5, 15, "audio", "opus")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, depth, channels, sample_rate: texts as raw PCM."""
    channels = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 4).otherwise(6)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pcm")).alias("path"), F.encode("text", "UTF-8").alias("content"),
        ((F.col("doc_id") % 3 + 2) * 8).alias("depth"), channels.cast("long").alias("channels"), (8000 * (1 + F.col("doc_id") % 6)).alias("sample_rate"),
    )


def frames_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, stream_id, g (a gain), samples: decoded float audio."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("stream_id"), (F.col("vec_id") % 4 + 1).alias("g"), F.col("embedding").alias("samples"))


def streams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STREAMS, "index long, id long, kind string, codec string")


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("stream_id"), pts.alias("pts"), F.floor("value").cast("long").alias("size"), "event_type")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda head, ext: F.concat(F.lit(head), k.cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), name("dir.d/in_", _pick(EXTENSIONS, k % 21)).alias("input"), name("out/", _pick(EXTENSIONS, c % 21)).alias("output"),
        *(_pick(TOKENS, (k * a + c * b) % len(TOKENS)).alias(name) for name, a, b in TOKEN_OF),
    )


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, (F.col("p_size") % 10).cast("long").alias("channels"), _pick([F.lit(r).cast("long") for r in RATES], k % 10).alias("sample_rate"), _pick(DEPTHS, k % 7).cast("long").alias("bit_depth"), _pick(CODES, F.floor(k / 10) % 4).cast("long").alias("format_code"))


def bulk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream_id"), F.col("l_linenumber").alias("pts"), (F.col("l_discount") * 20 - 1).cast("float").alias("v"))
