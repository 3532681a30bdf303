"""A job's audio options and transforms, carried out: read, decode, filter, change channels and rate, encode, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import adpcm, pcm
from framewright.functions.formats import CODEC_DEPTH
from framewright.operators import chain
from framewright.operators.packets import decode
from framewright.operators.resample import remix, resample
from framewright.sources.wav import register, renamed, write_files


def audio_options(tokens: list[str]) -> dict[str, str]:
    """key=value tokens, cut at the first "="; of repeated keys the last stands, tokens without one go."""
    return dict(t.split("=", 1) for t in tokens if "=" in t)


def _whole(options: dict[str, str], key: str, most: int) -> int | None:
    value = options.get(key)
    if value is None:
        return None
    if not value.isascii() or not value.isdigit() or not 1 <= int(value) <= most:
        raise ValueError(f"invalid {key}: {value}")
    return int(value)


def frames_of(packets: DataFrame) -> DataFrame:
    """path, pts, nb_samples, samples, channels, sample_rate, depth of packets of the source ``wav`` or ``rawpcm``; ADPCM becomes 16 bits.

    Samples that can't be decoded are an error once they are looked at.
    """
    coded = F.col("bit_depth") == 4
    plain = F.when(coded, adpcm.to_pcm16(F.when(coded, F.col("data")), "channels", "block_size")).otherwise(F.col("data"))
    rows = packets.withColumns({"data": plain, "depth": F.when(coded, 16).otherwise(F.col("bit_depth"))})
    frames = decode(rows, F.col("depth"), F.col("channels"))
    samples = F.when(F.col("error").isNull(), F.col("samples")).otherwise(F.raise_error(F.concat("name", F.lit(": "), "error")))
    return frames.select("path", "pts", F.col("nb_samples").cast("long").alias("nb_samples"), samples.alias("samples"), "channels", "sample_rate", "depth")


def convert_audio(spark: SparkSession, source: str, folder: str, audio: list[str] = (), transforms: list[str] = (), container: str = "wav", source_format: str = "wav", **options: str) -> DataFrame:
    """Writes the files of a file, folder or pattern below ``folder`` and gives their paths and sizes.

    ``audio`` has codec, channels, sample_rate and volume, ``transforms`` what a filter chain has; volume comes first, then the transforms in their
    order, then channels, then the rate. Without a codec files keep their depth. What an option can't mean is an error before anything is
    read. A file of which nothing is left isn't written; files keep their places and metadata goes.
    """
    asked = audio_options(list(audio))
    codec = asked.get("codec")
    if codec is not None and codec not in CODEC_DEPTH:
        raise ValueError(f"{container} codec '{codec}' is not supported")
    channels, rate = _whole(asked, "channels", 255), _whole(asked, "sample_rate", 2**32 - 1)
    steps = (*([chain.step("gain", asked["volume"])] if "volume" in asked else []), *chain.parse(list(transforms)))
    register(spark)
    packets = spark.read.format(source_format).options(path=source, **options).load().withColumn("path", renamed("name", container))
    frames = frames_of(packets)
    # A file's depth, which the steps that put samples together anew don't carry.
    depths = packets.groupBy("path").agg(F.max(F.when(F.col("bit_depth") == 4, 16).otherwise(F.col("bit_depth"))).alias("depth")) if codec is None else None
    frames = chain.apply(frames.drop("depth"), steps)
    if channels is not None:
        frames = frames.withColumns({"samples": remix(F.col("samples"), F.col("channels"), channels), "channels": F.lit(channels)})
    if rate is not None:
        frames = resample(frames, rate)
    if depths is not None:
        frames = frames.join(depths, "path")
    depth = F.lit(CODEC_DEPTH[codec]) if codec is not None else F.col("depth")
    samples = F.transform("samples", lambda x: x.cast("double"))
    made = frames.select("path", F.col("pts").alias("k"), pcm.from_floats(samples, depth).alias("data"), "channels", F.col("sample_rate").cast("long").alias("sample_rate"), depth.alias("bit_depth"))
    return write_files(made, folder, container)
