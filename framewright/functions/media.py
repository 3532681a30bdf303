"""Channels, audio, video and frame scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.formats import _case

# Named channel layouts, bytes of samples and pixels.
LAYOUTS = {1: "mono", 2: "stereo", 4: "quad", 6: "5.1", 8: "7.1"}
VARIANTS = {1: "Mono", 2: "Stereo", 4: "Quad", 6: "Surround", 8: "SevenPointOne"}
SAMPLE_BYTES = {"PCM16": 2, "PCM24": 3, "PCM32": 4}
PIXEL_BYTES = {"RGB24": 3, "RGBA32": 4, "YUV444": 3, "GRAY8": 1}


def layout_name(count: Column) -> Column:
    return F.coalesce(_case(count, LAYOUTS), F.concat(count.cast("string"), F.lit(" channels")))


def layout_variant(count: Column) -> Column:
    return _case(count, VARIANTS, "Custom")


def sample_bytes(audio_format: Column) -> Column:
    """Bytes of a sample, null for compressed formats."""
    return _case(audio_format, SAMPLE_BYTES).cast("long")


def nb_samples(n_bytes: Column, audio_format: Column, channels: Column) -> Column:
    """Samples a channel; 0 for compressed formats."""
    per = sample_bytes(audio_format) * channels
    return F.coalesce(F.when(per > 0, F.floor(n_bytes / per)), F.lit(0)).cast("long")


def pixel_bytes(video_format: Column) -> Column:
    return _case(video_format, PIXEL_BYTES).cast("long")


def video_size(video_format: Column, width: Column, height: Column) -> Column:
    area = width.cast("long") * height
    return F.coalesce(area * pixel_bytes(video_format), F.when(video_format == "YUV420", F.floor(area * 3 / 2)).when(video_format == "YUV422", area * 2)).cast("long")


def frame_line(number: Column, pts: Column, samples: Column, channels: Column, rate: Column) -> Column:
    """One line of a frame listing."""
    s = lambda c: c.cast("string")
    return F.concat(F.lit("Frame "), s(number), F.lit(": pts="), s(pts), F.lit(", samples="), s(samples), F.lit(", channels="), s(channels), F.lit(", rate="), s(rate))
