"""Frames: a tagged union of audio, video and subtitle in one row, and transforms of their samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_columns(kind: Column, data: Column, audio_format: Column, video_format: Column, subtitle_format: Column) -> dict[str, Column]:
    """kind and three structs of which one isn't null: columns that aren't asked for are never read."""
    return {
        "audio": F.when(kind == "audio", F.struct(data.alias("data"), audio_format.alias("format"))),
        "video": F.when(kind == "video", F.struct(data.alias("data"), video_format.alias("format"))),
        "subtitle": F.when(kind == "subtitle", F.struct(data.alias("data"), subtitle_format.alias("format"))),
    }


def payload(audio: str = "audio", video: str = "video", subtitle: str = "subtitle") -> Column:
    return F.coalesce(F.col(f"{audio}.data"), F.col(f"{video}.data"), F.col(f"{subtitle}.data"))


def frame_size() -> Column:
    return F.coalesce(F.octet_length(payload()), F.lit(0)).cast("long")


Transform = Callable[[Column], Column]


def gain(factor: Column | float) -> Transform:
    """Amplitudes times a factor, in doubles."""
    by = factor if isinstance(factor, Column) else F.lit(float(factor))
    return lambda samples: F.transform(samples, lambda x: x.cast("double") * by)


def normalize_peak(peak: float) -> Transform:
    """Scales a frame so that its largest amplitude is ``peak``; silence stays."""

    def apply(samples: Column) -> Column:
        top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
        return F.transform(samples, lambda x: F.when(top > 0, x.cast("double") * peak / top).otherwise(x.cast("double")))

    return apply


def invert() -> Transform:
    return lambda samples: F.transform(samples, lambda x: -x.cast("double"))


def apply(frames: DataFrame, *transforms: Transform, samples: str = "samples") -> DataFrame:
    """Applies transforms in turn. One's own is any function from a samples column to another."""
    column = F.col(samples)
    for t in transforms:
        column = t(column)
    return frames.withColumn(samples, column)
