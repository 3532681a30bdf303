"""A job's video options, carried out over Y4M files."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import video
from framewright.plans.audio import audio_options
from framewright.plans.config import VIDEO
from framewright.sources import y4m

#: Options that have no filter: asking for one is an error.
UNSUPPORTED = ("codec", "bitrate", "aspect_ratio", "rotate")


def _number(options: dict[str, str], key: str) -> Decimal | None:
    if key not in options:
        return None
    try:
        value = Decimal(options[key])
    except InvalidOperation:
        raise ValueError(f"invalid {key}: {options[key]}") from None
    if not value.is_finite():
        raise ValueError(f"invalid {key}: {options[key]}")
    return value


def _whole(options: dict[str, str], key: str) -> int | None:
    value = _number(options, key)
    if value is not None and (value != int(value) or not 1 <= value <= 65535):
        raise ValueError(f"invalid {key}: {options[key]}")
    return None if value is None else int(value)


def frame_rate(text: str) -> tuple[int, int]:
    """``25``, ``29.97`` or ``30000/1001`` as whole numbers."""
    try:
        rate = Fraction(text)
    except (ValueError, ZeroDivisionError):
        raise ValueError(f"invalid fps: {text}") from None
    if not 0 < rate < 2**31 or rate.denominator >= 2**31:
        raise ValueError(f"invalid fps: {text}")
    return rate.numerator, rate.denominator


def convert_video(spark: SparkSession, source: str, folder: str, tokens: list[str], **options: str) -> DataFrame:
    """Writes the Y4M files of a file, folder or pattern below ``folder`` and gives their heads.

    width and height (one alone leaves the other), scale (a factor of both), fps, brightness (0 leaves it) and contrast (1 leaves it) are carried out in this
    order; frames are chosen before pictures are scaled. Options that the engine has no filter for are errors, as are values that can't be meant, before
    anything is read. Files keep their places.
    """
    asked = {k: v for k, v in audio_options(list(tokens)).items() if k in VIDEO}
    missing = [k for k in asked if k in UNSUPPORTED]
    if missing:
        raise ValueError(f"video option '{missing[0]}' is not supported")
    width, height, scale = _whole(asked, "width"), _whole(asked, "height"), _number(asked, "scale")
    if scale is not None and scale <= 0:
        raise ValueError(f"invalid scale: {asked['scale']}")
    bright, contrast = _number(asked, "brightness"), _number(asked, "contrast")
    target = frame_rate(asked["fps"]) if "fps" in asked else None
    y4m.register(spark)
    frames = spark.read.format("y4m").options(path=source, **options).load().withColumn("path", F.col("name"))
    if target is not None:
        # A new frame that shows the same picture is made before its picture is worked on.
        frames = video.convert_fps(frames, (F.col("rate_num"), F.col("rate_den")), target).withColumns({"rate_num": F.lit(target[0]).cast("long"), "rate_den": F.lit(target[1]).cast("long")})
    by = lambda c, own: F.greatest(F.floor((F.lit(own) if own is not None else F.col(c)) * F.lit(scale if scale is not None else Decimal(1)).cast("decimal(18,6)")).cast("int"), F.lit(1))
    if width is not None or height is not None or scale is not None:
        frames = frames.withColumns({"__w": by("width", width), "__h": by("height", height)})
        frames = frames.withColumn("data", video.scaled("data", "format", "width", "height", "__w", "__h")).withColumns({"width": F.col("__w").cast("long"), "height": F.col("__h").cast("long")}).drop("__w", "__h")
    if bright is not None or contrast is not None:
        level = lambda x, none: F.lit(float(none if x is None else x))
        frames = frames.withColumn("data", video.adjusted("data", "format", "width", "height", level(bright, 0), level(contrast, 1)))
    y4m.write_files(frames, folder)
    return spark.read.format("y4m").options(path=folder, include="header").load()
