"""A job's subtitle options, carried out over SubRip and WebVTT files."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions import subtitles
from framewright.plans.audio import audio_options
from framewright.plans.config import SUBTITLE
from framewright.sources.files import filesystem
from framewright.sources.wav import renamed, write_files


def shift_ms(text: str) -> int:
    """Seconds, which may be negative, as whole milliseconds; finer ones are an error."""
    try:
        value = Decimal(text) * 1000
    except InvalidOperation:
        raise ValueError(f"invalid shift: {text}") from None
    if not value.is_finite() or value != int(value) or abs(value) >= 2**53:
        raise ValueError(f"invalid shift: {text}")
    return int(value)


def _name_below(source: str) -> Column:
    """A file's path below the folder that was asked for."""
    local = source.startswith("file:") or "://" not in source
    root = filesystem(source)[1] if local else source
    path = F.regexp_replace("path", "^file:/+", "/") if local else F.col("path")
    return F.substr(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))


def convert_subtitles(spark: SparkSession, source: str, folder: str, container: str = "srt", tokens: list[str] = ()) -> DataFrame:
    """Writes the cues of a folder's .srt and .vtt files, in the order of their times, below ``folder``; gives path and size of its files.

    ``shift`` moves cues by seconds; cues that would end by 0 go, and a file without cues isn't written. Other options have
    nothing here that they could change and are errors, but for language and default, which name a track. A cue is a packet of its file, so files are put
    together by the writer and none is held in a row. Cues are numbered anew; texts must be UTF-8.
    """
    asked = {k: v for k, v in audio_options(list(tokens)).items() if k in SUBTITLE and k not in ("language", "default")}
    by = shift_ms(asked.pop("shift", "0"))
    if asked:
        raise ValueError(f"subtitle option '{next(iter(asked))}' is not supported")
    if container not in ("srt", "vtt"):
        raise ValueError(f"unsupported '{container}' format")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    files = files.filter(F.lower("path").rlike("[.](srt|vtt)$")).select(_name_below(source).alias("file"), F.decode("content", "UTF-8").alias("content"))
    rows = subtitles.shift(subtitles.cues(files, "content", ("file",)), F.lit(by))
    rows = rows.withColumn("path", renamed("file", container))
    # A number follows from how many cues of the file come before: one window over slim rows a file.
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("start_ms", "cue")).cast("long"))
    text = subtitles.block(F.col("k"), F.col("start_ms"), F.col("end_ms"), F.col("body"), container)
    if container == "vtt":
        text = F.when(F.col("k") == 1, F.concat(F.lit("WEBVTT\n\n"), text)).otherwise(text)
    return write_files(rows.select("path", "k", F.encode(text, "UTF-8").alias("data")), folder, "raw")
