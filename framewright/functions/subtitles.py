"""Subtitle cues: SubRip and WebVTT texts as rows, their times in whole milliseconds, and where cues overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A time: hours (in WebVTT they may be missing), minutes, seconds, milliseconds.
_TIME = r"(?:(\d{1,9}):)?(\d{1,2}):(\d{1,2})[,.](\d{3})"
_TIMES = rf"(?m)^[ \t]*{_TIME}[ \t]*-->[ \t]*{_TIME}[^\n]*$"


def _ms(block: Column, group: int) -> Column:
    part = lambda i: F.regexp_extract(block, _TIMES, group + i)
    hours = F.when(part(0) == "", "0").otherwise(part(0)).cast("long")
    return ((hours * 60 + part(1).cast("long")) * 60 + part(2).cast("long")) * 1000 + part(3).cast("long")


def cues(files: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, cue (0, 1, ...), name (what stands before the times), start_ms, end_ms, body: the cues of each file's text.

    Cues are parted by empty lines and begin at a line of times; what precedes it in its block is the cue's name, what follows
    its body. Blocks without times (a WebVTT head, notes, styles, regions) are no cues. Line ends may be \\n, \\r\\n or \\r, a byte order mark is passed over, settings behind the times go. A cue that
    ends before it starts stays as it is. Null and empty texts have no cues.
    """
    taken = {"cue", "name", "start_ms", "end_ms", "body"} & set(keep)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are those of cues")
    plain = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(plain, r"\n[ \t]*\n\s*"), lambda b: b.rlike(_TIMES))
    rows = files.select(*keep, F.posexplode(blocks).alias("__at", "block"))
    cut = F.split("block", _TIMES, 2)
    strip = lambda x: F.regexp_replace(x, r"^\n+|\s+$", "")
    return rows.select(*keep, F.col("__at").cast("long").alias("cue"), F.trim(strip(cut[0])).alias("name"), _ms(F.col("block"), 1).alias("start_ms"), _ms(F.col("block"), 5).alias("end_ms"), strip(cut[1]).alias("body"))


def shift(rows: DataFrame, by_ms: Column) -> DataFrame:
    """Cues moved in time, cut at 0; those that would end by then go. As whole milliseconds nothing is rounded."""
    moved = rows.withColumns({"start_ms": F.greatest(F.col("start_ms") + by_ms, F.lit(0)), "end_ms": F.col("end_ms") + by_ms})
    return moved.filter("end_ms > 0")


def _clock(ms: Column, mark: str) -> Column:
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    whole = lambda by: F.floor(ms / by)
    return F.concat(two(whole(3600000)), F.lit(":"), two(whole(60000) % 60), F.lit(":"), two(whole(1000) % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def block(number: Column, start_ms: Column, end_ms: Column, body: Column, format: str = "srt") -> Column:
    """One cue as text, with the empty line behind it."""
    if format not in ("srt", "vtt"):
        raise ValueError(f"unsupported '{format}' format")
    mark = "," if format == "srt" else "."
    return F.concat(number.cast("string"), F.lit("\n"), _clock(start_ms, mark), F.lit(" --> "), _clock(end_ms, mark), F.lit("\n"), body, F.lit("\n\n"))


def overlaps(rows: DataFrame, by: tuple[str, ...], width_ms: int = 600_000) -> DataFrame:
    """by, from_ms, to_ms, n: stretches of time in which n cues, two or more, are shown at once; as long as n stays the same, neighbours with one n are one.

    A sweep over starts and ends: how many are open is a running sum. It is taken by buckets of ``width_ms`` with the sum of all buckets before
    carried into each, so a file with most of the cues is spread over many tasks; a bucket holds its distinct times only. Cues without length or without a time count nowhere.
    """
    real = rows.filter("end_ms > start_ms")
    edges = real.select(*by, F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(*by, "x.*")
    steps = edges.groupBy(*by, "at").agg(F.sum("d").alias("d")).filter("d <> 0").withColumn("bucket", F.floor(F.col("at") / width_ms))
    sums = steps.groupBy(*by, "bucket").agg(F.sum("d").alias("d"), F.min("at").alias("first"))
    order = Window.partitionBy(*by).orderBy("bucket")
    sums = sums.select(*(F.col(x).alias(f"_{i}") for i, x in enumerate(by)), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(order).alias("next_first"))
    on = F.col("bucket") == F.col("_bucket")
    for i, x in enumerate(by):
        on = on & F.col(x).eqNullSafe(F.col(f"_{i}"))
    inside = Window.partitionBy(*by, "bucket").orderBy("at")
    met = steps.join(sums, on).withColumns({"n": F.col("before") + F.sum("d").over(inside), "to_ms": F.coalesce(F.lead("at").over(inside), F.col("next_first"))})
    return met.filter("n >= 2").select(*by, F.col("at").alias("from_ms"), "to_ms", "n")
