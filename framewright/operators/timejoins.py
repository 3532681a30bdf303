"""Joins by time: the nearest earlier (or later) row of the same key, and the intervals that a point lies in.

Times are whole numbers (ticks). Both joins cut the time axis into buckets, so a key that has most of the rows is spread over
many tasks, and neither compares all rows of a key with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(_quoted(x)) for x in df.columns))


def _keys(df: DataFrame, by: Sequence[str]) -> list[Column]:
    return [F.col(_quoted(x)).alias(f"key_{i}") for i, x in enumerate(by)]


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, columns: Sequence[str], width: int, direction: str = "backward", tolerance: int | None = None, found: str = "found") -> DataFrame:
    """``left`` with a struct ``found`` (time and ``columns``) of the row of ``right`` that has the same keys and the nearest time.

    ``backward`` takes the latest at or before the left row's time, ``forward`` the earliest at or after; of several at one time
    the largest by ``columns``, in turn. With ``tolerance`` rows further away don't count. Left rows stay as they are, as often as they stand; without a
    match, a key or a time ``found`` is null. Right rows without a key or time match nothing. Empty tables are no special case.

    Rows of a key meet by buckets of ``width`` ticks: a bucket's rows are ordered together, with one row that carries the best of all
    buckets before. Carrying looks at a row a bucket, never at rows of a bucket. Choose a width that gives a key a few thousand rows a bucket
    at most: no bucket is cut again.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction '{direction}' is neither backward nor forward")
    if width <= 0:
        raise ValueError("width must be positive")
    if found in left.columns:
        raise ValueError(f"the left table has a column '{found}'")
    keys = [f"key_{i}" for i in range(len(by))]
    at = F.col(_quoted(time)).cast("long")
    turned = at if direction == "backward" else -at
    whole = lambda df: F.greatest(*(F.col(x).isNull().cast("int") for x in [*keys, "at"])) == 0
    bucket = F.floor(F.col("at") / F.lit(width).cast("decimal(19,0)")).cast("long").alias("bucket")
    rows = left.select(*_keys(left, by), turned.alias("at"), _packed(left).alias("row"))
    other = right.select(*_keys(right, by), turned.alias("at"), F.struct(turned.alias("at"), *(F.col(_quoted(x)).alias(f"c{i}") for i, x in enumerate(columns))).alias("best")).filter(whole(right))
    kind = other.schema["best"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    mine, lost = rows.filter(whole(left)).select("*", bucket), rows.filter(~whole(left))
    other = other.select("*", bucket)
    # The best of each bucket, and a row for each bucket that is asked, so that it gets what came before.
    tops = other.groupBy(*keys, "bucket").agg(F.max("best").alias("top"))
    asked = mine.groupBy(*keys, "bucket").agg(F.lit(None).cast(kind).alias("top"))
    before = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = tops.unionByName(asked).withColumn("best", F.max("top").over(before)).filter("top is null and best is not null")
    nothing = F.lit(None).cast(rows.schema["row"].dataType).alias("row")
    met = mine.select(*keys, "bucket", "at", "row", none.alias("best"))
    met = met.unionByName(other.select(*keys, "bucket", "at", nothing, "best")).unionByName(carried.select(*keys, "bucket", F.col("best.at").alias("at"), nothing, "best"))
    until = Window.partitionBy(*keys, "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = met.withColumn("best", F.max("best").over(until)).filter("row is not null").select("row", "at", "best").unionByName(lost.select("row", "at", none.alias("best")))
    near = F.col("best").isNotNull() if tolerance is None else F.col("at") - F.col("best.at") <= tolerance
    back = F.col("best.at") if direction == "backward" else -F.col("best.at")
    match = F.when(near, F.struct(back.alias(time), *(F.col(f"best.c{i}").alias(x) for i, x in enumerate(columns))))
    return out.select(*(F.col(f"row.{_quoted(x)}").alias(x) for x in left.columns), match.alias(found))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], time: str, start: str, end: str, columns: Sequence[str], width: int) -> DataFrame:
    """``points`` with ``start``, ``end`` and ``columns`` of every interval of the same keys that holds the point: start <= time < end.

    A point in no interval, or without a key or time, has no row, nor has an interval without a key, a start, an end or any length; equal rows match
    as often as they stand. An interval is put into buckets of the smallest power of two times ``width`` that it fits in, so it
    is in two at most, however long it is; a point looks at one bucket of each size in use (64 at most). This is an
    equi-join, so Spark splits buckets that have too many rows.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    clash = [x for x in (start, end, *columns) if x in points.columns]
    if clash:
        raise ValueError(f"both tables have columns {clash}")
    keys = [f"key_{i}" for i in range(len(by))]
    whole = F.greatest(*(F.col(x).isNull().cast("int") for x in [*keys, "at"])) == 0
    spans = intervals.select(*_keys(intervals, by), F.col(_quoted(start)).cast("long").alias("at"), F.col(_quoted(end)).cast("long").alias("until"), F.struct(*(F.col(_quoted(x)) for x in (start, end, *columns))).alias("span"))
    spans = spans.filter(whole & (F.col("until") > F.col("at")))
    steps = F.floor((F.col("until") - F.col("at") - 1) / F.lit(width).cast("decimal(19,0)")).cast("long")
    spans = spans.withColumn("level", F.when(steps == 0, 0).otherwise(F.length(F.bin(steps))))
    size = lambda: F.lit(width).cast("decimal(19,0)") * F.pow(F.lit(2.0), F.col("level")).cast("decimal(19,0)")
    place = lambda c: F.floor(c / size()).cast("long")
    spans = spans.withColumn("bucket", F.explode(F.sequence(place(F.col("at")), place(F.col("until") - 1))))
    levels = sorted(r["level"] for r in spans.select("level").distinct().collect())
    rows = points.select(*_keys(points, by), F.col(_quoted(time)).cast("long").alias("at"), _packed(points).alias("row")).filter(whole)
    rows = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("bucket", place(F.col("at")))
    other = spans.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("level").alias("_level"), F.col("bucket").alias("_bucket"), F.col("at").alias("from"), "until", "span")
    on = [F.col(k) == F.col(f"_{k}") for k in (*keys, "level", "bucket")]
    met = rows.join(other, on).filter((F.col("from") <= F.col("at")) & (F.col("at") < F.col("until")))
    return met.select(*(F.col(f"row.{_quoted(x)}").alias(x) for x in points.columns), *(F.col(f"span.{_quoted(x)}").alias(x) for x in (start, end, *columns)))


def sessions(events: DataFrame, by: Sequence[str], time: str, gap: Column | str, *measures: Column) -> DataFrame:
    """Keys, start, end (the last event's time and the gap) and n of each session: events of a key that follow each other within the gap.

    ``gap`` may be a column, so keys can have gaps of their own. Runs as a batch and, on a stream with a watermark, with state that
    leaves with its session. An event right at the end belongs to the session; events without a time have none.
    """
    w = F.session_window(F.col(time), gap)
    per = events.groupBy(*(F.col(x) for x in by), w.alias("__w")).agg(F.count(F.lit(1)).alias("n"), *measures)
    return per.select(*by, F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *(x for x in per.columns if x not in (*by, "__w")))
