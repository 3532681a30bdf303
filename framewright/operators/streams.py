"""Streams and the packets that belong to them. A packet names its stream by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("audio", "video", "subtitle")


def of_kind(streams: DataFrame, kind: str) -> DataFrame:
    return streams.filter(F.col("kind") == kind)


def count_kind(streams: DataFrame, kind: str) -> DataFrame:
    return streams.agg(F.count_if(F.col("kind") == kind).alias("n"))


def packets_of_kind(packets: DataFrame, streams: DataFrame, kind: str) -> DataFrame:
    """Packets whose stream is of a kind; those of unknown streams go. Spark sends the streams around if they are few."""
    return packets.join(of_kind(streams, kind), packets["stream_id"] == streams["index"], "left_semi")


def with_stream(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets with their stream's id, kind and codec; those of unknown streams go."""
    named = streams.select(F.col("index").alias("stream_index"), F.col("id").alias("track_id"), F.col("kind").alias("stream_kind"), "codec")
    return packets.join(named, packets["stream_id"] == named["stream_index"]).drop("stream_index")


def stream_line(index: Column, kind: Column, codec: Column) -> Column:
    return F.concat(F.lit("stream "), index.cast("string"), F.lit(" ("), F.initcap(kind), F.lit(") ["), codec, F.lit("]"))


def listing(streams: DataFrame) -> DataFrame:
    """One row with all lines, in the order of positions."""
    lines = F.array_sort(F.collect_list(F.struct("index", stream_line(F.col("index"), F.col("kind"), F.col("codec")).alias("line"))))
    return streams.agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("listing"))


def resolved(track: Column, count: Column) -> tuple[Column, Column]:
    """Positions that a track choice (null: all) stands for among ``count`` streams, and the error where it has none."""
    error = (
        F.when(count == 0, "no streams")
        .when(track >= count, F.concat(F.lit("track "), track.cast("string"), F.lit(" out of bounds (max "), (count - 1).cast("string"), F.lit(")")))
    )
    # A sequence's bounds are worked out for every row, so they must hold for failing ones as well.
    all_of = F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)).cast("long") - 1)
    return F.when(error.isNull(), F.when(track.isNull(), all_of).otherwise(F.array(track.cast("long")))), error


def unchecked(track: Column) -> Column:
    """The position that a track choice (null: all) stands for where the streams aren't known: itself, or the first."""
    return F.coalesce(track.cast("long"), F.lit(0).cast("long"))
