"""Cutting byte columns into packets, decoding and encoding them, and putting them together again.

A packet is a row: data, pts, dts, time (num, den), stream_id, keyframe, discard. Everything here but ``mux`` is
narrow: rows are mapped one by one, and a plan of scan, packetize, decode and encode is one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import adpcm, checksums, formats, media, pcm

#: Most bytes of a packet, before rounding down to whole frames.
PACKET_BYTES = 65536
#: Most bytes of a file that is put into one row.
MUX_BYTES = 1 << 30


def packetize(files: DataFrame, content: str, depth: Column, channels: Column, limit: int | Column = PACKET_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, k (0-based), data, size, pts.

    Packets hold ``limit`` bytes rounded down to whole frames, the last the rest, its odd tail included. pts is
    the offset in frames, so it doesn't depend on how a file is cut. Empty or null content gives no packets.
    """
    block, most = formats.bytes_per_frame(depth, channels), limit if isinstance(limit, Column) else F.lit(limit)
    rows = files.withColumns({"__block": block, "__size": F.octet_length(content)}).filter(F.col("__size") > 0)
    rows = rows.withColumn("__limit", F.greatest(most - most % F.col("__block"), F.col("__block")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__size") - 1) / F.col("__limit")))))
    at = F.col("k") * F.col("__limit")
    data = F.substr(F.col(content), (at + 1).cast("int"), F.col("__limit").cast("int"))
    return rows.select(*keep, "k", data.alias("data"), F.least(F.col("__limit"), F.col("__size") - at).cast("long").alias("size"), F.floor(at / F.col("__block")).alias("pts"))


def packet_rows(packets: DataFrame, rate: Column, stream_id: Column | None = None) -> DataFrame:
    """Adds what else a packet has: dts 0, time 1 / rate, stream 0, neither keyframe nor discarded."""
    return packets.withColumns({
        "dts": F.lit(0).cast("long"),
        "time": F.struct(F.lit(1).cast("long").alias("num"), rate.cast("long").alias("den")),
        "stream_id": (stream_id if stream_id is not None else F.lit(0)).cast("long"),
        "keyframe": F.lit(False),
        "discard": F.lit(False),
    })


def decode(packets: DataFrame, depth: Column, channels: Column, data: str = "data") -> DataFrame:
    """Frames: empty packets go; adds format, nb_samples, samples, and error where the length doesn't fit (samples are null then)."""
    full = packets.filter(F.octet_length(data) > 0)
    per = formats.bytes_per_frame(depth, channels)
    return full.withColumns({"format": formats.audio_format(depth), "nb_samples": F.floor(F.octet_length(data) / per), "samples": pcm.to_floats(F.col(data), depth.cast("int")), "error": pcm.length_error(F.col(data), depth.cast("int"))})


def encode(frames: DataFrame, target: Column, samples: str = "samples", kind: str | None = None) -> DataFrame:
    """Packets of the samples in another depth; frames that aren't audio go."""
    audio = frames.filter(F.col(kind) == "audio") if kind else frames
    return audio.withColumns({"data": pcm.from_floats(F.col(samples), target.cast("int")), "dts": F.lit(0).cast("long")})


def transcode(packets: DataFrame, depth: Column, target: Column, data: str = "data") -> DataFrame:
    """Packets in another depth, without the frames between; equal depths leave bytes alone, empty packets go."""
    return packets.filter(F.octet_length(data) > 0).withColumn(data, pcm.transcode(F.col(data), depth.cast("int"), target.cast("int")))


def decode_adpcm(packets: DataFrame, channels: Column, block: Column, data: str = "data") -> DataFrame:
    """Packets of whole ADPCM blocks as 16-bit PCM; empty packets go, one whose last block is cut off within its head has null data."""
    return packets.filter(F.octet_length(data) > 0).withColumn(data, adpcm.to_pcm16(F.col(data), channels.cast("int"), block.cast("int")))


def encode_adpcm(packets: DataFrame, channels: Column, block: Column, data: str = "data") -> DataFrame:
    """16-bit PCM packets as ADPCM blocks of ``block`` bytes. Packets of ``adpcm_packet_bytes`` are a block each."""
    return packets.filter(F.octet_length(data) > 0).withColumn(data, adpcm.from_pcm16(F.col(data), channels.cast("int"), block.cast("int")))


def adpcm_packet_bytes(channels: Column, block: Column) -> Column:
    """Bytes of 16-bit PCM that fill an ADPCM block."""
    group = F.when(channels > 1, 4 * channels).otherwise(1)
    return (1 + F.floor((block - 4 * channels) / group) * F.when(channels > 1, 8).otherwise(2)) * 2 * channels


def mux(packets: DataFrame, path: str, order: str = "k", data: str = "data") -> DataFrame:
    """path, data: each file's packets in order, one after another. One shuffle, by path; a file is one row.

    A row holds MUX_BYTES at most, a larger file is an error: ``write_files`` streams files of any size, ``digests`` tells what is in them.
    """
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    whole = packets.groupBy(path).agg(F.sum(F.octet_length(data).cast("long")).alias("__size"), F.expr(f"listagg({quoted(data)}) within group (order by {quoted(order)})").alias("data"))
    wrong = F.raise_error(F.concat(F.lit("a row can't hold "), F.col("__size").cast("string"), F.lit(" bytes")))
    return whole.select(path, F.when(F.coalesce(F.col("__size"), F.lit(0)) <= MUX_BYTES, F.coalesce("data", F.lit(b""))).otherwise(wrong).alias("data"))


def sizes(packets: DataFrame, path: str, size: Column) -> DataFrame:
    """path, n_packets, data_size, riff_size (of a plain header, without metadata)."""
    total = packets.groupBy(path).agg(F.count(F.lit(1)).alias("n_packets"), F.sum(size).cast("long").alias("data_size"))
    return total.withColumn("riff_size", F.col("data_size") + 36)


def digests(packets: DataFrame, path: str, offset: Column, frames: Column, pts: str = "pts", data: str = "data") -> DataFrame:
    """path, n_packets, size, crc32 (of the whole file), first_pts, end_pts, gap_frames, gap_bytes: files as an aggregate over their packets.

    ``offset`` is the byte at which a packet begins, ``frames`` what it holds. The state of a file is a few numbers that merge in any order, so
    Spark adds up packets before they move, and no file meets in one row. Gaps are what lies between the packets' first and last frame, or byte 0 and the last
    byte, and is in none; the checksum is that of the file with zero bytes there. Packets don't overlap. Null data is an empty packet.
    """
    body, zero = F.coalesce(F.col(data), F.lit(b"")), F.lit(0).cast("long")
    rows = packets.select(path, F.col(pts).alias("__pts"), (F.col(pts) + frames).alias("__end_pts"), F.octet_length(body).cast("long").alias("__size"), F.crc32(body).alias("__crc"), offset.cast("long").alias("__at"))
    # A part of n bytes has crc(part) = raw(part) + crc(n zero bytes); raw values add up, those of zeros are made once a file.
    rows = rows.withColumn("__raw", checksums.moved(F.col("__crc").bitwiseXOR(checksums.moved(F.lit(checksums.ORDER), F.col("__size"))).bitwiseXOR(F.lit(checksums.ORDER)), -(F.col("__at") + F.col("__size"))))
    per = rows.groupBy(path).agg(
        F.count(F.lit(1)).alias("n_packets"), F.sum("__size").alias("size"), F.bit_xor("__raw").alias("__raw"), F.max(F.col("__at") + F.col("__size")).alias("__until"),
        F.min("__pts").alias("first_pts"), F.max("__end_pts").alias("end_pts"), F.sum(F.col("__end_pts") - F.col("__pts")).alias("__frames"),
    )
    ones = checksums.moved(F.lit(checksums.ORDER), F.col("__until")).bitwiseXOR(F.lit(checksums.ORDER))
    return per.select(path, "n_packets", "size", checksums.moved(F.col("__raw"), F.col("__until")).bitwiseXOR(ones).alias("crc32"), "first_pts", "end_pts", F.greatest(F.col("end_pts") - F.col("first_pts") - F.col("__frames"), zero).alias("gap_frames"), (F.col("__until") - F.col("size")).alias("gap_bytes"))


def inspect(packets: DataFrame, depth: Column, channels: Column, rate: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """A line for each frame of a packet listing, without decoding any sample."""
    samples = F.floor(F.col("size") / formats.bytes_per_frame(depth, channels))
    full = packets.filter("size > 0")
    return full.select(*keep, "k", "pts", samples.alias("samples"), channels.cast("long").alias("channels"), rate.cast("long").alias("rate"), media.frame_line(F.col("k"), F.col("pts"), samples, channels, rate).alias("line"))


def explode_samples(frames: DataFrame, channels: Column, keep: tuple[str, ...] = (), samples: str = "samples") -> DataFrame:
    """A row per sample: keep, pts, frame_idx, channel, value."""
    rows = frames.select(*keep, "pts", channels.alias("__ch"), F.posexplode(samples).alias("__i", "value"))
    return rows.select(*keep, "pts", F.floor(F.col("__i") / F.col("__ch")).alias("frame_idx"), (F.col("__i") % F.col("__ch")).cast("long").alias("channel"), "value")
