"""Format arithmetic, header bytes and header checks as column expressions."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.binary import hex_at, little_endian, unsigned

U32_MAX = 4294967295
# Codec strings by bit depth, and RIFF tags.
CODEC_DEPTH = {"pcm_s16le": 16, "pcm_s24le": 24, "pcm_f32le": 32}
INFO_TAGS = {"artist": "IART", "title": "INAM", "comment": "ICOM", "copyright": "ICOP", "software": "ISFT", "genre": "IGNR", "track": "ITRK"}


def _case(key: Column, values: dict, otherwise=None) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def bytes_per_sample(depth: Column) -> Column:
    return F.floor(depth / 8).cast("long")


def bytes_per_frame(depth: Column, channels: Column) -> Column:
    return bytes_per_sample(depth) * channels


def byte_rate(rate: Column, depth: Column, channels: Column) -> Column:
    """Bytes a second, no more than 32 bits hold."""
    return F.least(rate.cast("decimal(20,0)") * bytes_per_frame(depth, channels).cast("decimal(10,0)"), F.lit(U32_MAX).cast("decimal(20,0)")).cast("long")


def audio_format(depth: Column) -> Column:
    return _case(depth, {24: "PCM24", 32: "PCM32"}, "PCM16")


def codec_string(depth: Column) -> Column:
    return _case(depth, {24: "pcm_s24le", 32: "pcm_f32le"}, "pcm_s16le")


def codec_depth(codec: Column) -> Column:
    """Bit depth of a PCM codec, null for others."""
    return _case(codec, CODEC_DEPTH)


def codec_error(kind: str, codec: Column) -> Column:
    return F.when(codec_depth(codec).isNull(), F.concat(F.lit(f"{kind} codec '"), codec, F.lit("' is not supported")))


def applied_depth(codec: Column, depth: Column) -> Column:
    """The depth after a codec was asked for; unknown codecs change nothing."""
    return F.coalesce(codec_depth(codec), depth)


def applied_code(codec: Column, code: Column) -> Column:
    """Float output sets format code 3; nothing resets it."""
    return F.when(codec == "pcm_f32le", F.lit(3)).otherwise(code)


def header_bytes(channels: Column, rate: Column, depth: Column, code: Column, data_size: Column | None = None, extra: Column | None = None) -> Column:
    """A RIFF/WAVE header up to the data. ``data_size`` bytes of data and ``extra`` bytes of chunks follow it; without them both sizes are 0."""
    fmt_size = F.when(code == 3, 18).when(code == 17, 20).otherwise(16)
    tail = F.when(code == 3, little_endian(F.lit(0), 2)).when(code == 17, F.concat(little_endian(F.lit(4), 2), little_endian((512 - 4 * channels) * 2 + 1, 2))).otherwise(F.lit(b""))
    if data_size is None:
        riff, data = F.lit(0), F.lit(0)
    else:
        riff, data = F.lit(20) + fmt_size + data_size + data_size % 2 + (extra if extra is not None else F.lit(0)), data_size
    tag = lambda s: F.lit(s.encode())
    return F.concat(
        tag("RIFF"), little_endian(riff, 4), tag("WAVEfmt "), little_endian(fmt_size, 4), little_endian(code, 2), little_endian(channels, 2), little_endian(rate, 4),
        little_endian(byte_rate(rate, depth, channels), 4), little_endian(bytes_per_frame(depth, channels), 2), little_endian(depth, 2), tail, tag("data"), little_endian(data, 4),
    )


def parse_header(data: Column) -> dict[str, Column]:
    """Fields of a header that begins with its fmt chunk. Channels keep their low byte."""
    u = lambda at, n: unsigned(hex_at(data, at, n))
    return {"fmt_size": u(16, 4), "format_code": u(20, 2), "channels": u(22, 2).bitwiseAND(255), "sample_rate": u(24, 4), "byte_rate": u(28, 4), "block_align": u(32, 2), "bits_per_sample": u(34, 2), "data_size": unsigned(hex_at(data, F.lit(24) + u(16, 4), 4))}


def header_error(channels: Column, rate: Column, code: Column, bits: Column) -> Column:
    """The first thing wrong with a header, or null."""
    pcm = F.when(bits == 0, "bits per sample must be non-zero").when(bits % 8 != 0, "bits per sample must be multiple of 8")
    adpcm = F.when(bits != 4, "IMA ADPCM must have 4 bits per sample")
    return (
        F.when(channels == 0, "channels must be non-zero").when(rate == 0, "sample rate must be non-zero")
        .when(code.isin(1, 3), pcm).when(code == 17, adpcm)
        .otherwise(F.concat(F.lit("audio format code "), code.cast("string"), F.lit(" is not supported")))
    )


def list_size(metadata: Column) -> Column:
    """Bytes that a map's values take as a LIST chunk: 8, and for each value 8, its bytes, a NUL and the pad byte."""
    return F.aggregate(F.map_values(metadata), F.lit(8).cast("long"), lambda acc, v: acc + 8 + F.octet_length(v) + 1 + (F.octet_length(v) + 1) % 2)


def list_chunk(metadata: Column) -> Column:
    """A LIST/INFO chunk of a map's known fields in the order of their tags; empty without any."""
    parts = []
    for field, tag in sorted(INFO_TAGS.items(), key=lambda x: x[1]):
        value = F.encode(F.element_at(metadata, field), "UTF-8")
        n = F.octet_length(value)
        chunk = F.concat(F.lit(tag.encode()), little_endian(n + 1, 4), value, F.when((n + 1) % 2 == 1, F.lit(b"\0\0")).otherwise(F.lit(b"\0")))
        parts.append(F.coalesce(chunk, F.lit(b"")))
    body = F.concat(*parts)
    return F.when(F.octet_length(body) > 0, F.concat(F.lit(b"LIST"), little_endian(F.octet_length(body) + 4, 4), F.lit(b"INFO"), body)).otherwise(F.lit(b""))


def header_of(channels: int, rate: int, depth: int, data_size: int, extra: int = 0) -> bytes:
    """The bytes of ``header_bytes`` for one file of PCM or, at 32 bits, float samples, or at 4 bits ADPCM in blocks of 512 bytes."""
    block, code = depth // 8 * channels, {32: 3, 4: 17}.get(depth, 1)
    tail = {3: b"\0\0", 17: struct.pack("<HH", 4, (512 - 4 * channels) * 2 + 1 & 65535)}.get(code, b"")
    fmt = struct.pack("<HHIIHH", code, channels, rate, min(rate * block, U32_MAX), block, depth) + tail
    return struct.pack("<4sI8sI", b"RIFF", 20 + len(fmt) + data_size + data_size % 2 + extra, b"WAVEfmt ", len(fmt)) + fmt + struct.pack("<4sI", b"data", data_size)


def list_chunk_of(metadata: dict[str, str]) -> bytes:
    """The bytes of ``list_chunk`` for one file."""
    body = b""
    for tag, field in sorted((t, f) for f, t in INFO_TAGS.items() if metadata.get(f) is not None):
        value = metadata[field].encode() + b"\0"
        body += struct.pack("<4sI", tag.encode(), len(value)) + value + b"\0" * (len(value) % 2)
    return struct.pack("<4sI4s", b"LIST", len(body) + 4, b"INFO") + body if body else b""
