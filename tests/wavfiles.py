"""WAV bytes by struct alone, independent of the library's writer."""

import struct


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def fmt(channels=1, rate=8000, depth=16, code=1, extra=b""):
    return chunk(b"fmt ", struct.pack("<HHIIHH", code, channels, rate, min(2**32 - 1, rate * (channels & 255) * depth // 8), (channels & 255) * depth // 8, depth) + extra)


def riff(*chunks: bytes) -> bytes:
    body = b"".join(chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def wav(body: bytes, **k) -> bytes:
    return riff(fmt(**k), chunk(b"data", body))


def info(**fields: bytes) -> bytes:
    return chunk(b"LIST", b"INFO" + b"".join(chunk(t.encode(), v + b"\0") for t, v in fields.items()))
