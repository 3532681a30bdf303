"""Walking the chunks of a RIFF/WAVE file. Reads heads only; sample data is passed over."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from framewright.functions.adpcm import frames_of
from framewright.functions.formats import INFO_TAGS

_FIELDS = {tag: name for name, tag in INFO_TAGS.items()}
# Format codes.
PCM, FLOAT, ADPCM = 1, 3, 17
#: Bytes of an ADPCM block where the head doesn't say.
ADPCM_BLOCK = 512


class WavError(ValueError):
    """A file that can't be read, with the reason as its text."""


@dataclass
class WavHead:
    channels: int = 0
    sample_rate: int = 0
    bit_depth: int = 0
    format_code: int = 0
    data_at: int = -1
    data_size: int = 0
    block_align: int = 0
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def block(self) -> int:
        """Bytes that can't be cut: a frame, or a block of ADPCM."""
        return (self.block_align or ADPCM_BLOCK) if self.format_code == ADPCM else self.channels * (self.bit_depth // 8)

    def frames_in(self, size: int) -> int:
        """Frames of ``size`` bytes that begin with a whole block; of a last, shorter block what it holds."""
        if self.format_code != ADPCM:
            return size // self.block
        whole, rest = divmod(size, self.block)
        return whole * frames_of(self.block, self.channels) + frames_of(rest, self.channels)

    def error(self) -> str | None:
        if not self.channels:
            return "channels must be non-zero"
        if not self.sample_rate:
            return "sample rate must be non-zero"
        if self.format_code in (PCM, FLOAT):
            if not self.bit_depth:
                return "bits per sample must be non-zero"
            return "bits per sample must be multiple of 8" if self.bit_depth % 8 else None
        if self.format_code == ADPCM:
            if self.bit_depth != 4:
                return "IMA ADPCM must have 4 bits per sample"
            return "ADPCM block is too small" if self.block <= 4 * self.channels else None
        return f"audio format code {self.format_code} is not supported"

    @property
    def supported(self) -> bool:
        """Whether the label of the depth is true of the samples: integers of 16 or 24 bits, floats of 32, or ADPCM."""
        return (self.format_code, self.bit_depth) in ((PCM, 16), (PCM, 24), (FLOAT, 32), (ADPCM, 4))


def _info(read, at: int, end: int) -> dict[str, str]:
    """Known tags of a LIST chunk, one by one: values that aren't wanted are passed over, however long. A tag that its chunk cuts off ends it."""
    out = {}
    while at + 8 <= end:
        tag, size = struct.unpack("<4sI", read(at, 8))
        if at + 8 + size > end:
            break
        name = _FIELDS.get(tag.decode("latin-1"))
        if name:
            out[name] = read(at + 8, size).decode("utf-8", "replace").rstrip("\0")
        at += 8 + size + size % 2
    return out


class _NotYet(Exception):
    """Bytes that aren't there so far."""


def head_of_prefix(data: bytes) -> WavHead | None:
    """The head of a file of which the first bytes are known, up to where its data begins; None if they don't go that far.

    Metadata behind the data isn't seen, and the data's size is what the file declares.
    """

    def read(at: int, n: int) -> bytes:
        if at + n > len(data):
            raise _NotYet
        return data[at : at + n]

    try:
        return read_head(read, 1 << 62, to_data=True)
    except _NotYet:
        return None


def read_head(read, size: int, to_data: bool = False) -> WavHead:
    """``read(at, n)`` gives bytes of a file of ``size`` bytes. With ``to_data`` it is read up to its data only.

    Chunks after the data are walked too, so that metadata behind it is found; odd chunks have a pad byte. Data
    that is declared longer than the file ends with it. Data ahead of its fmt chunk has no sample rate. Whatever is wrong with the bytes is a WavError.
    """
    top = read(0, 12)
    if len(top) < 12:
        raise WavError("unexpected EOF")
    for at, tag in ((0, b"RIFF"), (8, b"WAVE")):
        if top[at : at + 4] != tag:
            raise WavError(f"expected {tag.decode()}, found {top[at : at + 4].decode('utf-8', 'replace')}")
    def exactly(at: int, n: int) -> bytes:
        found = read(at, n)
        if len(found) < n:
            raise WavError("unexpected EOF")
        return found

    head, at, formatted = WavHead(), 12, False
    while at + 8 <= size:
        tag, n = struct.unpack("<4sI", exactly(at, 8))
        if tag == b"fmt ":
            if n < 16:
                raise WavError("fmt chunk too small")
            head.format_code, channels, head.sample_rate, _, head.block_align, head.bit_depth = struct.unpack("<HHIIHH", exactly(at + 8, 16))
            head.channels, formatted = channels & 255, True
        elif tag == b"LIST":
            if read(at + 8, min(n, 4)) == b"INFO":
                head.metadata |= _info(exactly, at + 12, min(at + 8 + n, size))
        elif tag == b"data" and head.data_at < 0:
            if not formatted:
                raise WavError("sample rate must be non-zero")
            head.data_at, head.data_size = at + 8, min(n, size - at - 8)
            if to_data:
                break
        at += 8 + n + n % 2
    if head.data_at < 0:
        raise WavError("unexpected EOF")
    wrong = head.error()
    if wrong:
        raise WavError(wrong)
    return head
