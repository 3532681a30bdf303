"""Data sources for WAV and raw PCM files."""

from framewright.sources.wav import RawPcmSource, WavSource, register

__all__ = ["RawPcmSource", "WavSource", "register"]
