"""The same operators over a growing folder."""

from framewright.streaming.folder import packet_stream, pcm_stream, wav_stream, windowed_sizes

__all__ = ["packet_stream", "pcm_stream", "wav_stream", "windowed_sizes"]
