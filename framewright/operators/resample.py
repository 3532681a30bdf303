"""Sample-rate conversion by a windowed-sinc filter in polyphase form.

Rates in lowest terms are L to M: output sample m lies at m * M / L input samples. Its whole part says where the filter's
taps stand, its L-ths which of L sets of taps is used; both are whole numbers, so no drift and no rounding builds up however
long a file is. Taps reach over the edges of packets. Input is therefore dealt out once, by (file, chunk of the time axis):
a packet's samples go to each chunk whose outputs need them, a chunk's own samples and its halo, and the chunk is filtered
there. A chunk's size is fixed, so a file of any length, or one that holds most samples, is spread over many tasks, and the result
doesn't depend on how files were cut into packets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the filter on either side, and the share of the smaller band that passes.
CROSSINGS, BAND = 16, 0.95
#: Frames of a chunk, before its halo.
CHUNK = 32768
#: Largest number of taps of all phases; odd ratios of large rates would need more.
MOST_TAPS = 64_000_000


def ratio(rate: int, target: int) -> tuple[int, int]:
    """L and M: ``target`` / ``rate`` in lowest terms."""
    if rate <= 0 or target <= 0:
        raise ValueError("sample rate must be non-zero")
    g = gcd(rate, target)
    return target // g, rate // g


def reach(up: int, down: int) -> int:
    """Input samples that an output needs on either side."""
    return -(-CROSSINGS * max(up, down) // up)


@lru_cache(maxsize=16)
def taps(up: int, down: int) -> np.ndarray:
    """Row p: the taps of outputs that lie p / L behind an input sample, for the 2 * reach input samples around; each row adds up to 1."""
    half = reach(up, down)
    if up * 2 * half > MOST_TAPS:
        raise ValueError(f"rates of ratio {up}:{down} need too many filter taps")
    scale = BAND * min(1.0, up / down)
    at = np.arange(1 - half, half + 1)[None, :] - np.arange(up)[:, None] / up
    window = np.where(np.abs(at) < half, 0.5 + 0.5 * np.cos(np.pi * at / half), 0.0)
    out = np.sinc(at * scale) * window
    return out / out.sum(axis=1, keepdims=True)


def filtered(samples: np.ndarray, first: int, start: int, stop: int, up: int, down: int) -> np.ndarray:
    """Outputs ``start`` to ``stop`` of frames (frame, channel) of which the first has number ``first``; frames outside are silence.

    Taps are added one by one in their order, so a result doesn't depend on what else is worked out with it.
    """
    half, table = reach(up, down), taps(up, down)
    at, phase = np.divmod(np.arange(start, stop, dtype=np.int64) * down, up)
    out = np.zeros((len(at), samples.shape[1]))
    for t in range(2 * half):
        place = at + (t + 1 - half) - first
        inside = (place >= 0) & (place < len(samples))
        out += np.where(inside[:, None], samples[np.clip(place, 0, max(0, len(samples) - 1))] * table[phase, t][:, None], 0.0) if len(samples) else 0.0
    return out


def resample(packets: DataFrame, target: int | Column, path: str = "path", samples: str = "samples", channels: str = "channels", rate: str = "sample_rate", pts: str = "pts", chunk: int = CHUNK) -> DataFrame:
    """path, k (chunk), pts (first frame, at the new rate), channels, sample_rate, samples: each file at ``target`` samples a second.

    ``target`` is a number or a column, the same in all packets of a file. ``packets`` has rows of interleaved float samples with the number of their first frame; frames that no packet has are
    silence, of those in several packets one stands. A file's rate and channels are the same in all its packets. An output exists
    for each point of time before the file's last frame ends. Null samples are as none, empty packets and rows without a rate or
    channels go; files may have rates of their own, equal ones pass unfiltered. An empty table gives an empty result; columns that
    aren't named don't matter.
    """
    ch, r, to = F.col(channels).cast("int"), F.col(rate).cast("long"), (target if isinstance(target, Column) else F.lit(target)).cast("long")
    rows = packets.select(F.col(path).alias("path"), F.col(pts).cast("long").alias("pts"), ch.alias("channels"), r.alias("rate"), to.alias("target"), F.col(samples).cast("array<float>").alias("samples"))
    rows = rows.filter((F.col("channels") > 0) & (F.col("rate") > 0) & (F.col("target") > 0)).withColumn("n", F.floor(F.size("samples") / F.col("channels"))).filter("n > 0")
    # Frames on either side of a chunk: as many as the taps reach, one more for the fraction.
    halo = F.ceil(F.lit(CROSSINGS) * F.greatest(F.lit(1.0), F.col("rate") / F.col("target"))).cast("long") + 1
    first, last = F.greatest(F.floor((F.col("pts") - halo) / chunk), F.lit(0)), F.floor((F.col("pts") + F.col("n") - 1 + halo) / chunk)
    rows = rows.withColumn("halo", halo).withColumn("k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("k") * chunk - F.col("halo"), F.col("pts"))
    end = F.least((F.col("k") + 1) * chunk + F.col("halo"), F.col("pts") + F.col("n"))
    part = F.slice("samples", ((begin - F.col("pts")) * F.col("channels") + 1).cast("int"), ((end - begin) * F.col("channels")).cast("int"))
    parts = rows.filter(end > begin).select("path", "k", "channels", "rate", "target", begin.alias("at"), part.alias("part"))

    def convert(table: pa.Table) -> pa.Table:
        ch, own_rate, to, k = (table.column(c)[0].as_py() for c in ("channels", "rate", "target", "k"))
        up, down = ratio(own_rate, to)
        at = table.column("at").to_numpy()
        arrays = [np.nan_to_num(x.values.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, ch) for x in table.column("part")]
        first, end = int(at.min()), max(int(a) + len(x) for a, x in zip(at, arrays, strict=True))
        held = np.zeros((end - first, ch))
        for i in np.argsort(at, kind="stable"):
            held[at[i] - first : at[i] - first + len(arrays[i])] = arrays[i]
        # Outputs of this chunk's own frames; the file ends with its last frame.
        start, stop = -(-k * chunk * up // down), -(-min((k + 1) * chunk, end) * up // down)
        if stop <= start:
            return _RESULT.empty_table()
        out = held[start - first : stop - first] if up == down else filtered(held, first, start, stop, up, down)
        values = pa.array([out.astype(np.float32).ravel()], pa.list_(pa.float32()))
        return pa.Table.from_arrays([table.column("path").slice(0, 1), pa.array([k]), pa.array([start]), pa.array([ch], pa.int32()), pa.array([to]), values], schema=_RESULT)

    return parts.groupBy("path", "k").applyInArrow(convert, "path string, k long, pts long, channels int, sample_rate long, samples array<float>")


_RESULT = pa.schema([("path", pa.string()), ("k", pa.int64()), ("pts", pa.int64()), ("channels", pa.int32()), ("sample_rate", pa.int64()), ("samples", pa.list_(pa.float32()))])


def remix(samples: Column, channels: Column, target: int) -> Column:
    """Interleaved samples with another number of channels: one channel goes to all, all go to one as their mean, otherwise
    channels keep their places, further ones are silent and those beyond ``target`` go."""
    frames = F.sequence(F.lit(0), F.greatest(F.floor(F.size(samples) / channels).cast("int"), F.lit(1)) - 1)
    at = lambda i, c: F.try_element_at(samples, (i * channels + c + 1).cast("int")).cast("double")
    mean = lambda i: F.aggregate(F.slice(samples, (i * channels + 1).cast("int"), channels.cast("int")), F.lit(0.0), lambda a, x: a + x.cast("double")) / channels
    one = lambda i, c: F.when(channels == 1, at(i, F.lit(0))).when(F.lit(c) < channels, at(i, F.lit(c))).otherwise(F.lit(0.0))
    frame = (lambda i: F.array(mean(i))) if target == 1 else (lambda i: F.array(*(one(i, c) for c in range(target))))
    out = F.flatten(F.transform(frames, frame))
    return F.when(samples.isNull(), None).when(F.size(samples) < channels, F.array().cast("array<double>")).when(channels == target, F.transform(samples, lambda x: x.cast("double"))).otherwise(out)
