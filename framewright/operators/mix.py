"""Mixing tracks that begin and end at times of their own.

Tracks are cut at the same places of the time axis, chunks of a fixed size, and each chunk of a mix is added up by itself; so a long mix, or
one that most tracks belong to, is spread over many tasks. Amplitudes are added as whole numbers (2^-30 each), so the sum doesn't depend on the
order of tracks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a chunk; parts of an amplitude.
CHUNK, UNIT = 16384, 1 << 30


def mix(tracks: DataFrame, start: Column, gain: Column | float = 1.0, mix: str = "mix", samples: str = "samples", channels: str = "channels", ceiling: float | None = None, ahead: int = 256, chunk: int = CHUNK) -> DataFrame:
    """mix, k (chunk), pts, channels, samples, n_tracks (rows in the chunk): the sum of the rows of each mix.

    Rows hold interleaved samples whose first frame lies at ``start``, and have one number of channels a mix. Nothing is said for chunks without
    a track; within a chunk, places without one are silence, and a chunk ends with its last track. Rows without samples, start or channels and what lies before 0 are left out; repeated
    rows add up. With ``ceiling`` a limiter looks ahead: where a sum exceeds the ceiling, the gain falls over the ``ahead`` frames before and rises again over those
    after it, so peaks are met without a step; it needs that much of the neighbouring chunks and no more. An empty table gives an empty result.
    """
    by = gain if isinstance(gain, Column) else F.lit(float(gain))
    rows = tracks.select(F.col(mix).alias("mix"), start.cast("long").alias("start"), F.col(channels).cast("int").alias("channels"), by.cast("double").alias("gain"), F.col(samples).cast("array<double>").alias("samples"))
    rows = rows.filter("start is not null and channels > 0").withColumn("n", F.floor(F.size("samples") / F.col("channels"))).filter("n > 0 and start + n > 0")
    halo = 2 * ahead if ceiling is not None else 0
    first = F.greatest(F.floor((F.col("start") - halo) / chunk), F.lit(0)).cast("long")
    last = F.floor((F.col("start") + F.col("n") - 1 + halo) / chunk).cast("long")
    rows = rows.withColumn("k", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("k") * chunk - halo, F.col("start"), F.lit(0))
    end = F.least((F.col("k") + 1) * chunk + halo, F.col("start") + F.col("n"))
    part = F.slice("samples", ((begin - F.col("start")) * F.col("channels") + 1).cast("int"), ((end - begin) * F.col("channels")).cast("int"))
    parts = rows.filter(end > begin).select("mix", "k", "channels", "gain", begin.alias("at"), part.alias("part"))
    kind = parts.schema["mix"].dataType.simpleString()

    def add(table: pa.Table) -> pa.Table:
        k, ch = table.column("k")[0].as_py(), table.column("channels")[0].as_py()
        low = max(0, k * chunk - halo)
        total, own, until = np.zeros(((k + 1) * chunk + halo - low, ch), np.int64), 0, k * chunk
        for at, gain, part in zip(table.column("at").to_pylist(), table.column("gain").to_pylist(), table.column("part"), strict=True):
            values = np.nan_to_num(part.values.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, ch)
            total[at - low : at - low + len(values)] += np.rint(values * (1.0 if gain is None else gain) * UNIT).astype(np.int64)
            inside = at < (k + 1) * chunk and at + len(values) > k * chunk
            own += inside
            until = max(until, min(at + len(values), (k + 1) * chunk)) if inside else until
        out = total / UNIT
        if ceiling is not None:
            # Clipping only takes away what rounding leaves.
            out = np.clip(out * limiter(out, ceiling, ahead)[:, None], -ceiling, ceiling)
        out = out[k * chunk - low : until - low]
        if not own:
            return pa.table({c: pa.array([], t) for c, t in zip(("mix", "k", "pts", "channels", "samples", "n_tracks"), (table.schema.field("mix").type, pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int64()), strict=True)})
        return pa.table({"mix": table.column("mix").slice(0, 1), "k": [k], "pts": [k * chunk], "channels": pa.array([ch], pa.int32()), "samples": pa.array([out.ravel()], pa.list_(pa.float64())), "n_tracks": [own]})

    return parts.groupBy("mix", "k").applyInArrow(add, f"mix {kind}, k long, pts long, channels int, samples array<double>, n_tracks long")


def limiter(frames: np.ndarray, ceiling: float, ahead: int) -> np.ndarray:
    """A gain a frame. The gain that a frame needs holds for all frames within ``ahead`` of it, and is then smoothed by their mean, so it never exceeds what is needed."""
    need = np.minimum(1.0, ceiling / np.maximum(np.abs(frames).max(axis=1, initial=0.0), 1e-30))
    if not ahead:
        return need
    wide = np.pad(need, 2 * ahead, constant_values=1.0)
    low = np.lib.stride_tricks.sliding_window_view(wide, 2 * ahead + 1).min(axis=1)
    # The mean of a frame's neighbourhood: each of these minima covers the frame itself.
    return np.lib.stride_tricks.sliding_window_view(low, 2 * ahead + 1).mean(axis=1)
