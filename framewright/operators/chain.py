"""Chains of filters over frames of audio: trim, fade, reverse, speed, gain, normalize; as options name them.

Frames are rows path, pts (number of the first frame), nb_samples (frames in the row), samples (interleaved), channels, sample_rate. Filters that a frame's place decides on
(trim, fade in, gain) are narrow. Those that need the whole file first aggregate one number a file, its length or peak, and join
it back; samples never meet by file.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.resample import resample

#: Seconds of a fade where none are given.
FADE = Decimal(1)


@dataclass(frozen=True)
class Step:
    name: str
    values: tuple = ()


def _number(text: str, what: str) -> Decimal:
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise ValueError(f"invalid {what}: {text}") from None
    if not value.is_finite() or value < 0:
        raise ValueError(f"invalid {what}: {text}")
    return value


def step(name: str, value: str | None) -> Step:
    """One filter. ``trim`` START-END in seconds, either may be missing; ``fade`` in, out, in:SECONDS or out:SECONDS; ``reverse``; ``speed``
    and ``gain`` a factor; ``normalize`` the peak, 1 if not given. A bare option has the value "true"."""
    bare = value in (None, "", "true")
    if name == "trim":
        start, dash, end = (value or "").partition("-")
        if bare or not dash:
            raise ValueError(f"invalid trim: {value}")
        first, last = (_number(x, "trim") if x else None for x in (start, end))
        if first is not None and last is not None and last < first:
            raise ValueError(f"invalid trim: {value}")
        return Step("trim", (first, last))
    if name == "fade":
        kind, _, seconds = (value or "").partition(":")
        if kind not in ("in", "out"):
            raise ValueError(f"invalid fade: {value}")
        return Step("fade", (kind, _number(seconds, "fade") if seconds else FADE))
    if name == "reverse":
        if not bare:
            raise ValueError(f"invalid reverse: {value}")
        return Step("reverse")
    if name in ("speed", "gain", "volume"):
        by = _number("" if bare else value, name)
        if name == "speed" and not by:
            raise ValueError(f"invalid speed: {value}")
        return Step("speed" if name == "speed" else "gain", (by,))
    if name == "normalize":
        return Step("normalize", (Decimal(1) if bare else _number(value, "normalize"),))
    raise ValueError(f"filter '{name}' is not supported")


def parse(tokens: list[str]) -> tuple[Step, ...]:
    """The filters of a job's transform options, in their order. ``filter_chain=a,b:1`` stands for ``a`` and ``b=1`` in its place."""
    out: list[Step] = []
    for token in tokens:
        name, _, value = token.partition("=")
        if name == "track":
            continue
        if name == "filter_chain":
            for part in filter(None, value.split(",")):
                own, _, rest = part.replace("=", ":", 1).partition(":")
                out.append(step(own, rest or None))
        else:
            out.append(step(name, value or None))
    return tuple(out)


def apply(frames: DataFrame, steps: tuple[Step, ...]) -> DataFrame:
    """Frames after each filter in turn. Trims at the head of a chain only look at pts and nb_samples, so packets outside are
    never decoded where ``samples`` are the result of ``decode``. A file's rows are alike in channels and rate."""
    for s in steps:
        frames = _APPLY[s.name](frames, *s.values)
    return frames


def _frames_at(seconds: Decimal) -> Column:
    """The first frame at or after a time, exactly."""
    return F.ceil(F.lit(seconds).cast("decimal(18,6)") * F.col("sample_rate").cast("decimal(10,0)")).cast("long")


def trim(frames: DataFrame, start: Decimal | None, end: Decimal | None) -> DataFrame:
    """What lies from ``start`` on and before ``end``; pts count from the start. Rows outside go before their samples are looked at."""
    pts, n, ch = F.col("pts"), F.col("nb_samples"), F.col("channels")
    first = _frames_at(start) if start is not None else F.lit(0).cast("long")
    last = _frames_at(end) if end is not None else None
    rows = frames.filter(pts + n > first)
    rows = rows if last is None else rows.filter(pts < last)
    skip = F.greatest(first - pts, F.lit(0))
    stop = n if last is None else F.least(n, last - pts)
    part = F.slice("samples", (skip * ch + 1).cast("int"), ((stop - skip) * ch).cast("int"))
    return rows.filter(stop > skip).withColumns({"samples": part, "pts": pts + skip - first, "nb_samples": stop - skip})


def _with_file(frames: DataFrame, value: Column, name: str) -> DataFrame:
    """Frames with a number of their file: an aggregate of slim rows, joined back."""
    per = frames.groupBy(F.col("path").alias("__of")).agg(value.alias(name))
    return frames.join(per, F.col("path").eqNullSafe(F.col("__of"))).drop("__of")


def fade(frames: DataFrame, kind: str, seconds: Decimal) -> DataFrame:
    """A gain that grows by equal steps from 0 in a file's first frame to 1, or falls to 0 in its last one."""
    over = F.greatest(_frames_at(seconds), F.lit(1)).cast("double")
    rows = frames if kind == "in" else _with_file(frames, F.max(F.col("pts") + F.col("nb_samples")), "__length")
    place = lambda i: F.col("pts") + F.floor(i / F.col("channels"))
    at = place if kind == "in" else lambda i: F.col("__length") - 1 - place(i)
    out = F.transform("samples", lambda x, i: x.cast("double") * F.least(at(i).cast("double") / over, F.lit(1.0)))
    return rows.withColumn("samples", out).drop("__length")


def reverse(frames: DataFrame) -> DataFrame:
    """Files from their end: rows keep their frames, turned round, and move to the other side."""
    rows = _with_file(frames, F.max(F.col("pts") + F.col("nb_samples")), "__length")
    ch, n = F.col("channels"), F.col("nb_samples")
    turned = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.slice("samples", ((n - i) * ch + 1).cast("int"), ch.cast("int"))))
    out = F.when(ch == 1, F.reverse("samples")).otherwise(turned)
    return rows.filter(n > 0).withColumns({"samples": out, "pts": F.col("__length") - F.col("pts") - n}).drop("__length")


def speed(frames: DataFrame, factor: Decimal) -> DataFrame:
    """Files played so many times as fast, their pitch with them, at the rate that they have."""
    rate = F.floor(F.col("sample_rate").cast("decimal(10,0)") * F.lit(factor).cast("decimal(18,6)")).cast("long")
    rows = frames.withColumns({"__target": F.col("sample_rate").cast("long"), "sample_rate": F.greatest(rate, F.lit(1))})
    out = resample(rows, F.col("__target"))
    return out.withColumn("nb_samples", F.floor(F.size("samples") / F.col("channels"))).drop("k")


def gain(frames: DataFrame, factor: Decimal) -> DataFrame:
    return frames.withColumn("samples", F.transform("samples", lambda x: x.cast("double") * F.lit(float(factor))))


def normalize(frames: DataFrame, peak: Decimal) -> DataFrame:
    """Files whose largest amplitude is ``peak``; silent ones stay."""
    own = F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double"))))
    rows = _with_file(frames, F.max(own), "__top")
    by = lambda x: F.when(F.col("__top") > 0, x.cast("double") * F.lit(float(peak)) / F.col("__top")).otherwise(x.cast("double"))
    return rows.withColumn("samples", F.transform("samples", by)).drop("__top")


_APPLY = {"trim": trim, "fade": fade, "reverse": reverse, "speed": speed, "gain": gain, "normalize": normalize}
