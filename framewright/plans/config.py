"""key=value options of a job, file extensions, and the plan of a job, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.plans import compat

# The options of each group.
AUDIO = ("codec", "channels", "sample_rate", "volume")
VIDEO = ("codec", "scale", "width", "height", "fps", "bitrate", "aspect_ratio", "rotate", "brightness", "contrast")
SUBTITLE = ("language", "codec", "default", "shift", "font_size", "color", "position", "fps", "encoding", "translate")
TRANSFORM = ("normalize", "trim", "fade", "reverse", "speed", "rotate", "filter_chain")
U64_MAX = 2**64 - 1
LONELY = "subtitle needs track or language"


def pairs(tokens: Column, bare: bool = False) -> Column:
    """Tokens as (key, value), cut at the first "=". Tokens without one are "true" if ``bare``, else they go."""

    def cut(t: Column) -> Column:
        at = F.instr(t, "=")
        key = F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(t)
        value = F.when(at > 0, F.substr(t, at + 1, F.length(t))).when(F.lit(bare), F.lit("true"))
        return F.struct(key.alias("key"), value.alias("value"))

    return F.filter(F.transform(tokens, cut), lambda p: p["value"].isNotNull())


def option(found: Column, key: str) -> Column:
    """The value of a key's last pair, or null."""
    own = F.transform(F.filter(found, lambda p: p["key"] == key), lambda p: p["value"])
    return F.try_element_at(own, F.lit(-1))


def flags(found: Column) -> Column:
    """The pairs as a map; of repeated keys the last stands."""
    keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.transform(F.filter(found, lambda p: p["key"] == k), lambda p: p["value"]), -1))))


def track(found: Column) -> tuple[Column, Column]:
    """The chosen track (null: all) and the error of a malformed one."""
    return chosen_track(option(found, "track"))


def chosen_track(value: Column) -> tuple[Column, Column]:
    chosen = F.when(value.rlike(r"^\+?[0-9]{1,20}$"), F.regexp_replace(value, r"^\+", "").cast("decimal(20,0)"))
    leading = F.when(value.rlike(r"^\+?0*[0-9]{1,20}$"), F.regexp_replace(value, r"^\+?0*(?=[0-9])", "").cast("decimal(20,0)"))
    number = F.coalesce(chosen, leading)
    number = F.when(number <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), number)
    every = value.isNull() | value.isin("all", "*")
    return F.when(~every, number), F.when(~every & number.isNull(), F.concat(F.lit("invalid track: "), value))


def config(tokens: Column, keys: tuple[str, ...], bare: bool = False) -> dict[str, Column]:
    """track, error and the keys' values of one group of options."""
    found = pairs(tokens, bare)
    chosen, error = track(found)
    return {"track": chosen, "error": error} | {k: option(found, k) for k in keys}


def subtitle(tokens: Column) -> dict[str, Column]:
    out = config(tokens, SUBTITLE)
    asked = F.coalesce(*(out[k] for k in SUBTITLE if k != "language"))
    lonely = out["track"].isNull() & out["language"].isNull() & asked.isNotNull()
    return out | {"error": F.coalesce(out["error"], F.when(lonely, F.lit(LONELY)))}


def extension(path: Column) -> Column:
    """The lower-cased text after the last dot of a path's last part. Null if that has no dot but a leading one, or is ".."."""
    bare = F.when(path.endswith("/") | path.endswith("/."), F.regexp_replace(path, r"(/[.]?)+$", "")).otherwise(path)
    name = F.substring_index(bare, "/", -1)
    found = F.substring_index(name, ".", -1)
    return F.when((name != "..") & (F.length(name) > F.length(found) + 1), F.lower(found))


def plan(jobs: DataFrame, audio: Column, video: Column, subtitles: Column, transforms: Column, source: str = "input", target: str = "output") -> DataFrame:
    """Adds input_ext, output_ext, error (the first thing wrong), route (null if something is) and warning.

    Checked in turn: the four groups of options, both extensions, both containers, the codecs. Codecs are held
    against the container of the input, options without a codec are not checked.
    The output's extension picks the route, or else the input's.
    """
    # Each step is a projection of its own, so that what several expressions need is worked out once.
    groups = {"audio": (audio, False), "video": (video, False), "subtitle": (subtitles, False), "transform": (transforms, True)}
    own = jobs.columns
    rows = jobs.withColumns({"input_ext": extension(F.col(source)), "output_ext": extension(F.col(target))} | {f"__{g}": pairs(tokens, bare) for g, (tokens, bare) in groups.items()})
    wanted = {"track": list(groups), "codec": ["audio", "video", "subtitle"], "language": ["subtitle"]}
    rows = rows.withColumns({f"__{g}_{k}": option(F.col(f"__{g}"), k) for k, gs in wanted.items() for g in gs})
    asked = F.exists("__subtitle", lambda p: p["key"].isin(*(k for k in SUBTITLE if k != "language")))
    rows = rows.withColumns({f"__{g}_wrong": chosen_track(F.col(f"__{g}_track"))[1] for g in groups} | {"__lonely": asked & F.col("__subtitle_language").isNull() & chosen_track(F.col("__subtitle_track"))[0].isNull()})
    i, o = F.col("input_ext"), F.col("output_ext")
    no_ext = lambda e: F.when(e.isNull(), F.lit("no file extension"))
    route = (
        F.when(o == "wav", "wav").when(o.isin("raw", "pcm"), "raw")
        .when(i == "wav", "wav").when(i.isin("raw", "pcm"), "raw").when(i == "mov", "webm")
    )
    error = F.coalesce(
        F.col("__audio_wrong"), F.col("__video_wrong"), F.col("__subtitle_wrong"), F.when(F.col("__lonely"), F.lit(LONELY)), F.col("__transform_wrong"), no_ext(i), no_ext(o), compat.container_error(i), compat.container_error(o),
        compat.codec_error(i, "audio", F.col("__audio_codec")), compat.codec_error(i, "video", F.col("__video_codec")), compat.codec_error(i, "subtitle", F.col("__subtitle_codec")),
        F.when(F.col(source) == F.col(target), F.lit("input and output are the same file")),
        F.when(route == "webm", F.lit("webm pipeline not implemented")), F.when(route.isNull(), F.concat(F.lit("unsupported '"), i, F.lit("' format"))),
    )
    rows = rows.withColumn("error", error).withColumn("route", F.when(F.col("error").isNull(), route))
    rows = rows.select(*own, "input_ext", "output_ext", "error", "route")
    odd = F.when((F.col("route") == "wav") & ~o.isin("wav"), F.concat(F.lit("WAV bytes go to ."), o)).when(~i.isin("wav", "raw", "pcm"), F.concat(F.lit("."), i, F.lit(" is read as raw 16-bit stereo at 44100 Hz")))
    return rows.withColumn("warning", F.when(F.col("route").isNotNull(), odd))
