import pytest
from pyspark.sql import functions as F

from framewright.operators import streams as st
from framewright.plans import compat, config


@pytest.mark.parametrize(
    ("path", "extension"),
    [("a/b.c/.wav", None), ("a/x.Tar.WAV", "wav"), ("x.", ""), ("a/x", None), ("a/..", None), ("x.wav/", "wav"), ("..wav", "wav"), ("x.wav/.", "wav"), ("", None)],
)
def test_extensions(spark, path, extension):
    assert spark.range(1).select(config.extension(F.lit(path)).alias("e")).first()["e"] == extension


def test_options(spark):
    tokens = F.array(*map(F.lit, ["codec=a", "codec=b=c", "bare", "=x", "codec2="]))
    r = spark.range(1).select(config.flags(config.pairs(tokens, bare=True)).alias("m"), config.option(config.pairs(tokens), "codec").alias("c"), config.flags(config.pairs(F.array().cast("array<string>"))).alias("none")).first()
    assert r["m"] == {"codec": "b=c", "bare": "true", "": "x", "codec2": ""} and r["c"] == "b=c" and r["none"] == {}


@pytest.mark.parametrize(
    ("value", "track", "error"),
    [("3", 3, None), ("+3", 3, None), ("all", None, None), ("*", None, None), ("-1", None, "invalid track: -1"), ("", None, "invalid track: "), ("1e3", None, "invalid track: 1e3"), ("18446744073709551615", 2**64 - 1, None), ("18446744073709551616", None, "invalid track: 18446744073709551616"), ("000000000000000000000007", 7, None)],
)
def test_tracks(spark, value, track, error):
    found = config.track(config.pairs(F.array(F.lit(f"track={value}"))))
    r = spark.range(1).select(found[0].alias("t"), found[1].alias("e")).first()
    assert (None if r["t"] is None else int(r["t"]), r["e"]) == (track, error)


def test_subtitle_needs_a_track_or_a_language(spark):
    error = lambda *t: spark.range(1).select(config.subtitle(F.array(*map(F.lit, t)))["error"].alias("e")).first()["e"]
    assert error("codec=srt") == error("codec=srt", "track=all") == "subtitle needs track or language"
    assert error("codec=srt", "track=0") is error("codec=srt", "language=de") is error("language=de") is None


def plan(spark, source, target, audio=(), video=(), subtitle=(), transform=()):
    jobs = spark.createDataFrame([(source, target, list(audio), list(video), list(subtitle), list(transform))], "input string, output string, a array<string>, v array<string>, s array<string>, t array<string>")
    r = config.plan(jobs, F.col("a"), F.col("v"), F.col("s"), F.col("t")).first()
    return r["route"], r["error"]


@pytest.mark.parametrize(
    ("job", "expected"),
    [
        (("in.wav", "out.wav"), ("wav", None)), (("in.wav", "out.mp4"), ("wav", None)), (("in.mp3", "out.pcm"), ("raw", None)), (("in.mov", "out.mp4"), (None, "webm pipeline not implemented")),
        (("in.mp3", "out.ogg"), (None, "unsupported 'mp3' format")), (("in", "out.wav"), (None, "no file extension")), (("in.txt", "out.wav"), (None, "'txt' is not supported")), (("in.wav", "out.txt"), (None, "'txt' is not supported")),
        (("a.wav", "a.wav"), (None, "input and output are the same file")),
        (("in.wav", "out.wav", ["codec=aac"]), (None, "codec 'aac' not supported in 'wav'")), (("in.mkv", "o.wav", [], ["codec=theora"]), (None, "codec 'theora' not supported in 'mkv'")),
        (("in.mp4", "o.wav", [], [], ["codec=srt", "track=0"]), (None, "format 'srt' not supported in 'mp4'")), (("in.txt", "o.wav", ["track=x"], ["track=y"]), (None, "invalid track: x")), (("in.txt", "o.wav", [], [], [], ["track=z"]), (None, "invalid track: z")),
    ],
)
def test_plans_fail_at_the_first_check(spark, job, expected):
    assert plan(spark, *job) == expected


def test_edges(spark):
    assert compat.edges(spark).count() == 64 and len(compat.CONTAINERS) == 19
    assert {r["kind"]: r["count"] for r in compat.edges(spark).groupBy("kind").count().collect()} == {"video": 22, "audio": 36, "subtitle": 6}


def test_streams(spark):
    rows = spark.createDataFrame([(1, 11, "video", "h264"), (0, 10, "audio", "opus")], "index long, id long, kind string, codec string")
    assert st.listing(rows).first()["listing"] == "stream 0 (Audio) [opus]\nstream 1 (Video) [h264]\n"
    assert st.count_kind(rows, "audio").first()["n"] == 1
    packets = spark.createDataFrame([(0,), (1,), (10,)], "stream_id long")
    assert [r["stream_id"] for r in st.packets_of_kind(packets, rows, "audio").collect()] == [0]
    got = lambda t, n: spark.range(1).select(*(x.alias(k) for k, x in zip("te", st.resolved(F.lit(t).cast("long"), F.lit(n)), strict=True))).first()
    assert got(None, 2)["t"] == [0, 1] and got(1, 2)["t"] == [1] and got(2, 2)["e"] == "track 2 out of bounds (max 1)" and got(0, 0)["e"] == got(None, 0)["e"] == "no streams"
