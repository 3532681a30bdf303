"""Joins by time, sessions, cues, and streams with state, against plain versions."""

import random
import time as clock

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import subtitles, table
from framewright.operators import timejoins as tj
from framewright.plans.subtitles import convert_subtitles, shift_ms
from framewright.sources.riff import WavError
from framewright.streaming.pieces import demuxed, sessions_and_late
from tests import wavfiles


def rows_of(seed, n, keys, most):
    rng = random.Random(seed)
    return [(rng.choice(keys), rng.choice([None, *range(-most, most)]) if i % 9 == 0 else rng.randrange(-most, most), i) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 5])
@pytest.mark.parametrize("width", [3, 10_000])
def test_asof_against_all_pairs(spark, direction, tolerance, width):
    left, right = rows_of(1, 120, ["a", "b", "only left", None], 100), rows_of(2, 90, ["a", "b", None], 60)
    left += left[:5]
    a, b = (spark.createDataFrame(x, "key string, at long, id int") for x in (left, right))
    got = tj.asof_join(a, b, ["key"], "at", ["id"], width, direction, tolerance).collect()
    want = []
    for key, at, i in left:
        turn = 1 if direction == "backward" else -1
        fits = [(turn * t, j) for k, t, j in right if None not in (key, at, k, t) and k == key and turn * t <= turn * at and (tolerance is None or abs(at - t) <= tolerance)]
        best = max(fits, default=None)
        want.append((key, at, i, None if best is None else (turn * best[0], best[1])))
    assert sorted(map(str, ((*r[:3], None if r[3] is None else tuple(r[3])) for r in got))) == sorted(map(str, want))


def test_asof_of_nothing(spark):
    a, b = spark.createDataFrame([("a", 1, 1)], "key string, at long, id int"), spark.createDataFrame([], "key string, at long, id int")
    assert [r["found"] for r in tj.asof_join(a, b, ["key"], "at", ["id"], 10).collect()] == [None]
    assert tj.asof_join(b, a, ["key"], "at", ["id"], 10).collect() == []
    with pytest.raises(ValueError):
        tj.asof_join(a, b, ["key"], "at", ["id"], 10, found="id")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_intervals_against_all_pairs(spark, width):
    rng = random.Random(width)
    points = rows_of(3, 150, ["a", "b", None], 500)
    spans = [(rng.choice(["a", "b", None]), s, s + rng.choice([-3, 0, 1, 2, 5, 64, 65, 1000]), i) for i, s in enumerate(rng.randrange(-600, 600) for _ in range(60))] + [("a", None, 5, 90), ("a", 5, None, 91), ("a", -(2**40), 2**40, 92)]
    spans += spans[:3]
    p, s = spark.createDataFrame(points, "key string, at long, id int"), spark.createDataFrame(spans, "key string, begin long, until long, span int")
    out = tj.interval_join(p, s, ["key"], "at", "begin", "until", ["span"], width)
    want = [(k, t, i, b, e, j) for k, t, i in points for k2, b, e, j in spans if None not in (k, t, b, e) and k == k2 and b <= t < e]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_intervals_of_nothing(spark):
    p, s = spark.createDataFrame([("a", 1, 1)], "key string, at long, id int"), spark.createDataFrame([], "key string, begin long, until long, span int")
    assert tj.interval_join(p, s, ["key"], "at", "begin", "until", ["span"], 10).collect() == []


# --- Cues ----------------------------------------------------------------------------------------------------


def test_cues_of_odd_texts(spark):
    srt = "﻿1\r\n00:00:01,500 --> 00:00:02,000 X1:1\r\nfirst\r\nline\r\n\r\n\r\n2\r\n100:00:00,001 --> 100:00:03,000\r\n\r\nno times here\r\n\r\n00:00:05,000 --> 00:00:04,000\r\nback"
    vtt = "WEBVTT\n\nNOTE a\nnote --> here\n\nname of it\n01:02.003 --> 01:03.004 align:left\n<i>x</i>\n \n\t\nSTYLE\n::cue {}\n"
    rows = spark.createDataFrame([(1, srt), (2, vtt), (3, None), (4, ""), (5, "a\rb\r\r00:00:00,000 --> 00:00:00,001\rc")], "id int, text string")
    got = [tuple(r) for r in subtitles.cues(rows, "text", ("id",)).orderBy("id", "cue").collect()]
    assert got == [
        (1, 0, "1", 1500, 2000, "first\nline"), (1, 1, "2", 360_000_001, 360_003_000, ""), (1, 2, "", 5000, 4000, "back"),
        (2, 0, "name of it", 62_003, 63_004, "<i>x</i>"), (5, 0, "", 0, 1, "c"),
    ]


@pytest.mark.parametrize("width", [5, 10**6])
def test_overlaps_against_counting(spark, width):
    rng = random.Random(4)
    cues = [(rng.choice(["a", "b", None]), s, s + rng.choice([-1, 0, 1, 3, 10, 40])) for s in (rng.randrange(0, 120) for _ in range(60))] + [("a", None, 4)]
    got = subtitles.overlaps(spark.createDataFrame(cues, "film string, start_ms long, end_ms long"), ("film",), width).collect()
    open_at = lambda film, t: sum(f == film and s is not None and s <= t < e for f, s, e in cues)
    for film in ("a", "b", None):
        own = {t: r["n"] for r in got if r["film"] == film for t in range(r["from_ms"], r["to_ms"])}
        assert own == {t: open_at(film, t) for t in range(200) if open_at(film, t) >= 2}


def test_subtitle_options_are_carried_out(spark, tmp_path):
    (tmp_path / "in" / "in").mkdir(parents=True)
    (tmp_path / "in" / "in" / "a.srt").write_text("1\n00:00:05,000 --> 00:00:06,500\nlater é\n\n2\n00:00:01,000 --> 00:00:02,000\nfirst\nline\n\n3\n00:00:00,100 --> 00:00:00,900\ngone\n", encoding="utf-8")
    (tmp_path / "in" / "b.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nx\n")
    (tmp_path / "in" / "none.srt").write_text("no cues")
    made = convert_subtitles(spark, str(tmp_path / "in"), str(tmp_path / "out"), "vtt", ["shift=-1.5", "language=en"])
    assert sorted(r["path"].rpartition("/out/")[2] for r in made.collect()) == ["b.vtt", "in/a.vtt"]
    assert (tmp_path / "out" / "in" / "a.vtt").read_text(encoding="utf-8") == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:00.500\nfirst\nline\n\n2\n00:00:03.500 --> 00:00:05.000\nlater é\n\n"
    convert_subtitles(spark, str(tmp_path / "out"), str(tmp_path / "back"))
    assert (tmp_path / "back" / "b.srt").read_text() == "1\n00:00:00,000 --> 00:00:00,500\nx\n\n"
    assert [shift_ms(x) for x in ("2", "-0.001", "1e1")] == [2000, -1, 10_000]
    for bad in ("shift=x", "shift=0.0001", "color=red"):
        with pytest.raises(ValueError):
            convert_subtitles(spark, str(tmp_path / "in"), str(tmp_path / "never"), "srt", [bad])


# --- The table function ----------------------------------------------------------------------------------------


def test_table_function(spark):
    table.register(spark)
    raw = wavfiles.wav(bytes(range(50)), channels=2)
    files = spark.createDataFrame([("a", raw), ("b", None), ("c", wavfiles.wav(b""))], "path string, content binary")
    got = spark.sql("select f.path, p.* from {files} f, lateral demux(f.content, 'wav', null, null, 10) p", files=files).orderBy("k").collect()
    assert [(r["path"], r["k"], bytes(r["data"]), r["pts"], r["channels"], r["sample_rate"]) for r in got] == [("a", i, bytes(range(50))[8 * i : 8 * i + 8], 2 * i, 2, 8000) for i in range(7)]
    with pytest.raises(Exception, match="unsupported 'mp3' format"):
        spark.sql("select * from demux(X'00', 'mp3', 16, 1, 10)").collect()
    with pytest.raises(Exception, match="expected RIFF"):
        spark.sql("select * from demux(X'000102030405060708090a0b0c0d', 'wav', 16, 1, 10)").collect()


# --- Streams with state -----------------------------------------------------------------------------------------


@pytest.fixture()
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run_batches(spark, tmp_path, batches, schema, build):
    """Each batch in a run of its own that begins from the checkpoint of the one before."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).collect()


def test_pieces_are_demuxed_like_whole_files(spark, tmp_path, state_store):
    rng = np.random.default_rng(11)
    files = {
        "a.wav": wavfiles.wav(rng.bytes(1001), channels=2), "b.wav": wavfiles.riff(wavfiles.info(INAM=b"n"), wavfiles.fmt(depth=24), wavfiles.chunk(b"data", rng.bytes(300)), wavfiles.info(IART=b"late")),
        "bad.wav": b"RIFX" + rng.bytes(100), "short.wav": wavfiles.wav(b"1234")[:30], "gone.wav": wavfiles.wav(rng.bytes(90)),
    }
    batches = [[], [], []]
    for p, raw in files.items():
        cuts = [0, *sorted(int(x) for x in rng.integers(1, len(raw), 9)), len(raw)]
        pieces = [(p, i, raw[a:b], b == len(raw)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        if p == "gone.wav":
            del pieces[4]
        order = rng.permutation(len(pieces))
        for j, i in enumerate(order):
            batches[j % 3].append(pieces[i])
        batches[2].append(pieces[0])
    rows = run_batches(spark, tmp_path, batches, "path string, seq long, data binary, last boolean", lambda s: demuxed(s, limit=64))
    got = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["k"])):
        got.setdefault(r["path"], []).append(r)
    for p, depth, channels in (("a.wav", 16, 2), ("b.wav", 24, 1)):
        data = files[p][files[p].index(b"data") + 8 :][: 1001 if p == "a.wav" else 300]
        step = 64 - 64 % (depth // 8 * channels)
        assert [(r["k"], bytes(r["data"]), r["pts"], r["channels"], r["bit_depth"]) for r in got[p]] == [(k, data[at : at + step], at // (depth // 8 * channels), channels, depth) for k, at in enumerate(range(0, len(data), step))]
    assert [r["error"] for r in got["bad.wav"]] == ["expected RIFF, found RIFX"]
    assert [r["error"] for r in got["short.wav"]] == ["unexpected EOF"]
    assert all(r["error"] is None for r in got.get("gone.wav", []))


def test_idle_files_are_closed(spark, tmp_path, state_store):
    """A headless file ends when no piece has come for a while; a missing piece is said."""
    schema = "path string, seq long, data binary, last boolean"
    spark.createDataFrame([("r", 0, b"12345", False), ("lost", 1, b"xx", True)], schema).write.parquet(str(tmp_path / "in"))
    stream = demuxed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), {"channels": 1, "sample_rate": 8000, "depth": 16}, limit=4, idle_ms=500)
    query = stream.writeStream.format("memory").queryName("idle_files").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            rows = spark.table("idle_files").collect()
            if len(rows) == 3:
                break
            clock.sleep(1)
    finally:
        query.stop()
    assert sorted((r["path"], r["k"], r["data"] and bytes(r["data"]), r["error"]) for r in rows) == [("lost", 0, None, "piece 0 is missing"), ("r", 0, b"1234", None), ("r", 1, b"5", None)]
    with pytest.raises(WavError):
        demuxed(stream, {"channels": 0, "sample_rate": 8000, "depth": 16})


def test_sessions_and_late_rows(spark, tmp_path, state_store):
    batches = [
        [("a", 1000, 1), ("a", 1900, 2), ("b", 50, 7), ("a", 5000, 3), ("n", None, 1)],
        [("a", 5500, 4), ("a", 3100, 5), ("a", 2999, 6), ("b", 40, None)],
        [("a", 20_000, 8), ("b", 9_000, 1), ("a", 3500, 9)],
    ]
    rows = run_batches(spark, tmp_path, batches, "user string, at long, size long", lambda s: sessions_and_late(s, "user", "at", "size", 1000, 2000))
    # After the first batch a's newest time is 5000: 2999 is behind 3000, 3100 isn't. After the second 5500: 3500 isn't behind it.
    assert sorted(tuple(r) for r in rows) == sorted([
        ("a", 1000, 2900, 2, 3, False), ("a", 2999, 2999, 1, 6, True), ("a", 3100, 4500, 2, 14, False), ("a", 5000, 6500, 2, 7, False), ("b", 40, 1050, 2, 7, False),
    ])


def test_session_windows_of_a_stream(spark, tmp_path):
    """Spark's own sessions on a stream: a row behind the watermark is dropped, sessions leave with it."""
    schema = "user string, ts timestamp, size long"
    source, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))
    at = lambda text, size, user="u": (user, text, size)
    for batch in ([at("2024-01-01 00:00:00", 1), at("2024-01-01 00:00:30", 2)], [at("2024-01-01 02:00:00", 4)], [at("2024-01-01 00:01:00", 8), at("2024-01-01 05:00:00", 16)]):
        spark.createDataFrame(batch, "user string, ts string, size long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "10 minutes")
        found = tj.sessions(stream, ["user"], "ts", "1 minute", F.sum("size").alias("total"))
        found.writeStream.format("parquet").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r["total"], r["n"]) for r in spark.read.parquet(out).collect())
    assert got == [(3, 2), (4, 1)]
