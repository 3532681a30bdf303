import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import packets as pk
from framewright.sources import register
from framewright.sources.wav import by_file, convert, write_files
from framewright.streaming import packet_stream, pcm_stream, wav_stream, windowed_sizes
from tests.wavfiles import chunk, fmt, info, riff, wav


@pytest.fixture(scope="module")
def sources(spark):
    register(spark)
    return spark


def put(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.wav").write_bytes(data)
    return str(folder)


def heads(spark, folder):
    rows = spark.read.format("wav").options(path=folder, include="header").load().collect()
    return {r["path"].rpartition("/")[2][:-4]: r for r in rows}


def test_heads(sources, tmp_path):
    body = struct.pack("<4h", -32768, -1, 1, 32767)
    folder = put(
        tmp_path, plain=wav(body), before=riff(fmt(), info(IART=b"me", INAM=b"odd"), chunk(b"data", body)), after=riff(fmt(), chunk(b"data", body + b"x"), info(ICOM=b"late", XXXX=b"no")),
        odd=riff(chunk(b"junk", b"abc"), fmt(), chunk(b"data", body)), short=riff(fmt(), b"data" + struct.pack("<I", 1000) + body), empty=wav(b""), many=wav(body, channels=257), code=wav(body, code=65534),
        notriff=b"RIFX" + bytes(20), notwave=b"RIFF" + bytes(4) + b"AVI " + bytes(8), nodata=riff(fmt()), small=riff(chunk(b"fmt ", bytes(12)), chunk(b"data", body)), nofmt=riff(chunk(b"data", body)),
        zero=wav(body, channels=0), adpcm=wav(body, code=17, depth=4), bits=wav(body, depth=12), eight=wav(body, depth=8), whole32=wav(body, depth=32), float32=wav(body, depth=32, code=3), stub=b"RI",
    )
    h = heads(sources, folder)
    assert (h["plain"]["channels"], h["plain"]["sample_rate"], h["plain"]["frames"], h["plain"]["codec"], h["plain"]["supported"], h["plain"]["error"]) == (1, 8000, 4, "pcm_s16le", True, None)
    assert h["before"]["metadata"] == {"artist": "me", "title": "odd"} and h["after"]["metadata"] == {"comment": "late"} and h["odd"]["frames"] == 4
    assert h["short"]["data_size"] == 8 and h["empty"]["frames"] == 0 and h["many"]["channels"] == 1
    assert [h[k]["supported"] for k in ("eight", "whole32", "float32")] == [False, False, True]
    errors = {k: r["error"] for k, r in h.items() if r["error"]}
    assert errors == {
        "code": "audio format code 65534 is not supported", "notriff": "expected RIFF, found RIFX", "notwave": "expected WAVE, found AVI ", "nodata": "unexpected EOF", "small": "fmt chunk too small", "nofmt": "sample rate must be non-zero",
        "zero": "channels must be non-zero", "bits": "bits per sample must be multiple of 8", "stub": "unexpected EOF",
    }


@pytest.mark.parametrize("step", [100, 65536, 200_000])
def test_packets_do_not_depend_on_ranges(sources, tmp_path, step):
    body = np.arange(100_000, dtype="<i2").tobytes()
    folder = put(tmp_path, long=wav(body, channels=3))
    rows = sources.read.format("wav").options(path=folder, range=step).load().orderBy("k").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == body and [r["pts"] for r in rows] == [i * 65532 // 6 for i in range(4)]
    assert [r["size"] for r in rows] == [65532] * 3 + [len(body) - 3 * 65532]


def test_bad_files_fail_or_are_left_out(sources, tmp_path):
    folder = put(tmp_path, good=wav(b"ab"), bad=b"nothing at all")
    with pytest.raises(Exception, match="expected RIFF"):
        sources.read.format("wav").options(path=folder).load().collect()
    assert sources.read.format("wav").options(path=folder, on_error="skip").load().count() == 1
    with pytest.raises(Exception, match="nowhere"):
        sources.read.format("wav").options(path=str(tmp_path / "nowhere")).load().collect()


@pytest.mark.parametrize(("source", "target"), [(16, 24), (24, 16), (16, 32), (32, 24), (16, 16)])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_conversion(sources, tmp_path, source, target, channels):
    n = 3000 * channels
    samples = np.random.default_rng(source).integers(-32768, 32768, n)
    body = {16: samples.astype("<i2").tobytes(), 24: b"".join(int(x * 200).to_bytes(3, "little", signed=True) for x in samples), 32: (samples / 40000).astype("<f4").tobytes()}[source]
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", a=riff(fmt(channels=channels, depth=source, code=3 if source == 32 else 1), info(IART=b"me"), chunk(b"data", body)), b=wav(b"", channels=channels, depth=source, code=3 if source == 32 else 1))
    made = convert(sources, str(tmp_path / "in"), str(tmp_path / "out"), depth=target)
    assert [p.rpartition("/")[2] for p, _ in made.collect()] == ["a.wav"]
    out = heads(sources, str(tmp_path / "out"))["a"]
    assert (out["channels"], out["bit_depth"], out["format_code"], out["frames"], out["metadata"]) == (channels, target, 3 if target == 32 else 1, 3000, {"artist": "me"})
    if target != 32:
        with wave.open(str(tmp_path / "out/a.wav")) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (channels, target // 8, 3000)
            got = w.readframes(3000)
        if source == target:
            assert got == body
        elif source == 24:
            assert np.frombuffer(got, "<i2").tolist() == np.trunc(samples * 200 / 256).astype(int).tolist()


def test_raw_to_wav_and_back(sources, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x.pcm").write_bytes(bytes(range(251)))
    convert(sources, str(tmp_path / "raw"), str(tmp_path / "wav"), source_format="rawpcm", channels="1", sample_rate="8000")
    assert heads(sources, str(tmp_path / "wav"))["x"]["data_size"] == 251
    convert(sources, str(tmp_path / "wav"), str(tmp_path / "again"), container="raw")
    assert (tmp_path / "again/x.raw").read_bytes() == bytes(range(251))
    with pytest.raises(ValueError, match="unsupported 'mp3' format"):
        write_files(sources.range(0), str(tmp_path), "mp3")
    with pytest.raises(Exception, match="files that exist"):
        convert(sources, str(tmp_path / "wav"), str(tmp_path / "wav"))
    assert heads(sources, str(tmp_path / "wav"))["x"]["data_size"] == 251 and not [p for p in (tmp_path / "wav").iterdir() if p.name.startswith("_")]


def test_files_keep_their_places(sources, tmp_path):
    for part in ("a", "b"):
        (tmp_path / "in" / part).mkdir(parents=True)
        put(tmp_path / "in" / part, x=wav(part.encode() * 8))
    made = convert(sources, str(tmp_path / "in"), str(tmp_path / "out"), container="raw")
    assert sorted(r["path"].rpartition("/out/")[2] for r in made.collect()) == ["a/x.raw", "b/x.raw"]
    assert [(tmp_path / "out" / p / "x.raw").read_bytes() for p in "ab"] == [b"a" * 8, b"b" * 8]
    put(tmp_path / "in" / "a", **{"x.old": wav(b"cd")})
    (tmp_path / "in/a/x.old.wav").rename(tmp_path / "in/a/x.WAV")
    with pytest.raises(ValueError, match="would both be a/x.raw"):
        convert(sources, str(tmp_path / "in"), str(tmp_path / "twice"), container="raw")
    assert not (tmp_path / "twice").exists()


def test_bytes_that_end_early_are_errors(sources, tmp_path):
    whole = riff(fmt(), info(IART=b"me"), chunk(b"data", b"abcd"))
    folder = put(tmp_path, **{f"n{i:03d}": whole[:i] for i in range(len(whole))}, list=riff(fmt(), b"LIST" + struct.pack("<I", 2**31) + b"INFOIART" + struct.pack("<I", 2**30) + b"x"))
    found = heads(sources, folder)
    assert all(r["error"] for k, r in found.items() if k < f"n{whole.index(b'data') + 8:03d}") and found["list"]["error"] == "unexpected EOF"
    assert found[f"n{len(whole) - 1:03d}"]["data_size"] == 3


def test_a_failed_job_leaves_no_files(sources, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", good=wav(b"abcd"), odd=wav(b"abc"))
    with pytest.raises(Exception, match="invalid pcm16 length"):
        convert(sources, str(tmp_path / "in"), str(tmp_path / "out"), depth=24)
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_writer(sources, tmp_path):
    rows = [(f"d/{i % 3}.wav", i // 3, bytearray([i] * 2), 1, 8000, 16, {"title": "t"} if i < 3 else None) for i in range(30)]
    packets = sources.createDataFrame(rows, "path string, k long, data binary, channels int, sample_rate long, bit_depth int, metadata map<string,string>").repartition(5)
    by_file(packets).write.format("wav").mode("append").save(str(tmp_path / "out"))
    for j in range(3):
        with wave.open(str(tmp_path / f"out/d/{j}.wav")) as w:
            assert w.readframes(100) == b"".join(bytes([i] * 2) for i in range(j, 30, 3))
    read = sources.read.format("wav").options(path=str(tmp_path / "out")).load()
    assert read.count() == 3 and {r["metadata"]["title"] for r in read.collect()} == {"t"} and {r["name"] for r in read.collect()} == {"d/0.wav", "d/1.wav", "d/2.wav"}
    with pytest.raises(Exception, match="files that exist"):
        by_file(packets).write.format("wav").mode("append").save(str(tmp_path / "out"))
    by_file(packets.filter("k = 0")).write.format("wav").mode("overwrite").save(str(tmp_path / "out"))
    assert sources.read.format("wav").options(path=str(tmp_path / "out")).load().agg(F.sum("size")).first()[0] == 6
    with pytest.raises(Exception, match="by_file"):
        by_file(packets).filter("k <> 1").write.format("rawpcm").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").iterdir())


def test_small_files_share_a_task(sources, tmp_path):
    put(tmp_path, **{f"f{i}": wav(bytes([i]) * 40) for i in range(40)})
    frame = sources.read.format("wav").options(path=str(tmp_path)).load()
    assert frame.rdd.getNumPartitions() == 1 and frame.agg(F.sum("size")).first()[0] == 1600


def test_packets_of_columns(spark):
    rows = spark.createDataFrame([("a", bytearray(range(10))), ("b", bytearray()), ("c", None)], "path string, content binary")
    for limit in (1, 4, 6, 1000):
        packets = pk.packetize(rows, "content", F.lit(16), F.lit(2), limit, ("path",)).cache()
        assert bytes(pk.mux(packets, "path").first()["data"]) == bytes(range(10))
        assert [r["pts"] for r in packets.orderBy("k").collect()] == [i * max(4, limit // 4 * 4) // 4 for i in range(packets.count())]
    frames = pk.decode(pk.packetize(rows, "content", F.lit(16), F.lit(1), 4, ("path",)), F.lit(16), F.lit(1))
    assert frames.count() == 3 and bytes(pk.mux(pk.encode(frames, F.lit(16)), "path").first()["data"]) == bytes(range(10))


def test_streaming(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    (folder / "a.pcm").write_bytes(b"\1\0" * 10)
    out = pcm_stream(packet_stream(spark, str(folder), channels=1, limit=8), 16, 24)
    q = out.writeStream.format("memory").queryName("live_packets").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (folder / "b.pcm").write_bytes(b"\2\0" * 3)
    q.processAllAvailable()
    q.stop()
    rows = spark.table("live_packets").collect()
    assert sorted((r["path"][-5:], r["k"], r["pts"], len(r["data"])) for r in rows) == [("a.pcm", 0, 0, 12), ("a.pcm", 1, 4, 12), ("a.pcm", 2, 8, 6), ("b.pcm", 0, 0, 9)]


def test_wav_streaming(spark, tmp_path):
    folder = tmp_path / "live"
    folder.mkdir()
    put(folder, a=wav(bytes(range(10)), channels=1))
    (folder / "other.txt").write_bytes(b"no")
    q = wav_stream(spark, str(folder), limit=4).writeStream.format("memory").queryName("live_wavs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put(folder, b=riff(fmt(depth=24, channels=2), info(IART=b"me"), chunk(b"data", bytes(6))))
    q.processAllAvailable()
    q.stop()
    rows = spark.table("live_wavs").collect()
    assert sorted((r["path"][-5:], r["k"], r["pts"], bytes(r["data"]), r["bit_depth"]) for r in rows) == [("a.wav", 0, 0, bytes(range(4)), 16), ("a.wav", 1, 2, bytes(range(4, 8)), 16), ("a.wav", 2, 4, bytes([8, 9]), 16), ("b.wav", 0, 0, bytes(6), 24)]


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("user_id") % 7).alias("stream_id"), F.floor("value").alias("size"))
    per = windowed_sizes(events.withColumn("ts", F.col("ts").cast("timestamp")), window="1 day")
    assert per.agg(F.sum("n_packets")).first()[0] == events.count()


def test_folders_stay_until_cleared(spark):
    from pathlib import Path

    from framewright.sources import files

    folder = files.new_folder(spark, "kept")
    spark.range(3).write.parquet(folder)
    local = Path(folder.removeprefix("file:"))
    assert local.exists()
    files.clear(spark)
    assert not local.exists() and files._made == []
