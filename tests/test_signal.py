"""ADPCM, sample rates, chains, mixing and files' digests against plain versions."""

import math
import struct
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import adpcm, checksums
from framewright.functions.pcm import encode_array
from framewright.operators import chain, mix
from framewright.operators import packets as pk
from framewright.operators import resample as rs
from framewright.plans.audio import convert_audio
from framewright.sources import register
from framewright.sources.riff import WavError, head_of_prefix, read_head
from framewright.sources.wav import convert
from tests import wavfiles

# --- ADPCM ------------------------------------------------------------------------------------------------


def plain_decode(block: bytes, channels: int) -> list[list[int]]:
    """One block, sample by sample."""
    state = [list(struct.unpack_from("<hB", block, 4 * c)) for c in range(channels)]
    out = [[v] for v, _ in state]
    body, places = block[4 * channels :], []
    if channels == 1:
        places = [(0, b & 15) for x in body for b in (x, x >> 4)]
    else:
        for g in range(len(body) // (4 * channels)):
            for c in range(channels):
                places += [(c, n & 15) for x in body[(g * channels + c) * 4 : (g * channels + c) * 4 + 4] for n in (x, x >> 4)]
    for c, code in places:
        value, index = state[c][0], min(state[c][1], 88)
        step = adpcm.STEPS[index]
        change = step // 8 + (step if code & 4 else 0) + (step // 2 if code & 2 else 0) + (step // 4 if code & 1 else 0)
        value = max(-32768, min(32767, value - change if code & 8 else value + change))
        state[c] = [value, max(0, min(88, index + adpcm.INDEX_STEPS[code & 7]))]
        out[c].append(value)
    return out


@pytest.mark.parametrize("channels, block", [(1, 36), (1, 5), (2, 72), (2, 512), (3, 36), (6, 48), (1, 2048)])
def test_blocks_against_a_plain_decoder(channels, block):
    rng = np.random.default_rng(channels * block)
    rows = rng.integers(0, 256, (7, block), dtype=np.uint8)
    got = adpcm.decode_blocks(rows, channels)
    assert [x.T.tolist() for x in got] == [plain_decode(bytes(r), channels) for r in rows]
    assert got.shape[1] == adpcm.frames_of(block, channels)


@pytest.mark.parametrize("channels", [1, 2, 5])
def test_encoded_blocks_come_near(channels):
    t = np.arange(505 if channels > 1 else 1017)
    wave = (np.stack([9000 * np.sin(t / (20 + 5 * c)) + 50 * c for c in range(channels)], axis=-1)).astype(np.int16)
    for samples in (wave[None], np.zeros((1, 9, channels), np.int16), np.full((1, 2, channels), -32768, np.int16), np.array([[[32767] * channels, [-32768] * channels] * 40], np.int16)):
        blocks = adpcm.encode_blocks(samples)
        back = adpcm.decode_blocks(blocks, channels)[:, : samples.shape[1]]
        assert (back[:, 0] == samples[:, 0]).all()
        assert [x.T.tolist() for x in adpcm.decode_blocks(blocks, channels)] == [plain_decode(bytes(b), channels) for b in blocks]
    back = adpcm.decode_blocks(adpcm.encode_blocks(wave[None]), channels)[0, : len(wave)]
    assert np.abs(back.astype(int) - wave).mean() < 150


def test_adpcm_packets(spark):
    """Packets of several blocks, a short last one, odd ones."""
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 36 * 4 + 11, dtype=np.uint8).tobytes()
    rows = [(1, raw, 1, 36), (2, raw[:38], 1, 36), (3, b"", 1, 36), (4, None, 1, 36), (5, raw, 0, 36), (6, raw[: 72 + 16], 2, 72), (7, raw, 1, 4), (8, raw, None, 36)]
    got = {r["id"]: r["data"] for r in pk.decode_adpcm(spark.createDataFrame(rows, "id int, data binary, ch int, block int"), F.col("ch"), F.col("block")).collect()}
    assert set(got) == {1, 2, 5, 6, 7, 8} and got[2] is got[5] is got[7] is got[8] is None
    flat = lambda parts, ch: b"".join(struct.pack("<h", block[c][i]) for block in (plain_decode(p, ch) for p in parts) for i in range(len(block[0])) for c in range(ch))
    assert bytes(got[1]) == flat([raw[i : i + 36] for i in range(0, len(raw), 36)], 1)
    assert bytes(got[6]) == flat([raw[:72], raw[72:88]], 2)
    pcm = rng.integers(-3000, 3000, 2 * 400).astype("<i2").tobytes()
    back = spark.createDataFrame([(1, pcm, 2, 72), (2, pcm[:6], 2, 72), (3, pcm[:4], 2, 72)], "id int, data binary, ch int, block int")
    coded = {r["id"]: r["data"] for r in pk.encode_adpcm(back, F.col("ch"), F.col("block")).collect()}
    assert coded[2] is None and len(coded[3]) == 8 and len(coded[1]) == 6 * 72 + adpcm.encode_blocks(np.zeros((1, 400 - 6 * 65, 2), np.int16)).shape[1]


def test_adpcm_files(spark, tmp_path):
    """A file of blocks is read as packets of whole blocks, and converted."""
    register(spark)
    rng = np.random.default_rng(4)
    body = rng.integers(0, 256, 512 * 5 + 100, dtype=np.uint8).tobytes()
    fmt = wavfiles.chunk(b"fmt ", struct.pack("<HHIIHHHH", 17, 1, 8000, 4055, 512, 4, 2, 1017))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wavfiles.riff(fmt, wavfiles.chunk(b"data", body)))
    # Without a block size in its head, a block has 512 bytes.
    bare = wavfiles.chunk(b"fmt ", struct.pack("<HHIIHHHH", 17, 1, 8000, 0, 0, 4, 2, 1017))
    (tmp_path / "in" / "b.wav").write_bytes(wavfiles.riff(bare, wavfiles.chunk(b"data", body)))
    rows = spark.read.format("wav").options(path=str(tmp_path / "in"), limit=1200).load().orderBy("name", "k").collect()
    assert [(r["name"], r["k"], r["pts"], r["size"]) for r in rows] == [(n, k, 2 * 1017 * k, s) for n in ("a.wav", "b.wav") for k, s in enumerate([1024, 1024, 612])]
    head = spark.read.format("wav").options(path=str(tmp_path / "in"), include="header").load().first()
    assert (head["codec"], head["supported"], head["frames"], head["error"]) == ("adpcm_ima_wav", True, 5 * 1017 + adpcm.frames_of(100, 1), None)
    convert(spark, str(tmp_path / "in"), str(tmp_path / "out"), depth=16)
    want = b"".join(struct.pack(f"<{len(x[0])}h", *x[0]) for x in (plain_decode(body[i : i + 512], 1) for i in range(0, len(body), 512)))
    for name in "ab":
        made = (tmp_path / "out" / f"{name}.wav").read_bytes()
        assert made[44:] == want and struct.unpack_from("<HHIIHH", made, 20) == (1, 1, 8000, 16000, 2, 16)


# --- Heads -------------------------------------------------------------------------------------------------


def test_long_metadata_is_read_whole():
    """A comment of two MiB stands before the title, another of unknown kind between."""
    long = wavfiles.chunk(b"LIST", b"INFO" + wavfiles.chunk(b"ICOM", b"c" * (2 << 20)) + wavfiles.chunk(b"IXXX", b"x" * (3 << 20)) + wavfiles.chunk(b"INAM", b"a title\0"))
    for raw in (wavfiles.riff(wavfiles.fmt(), long, wavfiles.chunk(b"data", b"1234")), wavfiles.riff(wavfiles.fmt(), wavfiles.chunk(b"data", b"1234"), long)):
        asked = []
        head = read_head(lambda at, n, raw=raw: (asked.append(n), raw[at : at + n])[1], len(raw))
        assert head.metadata == {"comment": "c" * (2 << 20), "title": "a title"}
        assert 3 << 20 not in asked
        cut = read_head(lambda at, n, raw=raw: raw[at : at + n], len(raw) - 8 if raw.endswith(b"title\0") else len(raw))
        assert "comment" in cut.metadata


def test_data_ahead_of_its_format():
    raw = wavfiles.riff(wavfiles.chunk(b"data", b"1234"), wavfiles.fmt())
    with pytest.raises(WavError, match="^sample rate must be non-zero$"):
        read_head(lambda at, n: raw[at : at + n], len(raw))


def test_heads_of_prefixes():
    raw = wavfiles.riff(wavfiles.info(INAM=b"name"), wavfiles.fmt(channels=2), wavfiles.chunk(b"data", b"x" * 40))
    at = raw.index(b"data") + 8
    assert [head_of_prefix(raw[:n]) is None for n in range(at + 3)] == [True] * at + [False] * 3
    head = head_of_prefix(raw[:at])
    assert (head.data_at, head.data_size, head.channels, head.metadata) == (at, 40, 2, {"title": "name"})


# --- Sample rates ------------------------------------------------------------------------------------------


def cut_up(rng, samples, channels, most):
    """Rows (pts, samples) of frames in packets of any size."""
    frames, at, out = samples.reshape(-1, channels), 0, []
    while at < len(frames):
        n = int(rng.integers(1, most + 1))
        out.append((at, frames[at : at + n].ravel().tolist()))
        at += n
    return out


@pytest.mark.parametrize("rate, target, channels, most", [(8000, 16000, 1, 3), (44100, 48000, 2, 700), (48000, 8000, 1, 5000), (44100, 44100, 3, 50), (22050, 16000, 6, 999)])
def test_packets_are_filtered_like_whole_files(spark, rate, target, channels, most):
    rng = np.random.default_rng(rate)
    whole = {p: rng.uniform(-1, 1, n * channels).astype(np.float32) for p, n in (("a", 2500), ("b", 1), ("c", 40))}
    rows = [(p, pts, s, channels, rate, "x") for p, x in whole.items() for pts, s in cut_up(rng, x, channels, most)]
    rows += [("none", 0, None, channels, rate, "x"), ("empty", 0, [], channels, rate, "x"), ("off", 0, [0.5], 0, rate, "x"), ("still", 0, [0.5], channels, 0, "x")]
    packets = spark.createDataFrame(rows, "path string, pts long, samples array<float>, channels int, sample_rate long, k string").repartition(7)
    got = {}
    for r in rs.resample(packets, target, chunk=512).orderBy("path", "pts").collect():
        assert r["pts"] * channels == sum(map(len, got.setdefault(r["path"], []))) and r["sample_rate"] == target
        got[r["path"]].append(r["samples"])
    up, down = rs.ratio(rate, target)
    assert set(got) == set(whole)
    for p, x in whole.items():
        frames = x.reshape(-1, channels).astype(np.float64)
        n = -(-len(frames) * up // down)
        want = frames if up == down else rs.filtered(frames, 0, 0, n, up, down)
        assert np.array_equal(np.concatenate(got[p]), want.astype(np.float32).ravel())


def test_filter_against_its_definition():
    """A few outputs summed straight from the windowed sinc; a constant and a tone come through."""
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (300, 1))
    up, down = rs.ratio(44100, 48000)
    half, got = rs.reach(up, down), rs.filtered(x, 0, 0, 320, up, down)
    for m in (0, 1, 100, 319):
        t = m * down / up
        at = np.arange(int(t) + 1 - half, int(t) + half + 1)
        w = np.sinc((at - t) * rs.BAND) * (0.5 + 0.5 * np.cos(np.pi * np.clip((at - t) / half, -1, 1)))
        values = np.array([x[i, 0] if 0 <= i < 300 else 0.0 for i in at])
        assert abs(got[m, 0] - (w * values).sum() / w.sum()) < 1e-9
    assert np.allclose(rs.filtered(np.ones((400, 1)), 0, 150, 200, 160, 147), 1.0)
    tone = lambda rate, n: np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    made = rs.filtered(tone(48000, 4800)[:, None], 0, 0, 800, *rs.ratio(48000, 8000))[:, 0]
    assert np.abs(made - tone(8000, 800))[100:700].max() < 0.01
    high = rs.filtered(np.sin(2 * np.pi * 7000 * np.arange(4800) / 48000)[:, None], 0, 0, 800, *rs.ratio(48000, 8000))
    assert np.abs(high[100:700]).max() < 0.01


def test_resample_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, pts long, samples array<float>, channels int, sample_rate long")
    assert rs.resample(empty, 8000).collect() == []
    with pytest.raises(ValueError):
        rs.ratio(0, 8000)


def test_remix(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0, 5.0, 7.0]), (3, [1.0, 2.0, 3.0]), (2, []), (2, None)], "ch int, s array<float>")
    one, two, four = ([r["x"] for r in df.select(rs.remix(F.col("s"), F.col("ch"), n).alias("x")).collect()] for n in (1, 2, 4))
    assert one == [[1, 2], [2, 6], [2], [], None]
    assert two == [[1, 1, 2, 2], [1, 3, 5, 7], [1, 2], [], None]
    assert four[1] == [1, 3, 0, 0, 5, 7, 0, 0]


# --- Chains ------------------------------------------------------------------------------------------------


def test_parsing_chains():
    assert chain.parse(["track=1", "trim=1-2.5", "reverse", "filter_chain=fade:in,normalize,speed=2,trim:-3", "fade=out:0.5"]) == (
        chain.Step("trim", (Decimal(1), Decimal("2.5"))), chain.Step("reverse"), chain.Step("fade", ("in", chain.FADE)), chain.Step("normalize", (Decimal(1),)),
        chain.Step("speed", (Decimal(2),)), chain.Step("trim", (None, Decimal(3))), chain.Step("fade", ("out", Decimal("0.5"))),
    )
    for bad in ("trim=x", "trim=2-1", "trim", "trim=-1--2", "fade=up", "fade=in:x", "speed=0", "speed", "gain=nan", "rotate=90", "reverse=no", "filter_chain=a,b"):
        with pytest.raises(ValueError):
            chain.parse([bad])


def plain_chain(x, channels, rate, steps):
    frames = np.array(x, np.float64).reshape(-1, channels)
    for s in steps:
        at = lambda v: math.ceil(v * rate)
        if s.name == "trim":
            frames = frames[at(s.values[0]) if s.values[0] is not None else 0 : at(s.values[1]) if s.values[1] is not None else None]
        elif s.name == "reverse":
            frames = frames[::-1]
        elif s.name == "fade":
            over, i = max(1, at(s.values[1])), np.arange(len(frames))
            frames = frames * np.minimum((i if s.values[0] == "in" else len(frames) - 1 - i) / over, 1.0)[:, None]
        elif s.name == "gain":
            frames = frames * float(s.values[0])
        elif s.name == "normalize":
            top = np.abs(frames).max(initial=0)
            frames = frames * float(s.values[0]) / top if top else frames
    return frames.ravel()


@pytest.mark.parametrize("options", [["trim=0.01-0.2"], ["trim=0.0001-"], ["trim=-0.05", "reverse", "trim=0.01-0.02"], ["reverse", "fade=in:0.1", "fade=out:0.3"], ["normalize=0.5", "filter_chain=gain:2,reverse"], ["trim=5-6"], []])
def test_chains_against_whole_files(spark, options):
    rng = np.random.default_rng(8)
    files = {"a": (1, 1000, 400), "b": (2, 8000, 300), "c": (3, 999, 1), "d": (1, 48000, 2000)}
    data = {p: rng.uniform(-1, 1, ch * n).astype(np.float32) for p, (ch, _, n) in files.items()}
    data["z"], files["z"] = np.zeros(30, np.float32), (1, 1000, 30)
    rows = [(p, pts, len(s) // files[p][0], s, files[p][0], files[p][1]) for p, x in data.items() for pts, s in cut_up(rng, x, files[p][0], 37)]
    frames = spark.createDataFrame(rows, "path string, pts long, nb_samples long, samples array<float>, channels int, sample_rate long").repartition(5)
    steps = chain.parse(options)
    got = {}
    for r in chain.apply(frames, steps).orderBy("path", "pts").collect():
        ch = files[r["path"]][0]
        assert r["pts"] * ch == len(got.setdefault(r["path"], [])) and len(r["samples"]) == r["nb_samples"] * ch
        got[r["path"]] += r["samples"]
    for p, x in data.items():
        assert np.allclose(got.get(p, []), plain_chain(x, files[p][0], files[p][1], steps), rtol=0, atol=1e-12)


def test_speed(spark):
    x = np.sin(np.arange(4000) / 9).astype(np.float32)
    frames = spark.createDataFrame([("a", 0, 4000, x.tolist(), 1, 8000)], "path string, pts long, nb_samples long, samples array<float>, channels int, sample_rate long")
    r = chain.apply(frames, chain.parse(["speed=2"])).first()
    assert (r["sample_rate"], r["nb_samples"]) == (8000, 2000)
    assert np.abs(np.array(r["samples"]) - np.sin(np.arange(2000) * 2 / 9))[50:1950].max() < 0.01


# --- Mixing ------------------------------------------------------------------------------------------------


def test_mix_against_one_sum(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        ch = 2 if i % 3 == 0 else 1
        rows.append((["x", "y", None][i % 3], int(rng.integers(-20, 900)), float(rng.uniform(0, 2)), rng.uniform(-1, 1, ch * int(rng.integers(0, 300))).astype(np.float32).tolist(), ch))
    rows += [rows[5], ("y", None, 1.0, [1.0], 1), ("y", 3, 1.0, None, 1), ("y", 3, 1.0, [1.0], None), ("x", 5000, 1.0, [0.25, 0.5], 2)]
    tracks = spark.createDataFrame(rows, "mix string, start long, gain double, samples array<float>, channels int")
    want, count = {}, Counter()
    for m, start, gain, samples, ch in rows:
        if start is None or samples is None or ch is None:
            continue
        frames = np.array(samples).reshape(-1, ch)
        for i, f in enumerate(frames):
            if start + i >= 0:
                want.setdefault((m, start + i), np.zeros(ch, np.int64))
                want[m, start + i] += np.rint(f.astype(np.float64) * gain * mix.UNIT).astype(np.int64)
        for k in {(start + i) // 128 for i in range(len(frames)) if start + i >= 0}:
            count[m, k] += 1
    got = mix.mix(tracks, F.col("start"), F.col("gain"), chunk=128).collect()
    assert {(r["mix"], r["k"]): r["n_tracks"] for r in got} == dict(count)
    for r in got:
        frames = np.array(r["samples"]).reshape(-1, r["channels"])
        assert (r["mix"], r["pts"] + len(frames) - 1) in want
        for i, f in enumerate(frames):
            assert np.array_equal(f, want.get((r["mix"], r["pts"] + i), np.zeros(r["channels"], np.int64)) / mix.UNIT)


@pytest.mark.parametrize("chunk", [64, 100_000])
def test_limited_mix_is_the_same_for_any_chunk(spark, chunk):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, 1000)
    x[[3, 500, 998]] = [4.0, -7.0, 3.0]
    tracks = spark.createDataFrame([("m", 0, x.tolist(), 1)], "mix string, start long, samples array<double>, channels int")
    got = np.concatenate([r["samples"] for r in mix.mix(tracks, F.col("start"), ceiling=1.0, ahead=20, chunk=chunk).orderBy("k").collect()])
    exact = np.rint(x * mix.UNIT) / mix.UNIT
    gain = mix.limiter(exact[:, None], 1.0, 20)
    assert np.array_equal(got, np.clip(exact * gain, -1, 1)) and np.abs(exact * gain).max() < 1 + 1e-9
    assert gain[200] == 1.0 and np.abs(np.diff(gain)).max() < 0.05


# --- Digests ------------------------------------------------------------------------------------------------


def test_checksums_of_parts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 70_000):
        a, b = rng.bytes(1000), rng.bytes(n)
        raw = lambda x: zlib.crc32(x) ^ int(checksums.moved_by(np.array([checksums.ORDER]), np.array([len(x)]))[0]) ^ checksums.ORDER
        moved = int(checksums.moved_by(np.array([raw(a)]), np.array([n]))[0])
        assert moved ^ raw(b) == raw(a + b)
        assert int(checksums.moved_by(np.array([moved]), np.array([-n]))[0]) == raw(a)


def test_digests_are_those_of_whole_files(spark):
    rng = np.random.default_rng(7)
    files = {f"f{i}": rng.bytes(int(n)) for i, n in enumerate([0, 1, 2, 999, 5000, 123_457])}
    rows = [(p, at // 2, at, x[at : at + 100]) for p, x in files.items() for at in range(0, max(1, len(x)), 100)]
    rows += [("gap", 0, 0, b"ab"), ("gap", 3, 6, b"cd"), ("nothing", 0, 0, None)]
    packets = spark.createDataFrame(rows, "path string, pts long, at long, data binary").repartition(6)
    out = pk.digests(packets, "path", F.col("at"), F.coalesce(F.floor(F.octet_length("data") / 2), F.lit(0)))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r["path"]: r for r in out.collect()}
    for p, x in files.items():
        r = got[p]
        assert (r["size"], r["crc32"], r["gap_bytes"], r["n_packets"]) == (len(x), zlib.crc32(x), 0, max(1, -(-len(x) // 100)))
    assert (got["gap"]["crc32"], got["gap"]["gap_bytes"], got["gap"]["gap_frames"], got["gap"]["end_pts"]) == (zlib.crc32(b"ab\0\0\0\0cd"), 4, 2, 4)
    assert (got["nothing"]["size"], got["nothing"]["crc32"]) == (0, 0)


# --- Jobs ------------------------------------------------------------------------------------------------


def test_audio_options_are_carried_out(spark, tmp_path):
    rng = np.random.default_rng(12)
    x = rng.integers(-20000, 20000, (5000, 2)).astype("<i2")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.wav").write_bytes(wavfiles.wav(x.tobytes(), channels=2, rate=44100))
    (tmp_path / "in" / "gone.wav").write_bytes(wavfiles.wav(x[:10].tobytes(), channels=2, rate=44100))
    made = convert_audio(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["codec=pcm_s24le", "channels=1", "sample_rate=16000", "volume=0.5", "bare"], ["track=all", "trim=0.01-0.08", "filter_chain=reverse"], limit="1000")
    assert [r["path"].rpartition("/out/")[2] for r in made.collect()] == ["sub/a.wav"]
    frames = (x.astype(np.float64) / 32768 * 0.5)[441:3528][::-1].mean(axis=1, keepdims=True).astype(np.float32).astype(np.float64)
    up, down = rs.ratio(44100, 16000)
    want = rs.filtered(frames, 0, 0, -(-len(frames) * up // down), up, down).astype(np.float32)
    raw = (tmp_path / "out" / "sub" / "a.wav").read_bytes()
    assert struct.unpack_from("<HHIIHH", raw, 20) == (1, 1, 16000, 48000, 3, 24) and raw[44 : 44 + 3 * len(want)] == encode_array(want.ravel(), 24)
    convert_audio(spark, str(tmp_path / "in"), str(tmp_path / "same"), container="raw")
    assert (tmp_path / "same" / "sub" / "a.raw").read_bytes() == x.tobytes()
    for audio, transforms in ((["codec=mp3"], []), (["channels=0"], []), (["sample_rate=x"], []), (["volume=-1"], []), ([], ["rotate=90"])):
        with pytest.raises(ValueError):
            convert_audio(spark, str(tmp_path / "in"), str(tmp_path / "never"), audio, transforms)


def test_muxed_rows_have_a_bound(spark, monkeypatch):
    packets = spark.createDataFrame([("a", 2, b"cd"), ("a", 1, b"ab"), ("a", 3, None), ("b", 0, None), ("c", 0, b"")], "path string, k long, data binary")
    assert {r["path"]: bytes(r["data"]) for r in pk.mux(packets, "path").collect()} == {"a": b"abcd", "b": b"", "c": b""}
    monkeypatch.setattr(pk, "MUX_BYTES", 3)
    with pytest.raises(Exception, match="a row can't hold 4 bytes"):
        pk.mux(packets, "path").collect()
