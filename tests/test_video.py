"""Pictures and Y4M files against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import video
from framewright.plans.video import convert_video, frame_rate
from framewright.sources import y4m

SIZES = [("YUV420", 4, 2), ("YUV420", 5, 3), ("YUV422", 5, 3), ("YUV444", 3, 2), ("GRAY8", 7, 1), ("YUV420", 1, 1)]


def pictures(rng):
    return [(f, w, h, rng.bytes(video.picture_size(f, w, h))) for f, w, h in SIZES]


def plain_rgb(format, w, h, data):
    by = video.CHROMA[format]
    wide, high = (-(-w // by[0]), -(-h // by[1])) if by else (0, 0)
    out = b""
    for y in range(h):
        for x in range(w):
            at = w * h + (y // by[1]) * wide + x // by[0] if by else 0
            c, d, e = data[y * w + x] - 16, (data[at] if by else 128) - 128, (data[at + wide * high] if by else 128) - 128
            out += bytes(max(0, min(255, v >> 8)) for v in (298 * c + 409 * e + 128, 298 * c - 100 * d - 208 * e + 128, 298 * c + 516 * d + 128))
    return out


def test_colours_and_planes(spark):
    rows = pictures(np.random.default_rng(1)) + [("YUV420", 4, 2, b"short"), ("RGB24", 1, 1, b"abc"), ("YUV444", 0, 2, b""), ("GRAY8", None, 1, b"a"), ("GRAY8", 1, 1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, format string, w int, h int, data binary")
    got = df.select("id", video.yuv_to_rgb("data", "format", "w", "h").alias("rgb"), video.planes(F.col("data"), F.col("format"), F.col("w"), F.col("h")).alias("p")).orderBy("id").collect()
    for r, (f, w, h, data) in zip(got, rows[: len(SIZES)], strict=False):
        assert bytes(r["rgb"]) == plain_rgb(f, w, h, data)
        assert bytes(r["p"]["y"]) == data[: w * h] and bytes(r["p"]["y"] + r["p"]["u"] + r["p"]["v"]) == data
    assert all(r["rgb"] is None for r in got[len(SIZES) :]) and got[len(SIZES)]["p"] is None


@pytest.mark.parametrize("size, to", [((7, 5), (3, 2)), ((4, 4), (4, 4)), ((2, 3), (5, 7)), ((1, 1), (3, 3)), ((16, 12), (8, 8))])
def test_areas(size, to):
    plane = np.random.default_rng(0).integers(0, 256, (size[1], size[0]), dtype=np.uint8)
    got = video.area_scaled(plane, *to)
    # Each value repeated until areas are whole.
    big = np.repeat(np.repeat(plane.astype(np.int64), to[1], axis=0), to[0], axis=1)
    sums = big.reshape(to[1], size[1], to[0], size[0]).sum(axis=(1, 3))
    assert np.array_equal(got, (2 * sums + size[0] * size[1]) // (2 * size[0] * size[1]))


def test_sizes_and_brightness(spark):
    rows = pictures(np.random.default_rng(2))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, format string, w int, h int, data binary")
    got = df.select("id", video.scaled("data", "format", "w", "h", F.lit(3), F.lit(5)).alias("s"), video.adjusted("data", "format", "w", "h", F.lit(1.5), F.lit(0.5)).alias("b")).orderBy("id").collect()
    for r, (f, w, h, data) in zip(got, rows, strict=True):
        assert len(r["s"]) == video.picture_size(f, 3, 5)
        assert bytes(r["b"]) == bytes(max(0, min(255, int((y - 128) * 0.5 + 192))) for y in data[: w * h]) + data[w * h :]


@pytest.mark.parametrize("rate, target", [((25, 1), (30, 1)), ((30000, 1001), (24, 1)), ((24, 1), (48, 1)), ((50, 1), (25, 1)), ((1, 3), (7, 2))])
def test_frame_rates_against_a_search(spark, rate, target):
    df = spark.createDataFrame([(k, *rate) for k in range(40)] + [(0, 0, 1)], "k long, num long, den long")
    got = sorted((r["k"], r["source_k"]) for r in video.convert_fps(df, (F.col("num"), F.col("den")), target).collect())
    want, m = [], 0
    while m * target[1] * rate[0] // (target[0] * rate[1]) < 40:
        want.append((m, m * target[1] * rate[0] // (target[0] * rate[1])))
        m += 1
    assert got == want


def film(head, frames, marks=None):
    return head + b"".join(b"FRAME" + (marks[i] if marks else b"") + b"\n" + f for i, f in enumerate(frames))


def test_files_in_ranges(spark, tmp_path):
    y4m.register(spark)
    rng = np.random.default_rng(3)
    pics = [rng.bytes(24) for _ in range(50)]
    (tmp_path / "even.y4m").write_bytes(film(b"YUV4MPEG2 W4 H4 F30000:1001 Ip A1:1 C420jpeg XYSCSS=420\n", pics))
    # Parameters of frames: their distances differ.
    (tmp_path / "odd.y4m").write_bytes(film(b"YUV4MPEG2 H4 W4\n", pics, [b" I" + b"x" * (i % 5) if i % 3 else b"" for i in range(50)]))
    (tmp_path / "none.y4m").write_bytes(b"YUV4MPEG2 W4 H4 Cmono\n")
    for size in (7, 100, 1 << 20):
        rows = spark.read.format("y4m").options(path=str(tmp_path), range=size).load().collect()
        for name in ("even.y4m", "odd.y4m"):
            own = sorted((r["k"], bytes(r["data"])) for r in rows if r["name"] == name)
            assert own == list(enumerate(pics))
        assert len(rows) == 100
    heads = {r["name"]: r for r in spark.read.format("y4m").options(path=str(tmp_path), include="header").load().collect()}
    assert [(heads[n]["frames"], heads[n]["rate_num"], heads[n]["format"], heads[n]["error"]) for n in ("even.y4m", "odd.y4m", "none.y4m")] == [(50, 30000, "YUV420", None), (50, 25, "YUV420", None), (0, 25, "GRAY8", None)]


@pytest.mark.parametrize("raw, error", [(b"RIFF....", "expected YUV4MPEG2, found RIFF...."), (b"YUV4MPEG2 W4 H4", "unexpected EOF"), (b"YUV4MPEG2 W4\n", "bad head"), (b"YUV4MPEG2 W0 H4\n", "width, height and rate must be positive"),
    (b"YUV4MPEG2 W4 H4 C420p10\n", "colour space 420p10 is not supported"), (b"YUV4MPEG2 W4 H4\nFRAME\nabc", "unexpected EOF"), (b"YUV4MPEG2 W4 H4\nFRAMX\n" + b"a" * 24, "expected FRAME")])
def test_bad_files(spark, tmp_path, raw, error):
    y4m.register(spark)
    (tmp_path / "x.y4m").write_bytes(raw)
    read = lambda **o: spark.read.format("y4m").options(path=str(tmp_path), **o).load()
    with pytest.raises(Exception, match=error.replace(".", "[.]")):
        read().collect()
    assert read(on_error="skip").collect() == []
    assert read(include="header").first()["error"] == error or "FRAM" in raw.decode()


def test_written_films_come_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"d{i % 2}/f{i}.y4m", k, rng.bytes(video.picture_size(f, w, h)), w, h, 24, 1, f) for i, (f, w, h) in enumerate(SIZES) for k in range(4)]
    schema = "path string, k long, data binary, width long, height long, rate_num long, rate_den long, format string"
    y4m.write_files(spark.createDataFrame(rows, schema).repartition(5), str(tmp_path / "out"))
    got = spark.read.format("y4m").options(path=str(tmp_path / "out")).load()
    assert sorted((r["name"], r["k"], bytes(r["data"]), r["format"]) for r in got.collect()) == sorted((p, k, d, f) for p, k, d, *_, f in rows)
    for bad, error in ((("x.y4m", 0, b"ab", 4, 4, 24, 1, "YUV420"), "a picture of 2 bytes, not 24"), (("x.y4m", 0, b"ab", 4, 4, 24, 1, "RGB24"), "can't be in a Y4M file"), (rows[0], "files that exist")):
        with pytest.raises(Exception, match=error):
            y4m.write_files(spark.createDataFrame([bad], schema), str(tmp_path / "out"))


def test_video_options_are_carried_out(spark, tmp_path):
    rng = np.random.default_rng(6)
    pics = [rng.bytes(24) for _ in range(10)]
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "x.y4m").write_bytes(film(b"YUV4MPEG2 W4 H4 F25:1\n", pics))
    made = convert_video(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["fps=50", "width=2", "scale=3", "brightness=0.1", "track=0"])
    assert [(r["name"], r["width"], r["height"], r["rate_num"], r["rate_den"], r["frames"]) for r in made.collect()] == [("a/x.y4m", 6, 12, 50, 1, 20)]
    got = {r["k"]: bytes(r["data"]) for r in spark.read.format("y4m").options(path=str(tmp_path / "out")).load().collect()}
    for k in range(20):
        raw = np.frombuffer(pics[k // 2], np.uint8)
        y = video.area_scaled(raw[:16].reshape(4, 4), 6, 12).astype(int)
        chroma = b"".join(video.area_scaled(raw[at : at + 4].reshape(2, 2), 3, 6).tobytes() for at in (16, 20))
        assert got[k] == np.clip(np.trunc((y - 128) + 12.8), 0, 255).astype(np.uint8).tobytes() + chroma
    assert [frame_rate(x) for x in ("25", "29.97", "30000/1001")] == [(25, 1), (2997, 100), (30000, 1001)]
    for bad in ("fps=0", "fps=x", "width=0", "height=1.5", "scale=-1", "rotate=90", "contrast=nan", "codec=h264"):
        with pytest.raises(ValueError):
            convert_video(spark, str(tmp_path / "in"), str(tmp_path / "never"), [bad])
