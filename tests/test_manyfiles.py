"""Jobs of many files: what the driver holds of each is small."""

import pickle
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright import catalog
from framewright.sources import files, wav, writer, y4m


def rows_of(names, data=b"abcd"):
    n = len(names)
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array([data] * n), pa.array([len(data)] * n, pa.int64())], names=["path", "data", "file_size"])


def raw_writer(folder, overwrite=False):
    return wav._Writer({"path": str(folder)}, True, overwrite)


def test_a_task_tells_the_driver_its_place_not_its_names(tmp_path, monkeypatch):
    monkeypatch.setattr(writer, "ASKED", 100)
    w = raw_writer(tmp_path / "out")
    names = [f"d{i % 7}/f-{i}\n.raw" for i in range(1000)]
    told = [w.write(iter([rows_of(names[i : i + 250]) for i in range(0, 500, 250)])), w.write(iter([rows_of(names[500:])])), w.write(iter([]))]
    assert all(len(pickle.dumps(m)) < 500 for m in told)
    w.commit([*told, None])
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(names)
    assert {p.read_bytes() for p in (tmp_path / "out").rglob("*.raw")} == {b"abcd"} and not list((tmp_path / "out").glob("_*"))


@pytest.mark.parametrize("compared", [1 << 24, 7])
def test_one_name_of_two_tasks_is_an_error_and_nothing_is_written(tmp_path, monkeypatch, compared):
    monkeypatch.setattr(writer, "COMPARED", compared)
    w = raw_writer(tmp_path / "out", overwrite=True)
    told = [w.write(iter([rows_of([f"{i}.raw" for i in range(50)])])), w.write(iter([rows_of(["x.raw", "a//../7.raw", "y.raw"])]))]
    with pytest.raises(ValueError, match=r"files of one name: \['7.raw'\]"):
        w.commit(told)
    assert not list((tmp_path / "out").iterdir())
    for name, error in (("../x.raw", "leaves the folder"), ("there.raw", "files that exist: \\['there.raw'\\]")):
        (tmp_path / "out/there.raw").write_bytes(b"old")
        w = raw_writer(tmp_path / "out")
        with pytest.raises(ValueError, match=error):
            w.commit([w.write(iter([rows_of(["new.raw", name])]))])
        assert [p.name for p in (tmp_path / "out").iterdir()] == ["there.raw"]


def test_planned_files_take_a_few_bytes_each(tmp_path):
    for i in range(2000):
        (tmp_path / f"doc-{i}.wav").write_bytes(b"x" * (i % 100))
    for include in ("packets", "header"):
        parts = wav._Reader({"path": str(tmp_path), "include": include}, False).partitions()
        assert sum(len(pickle.dumps(p)) for p in parts) < 2000 * 15
        assert [(n, s, a) for p in parts for _, n, s, a, _ in p.files] == sorted((f"doc-{i}.wav", i % 100, 0) for i in range(2000))
        assert {path for p in parts for path, *_ in p.files} == {f"{tmp_path}/doc-{i}.wav" for i in range(2000)}


def test_the_number_of_tasks_stays_small():
    some = lambda n, size: ((f"/in/{i}.wav", f"{i}.wav", size) for i in range(n))
    parts = files.ranges(some(600_000, 3000), 1 << 16)
    assert len(parts) < 5000 and sum(1 for p in parts for _ in p.files) == 600_000
    assert len(files.ranges(some(600_000, 3000), 1 << 16, whole=True)) < 2000
    # Smaller jobs are cut as before, and a long file into ranges of its bytes.
    assert len(files.ranges(some(210, 3000), 1 << 16)) == 10
    assert [x[3:] for p in files.ranges([("/in/a", "a", 250)], 100) for x in p.files] == [(0, 100), (100, 200), (200, 300)]


def test_files_that_several_paths_lead_to_come_once(tmp_path):
    for name in ("a/x.wav", "a/b/y.WAV", "a/b/_no.wav", "a/b/.no.wav", "a/z.raw", "c.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "a/gone.wav").symlink_to(tmp_path / "nowhere")
    (tmp_path / "a/link.wav").symlink_to(tmp_path / "c.wav")
    at = lambda *p: [(str(Path(x).relative_to(tmp_path)), n, s) for x, n, s in files.listed([str(tmp_path / q) for q in p], (".wav",))]
    below = [("a/b/y.WAV", "b/y.WAV", 9), ("a/link.wav", "link.wav", 5), ("a/x.wav", "x.wav", 7)]
    assert at("a") == below and at("a", "a") == below and at("a/*.wav") == below[1:]
    assert at("a", "a/b") == [("a/b/y.WAV", "y.WAV", 9), *below[1:]] and at("a/b", "a") == below
    assert at("a/x.wav", "a") == below and at("a", "a/z.raw", "a/*.w*") == [below[0], *below[1:], ("a/z.raw", "z.raw", 7)]
    with pytest.raises(FileNotFoundError, match="missing"):
        at("a", "missing")


def test_sizes_of_a_folder_as_binary_files_have_them(spark, tmp_path):
    for name in ("a b/x#1.raw", "a b/c/y.raw", "_hidden/z.raw", ".z.raw", "e.raw"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        got = files.sizes(spark, folder)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.inputFiles() == []


@pytest.mark.parametrize("name", ["wav_to_wav", "wav_to_raw"])
def test_sizes_of_converted_files_follow_from_heads(spark, sf, monkeypatch, name):
    made, write = [], wav.write_files
    monkeypatch.setattr(wav, "write_files", lambda packets, *rest: made.append(packets) or write(packets, *rest))
    getattr(catalog, name)(spark, sf)
    per = made[1].groupBy("path").agg(F.sum(F.octet_length("data")).alias("n"), F.min("file_size").alias("a"), F.max("file_size").alias("b"))
    assert per.count() > 20 and per.filter("n <> a or n <> b").count() == 0


def test_heads_leave_a_task_in_batches(tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"{i}.wav").write_bytes(b"RI")
    monkeypatch.setattr(wav, "BATCH_ROWS", 10)
    reader = wav._Reader({"path": str(tmp_path), "include": "header"}, False)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [10, 10, 5]


def test_films_are_planned_in_a_few_bytes_each(tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.y4m").write_bytes(b"YUV4MPEG2 W4 H4 Cmono\n" + (b"FRAME\n" + bytes(16)) * (i % 3))
    reader = y4m._Reader({"path": str(tmp_path), "range": 60})
    parts = reader.partitions()
    assert sum(len(pickle.dumps(p)) for p in parts) < 600 * 200 and sum(b.num_rows for p in parts for b in reader.read(p)) == 600
    reader = y4m._Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(pickle.dumps(p)) for p in parts) < 600 * 15 and sum(b.num_rows for p in parts for b in reader.read(p)) == 600


def test_raw_files_are_planned_in_a_few_bytes_each(tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.pcm").write_bytes(bytes(i))
    reader = wav._Reader({"path": str(tmp_path), "limit": "100", "depth": "24", "channels": "2"}, True)
    parts = reader.partitions()
    assert sum(len(pickle.dumps(p)) for p in parts) < 600 * 15
    rows = [(r["name"], r["k"], r["size"], r["pts"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(rows) == sorted((f"{i}.pcm", k, min(96, i - k * 96), k * 16) for i in range(600) for k in range(-(-i // 96)))
