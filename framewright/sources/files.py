"""Opening files of any file system that pyarrow or the local machine reaches."""

from __future__ import annotations

import fnmatch
import itertools
import os
import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Files that are held, and put in order, at a time.
SORTED = 1 << 16
#: Files of a task at most, however small, and tasks from which on they get fuller.
TASK_FILES, TASKS = 256, 1024
_LOCAL = fs.LocalFileSystem()


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme is one of the machine that reads it: on a cluster it has to be a shared mount."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return _LOCAL, parts.path if path.startswith("file:") else os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def _below(system: fs.FileSystem, top: str, deep: bool, fits: Callable[[str], bool], under: str = "") -> Iterator[tuple[str, int]]:
    """(name below the folder, size) of files; the local machine's are met one by one, others as pyarrow lists them."""
    if not isinstance(system, fs.LocalFileSystem):
        for x in system.get_file_info(fs.FileSelector(top, recursive=deep)):
            if x.type == fs.FileType.File and fits(name := os.path.relpath(x.path, top)):
                yield name, x.size
        return
    with os.scandir(f"{top}/{under}") as entries:
        for x in entries:
            if x.is_dir():
                if deep:
                    yield from _below(system, top, deep, fits, f"{under}{x.name}/")
            elif fits(under + x.name) and x.is_file():
                try:
                    yield under + x.name, x.stat().st_size
                except FileNotFoundError:  # gone since
                    continue


@dataclass
class _Place:
    """A file, or what of a folder is asked for. ``head`` stands before the file system's own paths."""

    system: fs.FileSystem
    head: str
    top: str
    size: int | None
    pattern: str | None
    suffixes: tuple[str, ...]

    def fits(self, name: str) -> bool:
        own = os.path.basename(name)
        return not own.startswith(("_", ".")) and (fnmatch.fnmatch(own, self.pattern) if self.pattern else own.lower().endswith(self.suffixes))

    def has(self, path: str) -> bool:
        top = self.head + self.top
        if self.size is not None:
            return path == top
        name = path[len(top) + 1 :]
        return path.startswith(top + "/") and not (self.pattern and "/" in name) and self.fits(name)

    def files(self) -> Iterator[tuple[str, str, int]]:
        if self.size is not None:
            yield self.head + self.top, os.path.basename(self.top), self.size
            return
        for name, size in _below(self.system, self.top, not self.pattern, self.fits):
            yield f"{self.head}{self.top}/{name}", name, size


def _place(path: str, suffixes: tuple[str, ...]) -> _Place:
    system, at = filesystem(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    pattern = os.path.basename(at)
    wild = any(ch in pattern for ch in "*?[")
    top = os.path.dirname(at) if wild else at.rstrip("/")
    info = system.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return _Place(system, head, at, info.size, None, suffixes)
    return _Place(system, head, top, None, pattern if wild else None, suffixes)


def listed(paths: list[str], suffixes: tuple[str, ...]) -> Iterator[tuple[str, str, int]]:
    """(path, name, size) of files, of folders' files with one of the suffixes, and of what a pattern matches; a file that several of the paths lead to once.

    The name is the path below the folder that was asked for, with "/" between its parts. Files come as they are met, so that however many
    there are, few are held at a time; up to SORTED of them are in order.
    """
    places = [_place(path, suffixes) for path in paths]
    found = (x for i, place in enumerate(places) for x in place.files() if not any(other.has(x[0]) for other in places[i + 1 :]))
    while part := sorted(itertools.islice(found, SORTED)):
        yield from part


@dataclass
class Ranges(InputPartition):
    """Ranges of files that one task reads, packed: a driver that plans millions of files holds some ten bytes of each."""

    packed: bytes

    @classmethod
    def of(cls, parts: list[tuple[str, str, int, int, int]]) -> Ranges:
        columns = list(zip(*((path[: len(path) - len(name)], name, size, start, end - start) for path, name, size, start, end in parts), strict=True))
        return cls(zlib.compress(pickle.dumps(columns), 1))

    @property
    def files(self) -> Iterator[tuple[str, str, int, int, int]]:
        """(path, name, size, start, end)"""
        for top, name, size, start, n in zip(*pickle.loads(zlib.decompress(self.packed)), strict=True):
            yield top + name, name, size, start, start + n


def ranges(files: Iterable[tuple[str, str, int]], most: int, whole: bool = False) -> list[InputPartition]:
    """Tasks for files: long ones are cut every ``most`` bytes, small ones share a task. ``whole``: each file counts as one part of no bytes.

    A task has TASK_FILES parts and ``most`` bytes at most, or a share of 1 / TASKS of what lies before it where that is more, so that the
    number of tasks follows the logarithm of what is large.
    """
    out, held, total, count, before = [], [], 0, 0, 0
    for path, name, size in files:
        step = size + 1 if whole else most
        for start in range(0, max(1, size), step):
            n = 0 if whole else min(step, size - start)
            if held and (total + n > max(most, before // TASKS) or len(held) >= max(TASK_FILES, count // TASKS)):
                out.append(Ranges.of(held))
                held, total = [], 0
            held.append((path, name, size, start, start + step))
            total, count, before = total + n, count + 1, before + n
    return [*out, Ranges.of(held)]


class FilesSource(DataSource):
    """Data source ``files``: path (as ``binaryFile`` gives it), name and size of a folder's files, from its listing alone. Nothing of it stays on the driver but packed names."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, name string, size long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FilesReader(dict(self.options))


class _FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        shown = (x for x in listed([self.options["path"]], ("",)) if not x[1].startswith(("_", ".")) and "/_" not in x[1] and "/." not in x[1])
        return ranges(shown, 1, whole=True)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows = partition.files
        while part := list(itertools.islice(rows, SORTED)):
            paths, names, sizes, _, _ = zip(*part, strict=True)
            paths = [re.sub("^file:(//[^/]*)?", "", x) for x in paths]
            yield pa.RecordBatch.from_arrays([pa.array([f"file:{x}" if x.startswith("/") else x for x in paths]), pa.array(names), pa.array(sizes, pa.int64())], names=["path", "name", "size"])


def sizes(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of the files below a folder."""
    spark.dataSource.register(FilesSource)
    return spark.read.format("files").options(path=folder).load().select("path", "size")


def read_range(path: str, start: int, size: int) -> bytes:
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(size)


#: Folders given out by this process and not yet cleared.
_made: list[str] = []


def new_folder(spark, name: str) -> str:
    """A fresh folder in the one that driver and executors share (spark.checkpoint.dir); a temporary one where none is set and all runs on this machine."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-framewright-")
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def clear(spark) -> None:
    """Deletes the folders that ``new_folder`` gave out in this process. Frames that still read them fail then."""
    while _made:
        place = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
