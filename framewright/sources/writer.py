"""Writing files into a folder: tasks stream into attempts, names are given when the job commits.

A task puts the names of its files beside them, and tells the driver where: however many files a job has, the driver holds a part of their names at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from framewright.sources.files import filesystem

#: Files that the driver names at a time, one thread of it in a row, and asks for in one go.
MOVES, RUN, ASKED = 32, 50, 10_000
#: Names that are compared at a time, by 8 bytes of each.
COMPARED = 1 << 24
#: Names that an error shows.
SHOWN = 3
#: The file with the names of a task's files.
NAMES, _NAMES = "names", pa.schema([("name", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, which are numbered, and how many they are. Their names lie there, in order."""

    place: str
    n: int


class FolderWriter(DataSourceArrowWriter):
    """Rows with a path that stand together make a file of that name below the folder. A container says what its bytes are:
    ``head`` of a file's first row, ``body`` of each row and ``tail`` of the file."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        if not options.get("path"):
            raise ValueError("option path is missing")
        self.folder, self.overwrite = options["path"].rstrip("/"), overwrite
        self.attempts = f"{self.folder}/_attempts-{uuid.uuid4().hex}"

    #: Columns that the container reads; missing ones are null.
    columns: tuple[str, ...] = ("data",)

    def head(self, row: dict[str, Any]) -> bytes:
        return b""

    def body(self, row: dict[str, Any]) -> list[Any]:
        return [row["data"].as_buffer()]

    def tail(self) -> bytes:
        return b""

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, top = filesystem(self.attempts)
        own, names, name, out = f"{top}/{uuid.uuid4().hex}", {}, None, None

        def close() -> None:
            if out is not None:
                out.write(self.tail())
                out.close()

        for batch in batches:
            if batch.num_rows and not names:
                system.create_dir(own, recursive=True)
            get = lambda c, b=batch: b.column(c) if c in b.schema.names else pa.nulls(b.num_rows)
            for path, *values in zip(get("path"), *(get(c) for c in self.columns), strict=True):
                row = dict(zip(self.columns, values, strict=True)) | {"path": path.as_py()}
                if row["path"] != name or out is None:
                    close()
                    name = row["path"]
                    if name in names:
                        raise ValueError(f"{name}: its packets don't stand together; bring packets into order with by_file")
                    out = system.open_output_stream(f"{own}/{len(names)}")
                    names[name] = None
                    out.write(self.head(row))
                for part in self.body(row):
                    out.write(part)
        close()
        if names:
            with system.open_output_stream(f"{own}/{NAMES}") as f, pa.ipc.new_stream(f, _NAMES) as listing:
                listing.write_table(pa.table([pa.array(names, pa.string())], _NAMES), max_chunksize=ASKED)
        return Written(own, len(names))

    def _named(self, messages: list[WriterCommitMessage | None]) -> Iterator[list[tuple[str, str]]]:
        """(attempt, name) of all files, up to ASKED at a time; names as they are below the folder."""
        system, _ = filesystem(self.folder)
        for m in messages:
            if m is not None and m.n:
                with system.open_input_stream(f"{m.place}/{NAMES}") as f, pa.ipc.open_stream(f) as listing:
                    i = 0
                    for batch in listing:
                        yield [(f"{m.place}/{i + k}", os.path.normpath(n).lstrip("/")) for k, n in enumerate(batch.column(0).to_pylist())]
                        i += batch.num_rows

    def _twice(self, messages: list[WriterCommitMessage | None]) -> list[str]:
        """Some of the names that several files have: names of equal hashes are looked at."""
        total = sum(m.n for m in messages if m is not None)
        shares, found = -(-total // COMPARED), []
        for share in range(shares):
            hashes = np.fromiter((h for part in self._named(messages) for _, n in part if (h := hash(n)) % shares == share), np.int64)
            hashes.sort()
            equal = set(np.unique(hashes[1:][hashes[1:] == hashes[:-1]])[:ASKED].tolist())
            seen: set[str] = set()
            for n in (n for part in self._named(messages) for _, n in part if hash(n) in equal) if equal else ():
                if n in seen:
                    found.append(n)
                    if len(found) == SHOWN:
                        return found
                seen.add(n)
        return found

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Existing files are asked for in batches, and names are given by a pool: the driver doesn't wait for one file after another."""
        system, top = filesystem(self.folder)
        twice, there, leaves = self._twice(messages), [], False
        for part in self._named(messages):
            leaves = leaves or any(n.startswith("..") for _, n in part)
            if not self.overwrite and len(there) < SHOWN:
                there += [n for (_, n), x in zip(part, system.get_file_info([f"{top}/{n}" for _, n in part]), strict=True) if x.type != fs.FileType.NotFound]
        if twice or there or leaves:
            self.abort(messages)
            raise ValueError(f"files of one name: {twice}" if twice else f"files that exist: {there[:SHOWN]}" if there else "a path leaves the folder")

        def give(files: list[tuple[str, str]]) -> None:
            for attempt, n in files:
                system.move(attempt, f"{top}/{n}")

        with ThreadPoolExecutor(MOVES) as pool:
            made: set[str] = set()
            for part in self._named(messages):
                folders = {os.path.dirname(f"{top}/{n}") for _, n in part} - made
                list(pool.map(lambda folder: system.create_dir(folder, recursive=True), sorted(folders)))
                made = folders if len(made) > ASKED else made | folders
                list(pool.map(give, (part[i : i + RUN] for i in range(0, len(part), RUN))))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, top = filesystem(self.attempts)
        if system.get_file_info(top).type != fs.FileType.NotFound:
            system.delete_dir(top)
