"""Comparing the members of groups in bounded blocks.

A group of n members is cut into ceil(n / CHUNK) chunks by a hash of the member; each pair of chunks is a block.
A block's rows meet in one task, are compared there as arrays, and leave as a row per member, never as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a chunk, about.
CHUNK = 512


def in_blocks(members: DataFrame, group: str, size: str, member: Column, chunk: int = CHUNK) -> DataFrame:
    """Adds block_key (a block's number) and side (the member's chunk is the block's first, 0, or second, 1).

    ``size`` is the column of the group's number of members. A block of one chunk with itself has side 0 only.
    """
    chunks = F.ceil(F.col(size) / chunk).cast("long")
    return paired(members, group, chunk_of(member, chunks), F.sequence(F.lit(0).cast("long"), chunks - 1))


def chunk_of(member: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), member), chunks)


def paired(members: DataFrame, group: str, own: Column, others: Column) -> DataFrame:
    """As in_blocks: ``own`` is the number of a member's chunk, ``others`` those of the chunks that it is compared with, its own too."""
    rows = members.withColumns({"__own": own, "__other": F.explode(others)})
    first, second = F.least("__own", "__other"), F.greatest("__own", "__other")
    side = (F.col("__own") > F.col("__other")).cast("int")
    return rows.withColumns({"block_key": F.xxhash64(F.lit(12), group, first, second), "side": side}).drop("__own", "__other")


def neighbours(entries: DataFrame, key: str, member: str, length: int | None = None) -> DataFrame:
    """Rows (key, member) whose key, or its first ``length`` bytes, stands in another row too, and a few that are alone.

    The rows are sorted once, by ranges of (key, member), so that equal keys stand together and a key of very many rows
    is cut over several tasks. What stands at a task's ends may go on in the next one, so it stays, alone or not. Binary
    keys have one length.
    """

    def heads(column: pa.ChunkedArray) -> np.ndarray:
        array = column.combine_chunks()
        array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
        if not pa.types.is_binary(array.type):
            return array.to_numpy(zero_copy_only=False).reshape(-1, 1)
        width = len(array[0].as_buffer())
        fixed = array.cast(pa.binary(width))
        raw = np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * width : (fixed.offset + len(fixed)) * width]
        return raw.reshape(-1, width)[:, :length]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stays = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch])
            keys = heads(table.column(key))
            same = (keys[1:] == keys[:-1]).all(axis=1)
            hit = np.concatenate([[stays], same])
            hit[:-1] |= same
            found = table.slice(0, len(hit) - 1).filter(pa.array(hit[:-1]))
            if found.num_rows:
                yield from found.combine_chunks().to_batches()
            last, stays = batch.slice(batch.num_rows - 1), bool(hit[-1])
        if last is not None:
            yield last

    rows = entries.select(key, member)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartitionByRange(key, member).sortWithinPartitions(key, member).mapInArrow(look, schema)


def near_edges(members: DataFrame, codes: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type, width: int) -> DataFrame:
    """a, b: each member of a group with the least member that it reaches over near codes in one of the group's blocks.

    ``members`` (node, rep): rows of groups; ``codes`` (id, code): a member's code, ``width`` numbers of ``kind`` as bytes.
    ``near(x, y)`` says of two arrays of codes, broadcast against each other, which are near.
    """
    sizes = members.groupBy(F.col("node").alias("of")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = members.join(sizes, F.col("node") == F.col("of")).join(codes, F.col("rep") == F.col("id")).select("node", F.col("rep").alias("member"), "code", "size")
    blocks = in_blocks(rows, "node", "size", F.col("member")).select("block_key", "side", "member", "code")

    def match(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        ids, side = table.column("member").to_numpy(), table.column("side").to_numpy()
        codes = np.frombuffer(b"".join(x.as_py() for x in table.column("code")), kind).reshape(len(ids), width)
        roots, n = ids.copy(), np.diff(bounds)
        two = bounds[:-1][n == 2]
        if len(two):
            ok = near(codes[two], codes[two + 1]) & ((side[two] == 0) | (side[two] != side[two + 1]))
            roots[two[ok]] = roots[two[ok] + 1] = np.minimum(ids[two[ok]], ids[two[ok] + 1])
        for a, b in zip(bounds[:-1][n > 2].tolist(), bounds[1:][n > 2].tolist(), strict=True):
            linked = np.empty((b - a, b - a), bool)
            for i in range(a, b, 64):
                linked[i - a : i - a + 64] = near(codes[i : min(i + 64, b), None, :], codes[None, a:b, :])
            np.fill_diagonal(linked, False)
            if side[a:b].any():
                linked &= side[a:b, None] != side[None, a:b]
            if linked.any():
                roots[a:b] = roots_of(ids[a:b], linked)
        some = roots != ids
        return pa.table({"a": ids[some], "b": roots[some]})

    return compare_blocks(blocks, match, "a long, b long")


def compare_blocks(blocks: DataFrame, compare: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, partitions: int | None = None) -> DataFrame:
    """Runs ``compare(rows, bounds)`` on batches of whole blocks: rows ``bounds[i]:bounds[i + 1]`` are one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                keys = table.column("block_key").to_numpy()
                bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
                out = compare(table, bounds)
                if out is not None and out.num_rows:
                    yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("block_key").to_numpy()
            last = int(np.searchsorted(keys, keys[-1], side="left"))
            if last == 0 and held and held[-1].column("block_key")[0].as_py() == keys[0]:
                held.append(batch)
                continue
            yield from done(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield from done(pa.Table.from_batches(held))

    dealt = blocks.repartition(partitions, "block_key") if partitions else blocks.repartition("block_key")
    return dealt.sortWithinPartitions("block_key").mapInArrow(run, schema)


def roots_of(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The least id that each member reaches over a symmetric matrix of links."""
    roots = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        least = np.minimum(np.where(linked, roots[None, :], big).min(axis=1, initial=big), roots)
        if (least == roots).all():
            return roots
        roots = least
