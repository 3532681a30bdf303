"""Texts as blocks of word positions, and distinct words dealt out over the cluster.

A block holds some thousand documents: their ids, their numbers of words and, position by position, a code into
the block's own list of distinct words. That list is cut into shards by a hash of the word, so that every copy
of a word, from any block, meets in one shard. There something is worked out once for each distinct word, and
each (block, shard) list gets its values back; the block then puts them in its positions. What crosses the
network is a block's distinct words, not its positions' words, so a word that makes a third of all text weighs
one entry a block.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.names import col

#: A block is closed after a slice of documents that takes it to this many words.
BLOCK_WORDS = 4_000_000
#: Bytes of text that are split at a time.
SLICE_BYTES = 2 << 20
#: Words whose values a shard's task keeps in memory; beyond it they are worked out anew.
MEMO = 300_000
#: Bytes of text whose distinct words make a shard, and whose blocks a task puts together, about.
SHARD_BYTES, TASK_BYTES = 32 << 20, 16 << 20
#: Most shards that a block's words are cut into: a row should hold some ten words. Larger shards are read row by row.
MOST_SHARDS = 8192


def sizes_for(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Numbers of shards and of tasks for blocks. Both grow with the bytes of text; a core has one of each at least."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(col(text))), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return min(max(cores, total // SHARD_BYTES + 1), MOST_SHARDS), max(cores, total // TASK_BYTES + 1)


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays of unsigned integers as one compressed value.

    A first byte holds values up to 254; the excess of the others over 255 stands apart, its bytes of equal weight together.
    """
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.asarray(a)
        a = a if a.dtype == np.uint32 else a.astype(np.int64)
        rest = a[a >= 255] - a.dtype.type(255)
        width = (int(rest.max(initial=0)).bit_length() + 7) // 8
        planes = rest.view(np.uint8).reshape(-1, a.dtype.itemsize)[:, :width].T
        body = [zstandard.compress(x.tobytes(), level) for x in (np.minimum(a, 255).astype(np.uint8), *planes)]
        parts += [struct.pack("<IIB", len(a), len(rest), width), *(struct.pack("<I", len(x)) + x for x in body)]
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1

    def plane(n: int) -> np.ndarray:
        nonlocal at
        size = struct.unpack_from("<I", data, at)[0]
        at += 4 + size
        return np.frombuffer(zstandard.decompress(data[at - size : at], max_output_size=n) if n else b"", np.uint8)

    for _ in range(data[0]):
        n, n_rest, width = struct.unpack_from("<IIB", data, at)
        at += 9
        first = plane(n)
        values = first.astype(np.uint64 if width > 3 else np.uint32)
        rest = np.full(n_rest, 255, values.dtype)
        for i in range(width):
            rest += plane(n_rest).astype(values.dtype) << values.dtype.type(8 * i)
        values[first == 255] = rest
        out.append(values)
    return out


def pack_words(codes: np.ndarray, lengths: np.ndarray, body: bytes, *more: np.ndarray, level: int = 3) -> bytes:
    """Ascending codes, their words (lengths and bytes) and further numbers of each."""
    head = pack(np.diff(codes, prepend=0), lengths, *more)
    return struct.pack("<I", len(head)) + head + zstandard.compress(body, level)


def unpack_words(data: bytes) -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
    n = struct.unpack_from("<I", data)[0]
    steps, lengths, *more = unpack(data[4 : 4 + n])
    ends = np.cumsum(lengths, dtype=np.int64)
    body = zstandard.decompress(data[4 + n :], max_output_size=int(ends[-1]) if len(ends) else 0) if len(ends) and ends[-1] else b""
    starts = ends - lengths
    return np.cumsum(steps, dtype=np.int64), [body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], more


@dataclass
class Block:
    """``codes[bounds[i]:bounds[i + 1]]`` are document i's words."""

    number: int
    doc_ids: pa.Array
    extra: pa.Array
    bounds: np.ndarray
    codes: np.ndarray


def _shards_of(lengths: np.ndarray, body: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each word by a polynomial hash of its bytes."""
    ends = np.cumsum(lengths)
    powers = np.full(int(lengths.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers = np.cumprod(powers, dtype=np.uint64)
    place = np.arange(len(body)) - np.repeat(ends - lengths, lengths)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body + np.uint64(1)) * powers[place], dtype=np.uint64)])
    h = total[ends] - total[ends - lengths] + lengths.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and bytes of an array of binary values without nulls."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.diff(at), bytes(memoryview(data)[at[0] : at[-1]]) if data is not None else b""


def word_blocks(docs: DataFrame, split: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], shards: int, doc_id: str = "doc_id", text: str = "text", extra: str | None = None, counted: bool = False, end: bool = False, level: int = 3) -> DataFrame:
    """Rows of blocks (shard -1: doc_ids, extras, payload of counts and codes) and of their words (shard 0 and up).

    ``split`` gives the words of an array of texts, one after another, and each text's number of them; a null text is
    an empty one. With ``end`` an empty word follows each text's last. ``extra`` is a boolean column kept by
    document. With ``counted``, words carry the number of their places in the block's documents whose ``extra`` is true; where
    ``extra`` is given, that in all of them too.
    ``level`` is the compression of codes and words.
    """
    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), (col(extra) if extra else F.lit(True)).alias("extra"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def close(number: int, ids: list, extras: list, counts: np.ndarray, words: list[pa.Array], id_type: pa.DataType) -> pa.RecordBatch:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24 | number
        coded = pa.chunked_array(words, pa.binary()).dictionary_encode().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        words.clear()
        flat, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if end:
            flat = np.insert(flat, np.cumsum(counts), len(names))
            names, counts = pa.concat_arrays([names, pa.array([b""], pa.binary())]), counts + 1
        # Frequent words get small codes, which pack well.
        all_places = np.bincount(flat, minlength=len(names))
        order = np.argsort(-all_places, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        flat, names = rank[flat], names.take(pa.array(order))
        del coded, rank
        lengths, body = _bytes_of(names)
        of = _shards_of(lengths, np.frombuffer(body, np.uint8), shards)
        places = [np.bincount(flat[np.repeat(np.array(extras, bool), counts)], minlength=len(names))] if counted else []
        places += [all_places[order]] if counted and extra else []
        rows_shard, rows_payload = [-1], [pack(counts, flat, level=level)]
        by_shard = np.argsort(of, kind="stable")
        for part in np.split(by_shard, np.flatnonzero(np.diff(of[by_shard])) + 1):
            if len(part):
                own_lengths, own_body = _bytes_of(names.take(pa.array(part)))
                rows_shard.append(int(of[part[0]]))
                rows_payload.append(pack_words(part, own_lengths, own_body, *(x[part] for x in places), level=level))
        n = len(rows_shard)
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * n, pa.int64()), pa.array(rows_shard, pa.int32()), pa.array([ids] + [None] * (n - 1), pa.list_(id_type)), pa.array([extras] + [None] * (n - 1), pa.list_(pa.bool_())), pa.array(rows_payload, pa.binary())],
            names=["block", "shard", "doc_ids", "extras", "payload"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, extras, counts, words, total, id_type = 0, [], [], [], [], 0, pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in slices(batch, "text", SLICE_BYTES):
                found, n = split(pc.fill_null(part.column("text").cast(pa.string()), ""))
                ids += part.column("doc_id").to_pylist()
                extras += part.column("extra").to_pylist()
                words.append(found.cast(pa.binary()))
                counts.append(n)
                total += len(found)
                if total >= BLOCK_WORDS:
                    yield close(number, ids, extras, np.concatenate(counts), words, id_type)
                    pa.default_memory_pool().release_unused()
                    number, ids, extras, counts, words, total = number + 1, [], [], [], [], 0
        if ids:
            yield close(number, ids, extras, np.concatenate(counts), words, id_type)
        pa.default_memory_pool().release_unused()

    return slim.mapInArrow(cut, f"block long, shard int, doc_ids array<{kind}>, extras array<boolean>, payload binary")


def blank_split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks."""
    lists = pc.ascii_split_whitespace(texts)
    words, counts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        words = words.filter(pa.array(full))
    return words, counts


def answered(blocks: DataFrame, shards: int, answer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Deals the word rows out, a task for each shard, and lets ``answer`` give rows of the same columns back."""
    asked = blocks.filter("shard >= 0").select("block", "shard", "payload").repartitionById(shards, "shard").sortWithinPartitions("shard")
    return asked.mapInArrow(answer, "block long, shard int, payload binary")


def turns(blocks: DataFrame) -> Column:
    """A number of each block for dealing them out one by one: first blocks of all the tasks that made them, then second ones."""
    makers = blocks.filter("shard < 0").agg(F.coalesce(F.max(F.shiftright("block", 24)), F.lit(0)) + 1).first()[0]
    return F.col("block").bitwiseAND((1 << 24) - 1) * makers + F.shiftright("block", 24)


def in_tasks(rows: DataFrame, tasks: int, turn: Column) -> DataFrame:
    """Rows with a column ``task``, dealt out by ``turn``. A hash would put several turns into one task and none into others."""
    return rows.withColumn("task", F.pmod(turn, F.lit(tasks)).cast("int")).repartitionById(tasks, "task")


def met(blocks: DataFrame, answers: DataFrame, finish: Callable[[Block, list[bytes]], pa.Table], schema: str, tasks: int) -> DataFrame:
    """Brings each block its answers in one of ``tasks`` tasks: ``finish(block, payloads)`` gives its rows."""
    own = blocks.filter("shard < 0")
    answers = answers.select("block", "shard", F.lit(None).cast(blocks.schema["doc_ids"].dataType).alias("doc_ids"), F.lit(None).cast("array<boolean>").alias("extras"), "payload")

    def group(table: pa.Table) -> pa.Table:
        at = int(np.flatnonzero(table.column("shard").to_numpy() < 0)[0])
        counts, codes = unpack(table.column("payload")[at].as_py())
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        block = Block(table.column("block")[at].as_py(), table.column("doc_ids")[at].values, table.column("extras")[at].values, bounds, codes)
        return finish(block, [p.as_py() for i, p in enumerate(table.column("payload")) if i != at])

    return in_tasks(own.unionByName(answers), tasks, turns(blocks)).groupBy("task", "block").applyInArrow(group, schema)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[starts[c]:starts[c] + lengths[c]]`` for each code in turn, and where each code's part ends."""
    own = lengths[codes]
    ends = np.cumsum(own, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - own), own)
    return values[at], ends
