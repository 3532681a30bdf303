"""Byte-level BPE by a global distinct-word shuffle.

Texts are cut into pre-tokens by the vocabulary's pattern. Their positions stay in blocks; each block's distinct
pre-tokens go to the shard of their hash, where a distinct one is encoded once. The ids are joined back by
(block, word) and put in the words' positions. Decoding joins the ids with the table of token bytes, whose size
is the vocabulary's.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from framewright.llm import wordblocks as wb
from framewright.llm.store import stored

#: Words of a block that are put together at a time.
CHUNK = 250_000
#: Compression of the blocks: they are written, read and shuffled as a whole.
LEVEL = 9


def read_ranks(path: str) -> bytes:
    """A rank file as it stands, to be handed to tasks; its size is the vocabulary's."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(4)
def encoder(data: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})


@lru_cache(4)
def token_bytes(data: bytes) -> pa.Array:
    """The table of token bytes by id; ids that the vocabulary leaves out are null."""
    ranks = ranks_of(data)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return pa.array(table, pa.binary())


def splitter(pattern: str):
    """A function from texts to their pre-tokens, as wordblocks wants it."""
    found: list = []

    def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not found:
            found.append(regex.compile(pattern).findall)
        lists = [found[0](t) for t in texts.to_pylist()]
        words = [pa.array(x, pa.string()) for x in lists]
        return pa.concat_arrays(words) if words else pa.array([], pa.string()), np.fromiter(map(len, lists), np.int64, len(lists))

    return split


def _encode_shard(data, pattern: str):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value, pattern).encode_ordinary
        memo: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for p in batch.column("payload"):
                codes, words, _ = wb.unpack_words(p.as_py())
                ids = []
                for w in words:
                    x = memo.get(w)
                    if x is None:
                        if len(memo) >= wb.MEMO:
                            memo.clear()
                        x = memo[w] = encode(w.decode("utf-8", "surrogatepass"))
                    ids.append(x)
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
                out.append(wb.pack(np.diff(codes, prepend=0), lengths, flat))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "payload"])

    return answer


def _ids_by_code(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [wb.unpack(p) for p in payloads]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parts])
    lengths_by_answer = np.concatenate([p[1] for p in parts]).astype(np.int64)
    starts_by_answer = np.cumsum(lengths_by_answer) - lengths_by_answer
    starts, lengths = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    starts[codes], lengths[codes] = starts_by_answer, lengths_by_answer
    return np.concatenate([p[2] for p in parts]).astype(np.uint32), starts, lengths


def pieces(block: wb.Block, payloads: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents a to b of a block at a time: their ids, one after another, and each document's bounds in them."""
    values, starts, lengths = _ids_by_code(payloads)
    a, n = 0, len(block.bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(block.bounds, block.bounds[a] + CHUNK, side="right")) - 1)
        codes = block.codes[block.bounds[a] : block.bounds[b]]
        ids, ends = wb.ragged(values, starts, lengths, codes)
        own = np.concatenate([[0], ends])[block.bounds[a : b + 1] - block.bounds[a]]
        yield a, b, ids, own
        a = b


def decode_ids(ids: np.ndarray, bounds: np.ndarray, table: pa.Array) -> list[bytes]:
    """Each document's bytes: its ids joined with the table of token bytes. An id without bytes is an error."""
    joined = table.take(pa.array(ids.astype(np.int64)))
    if joined.null_count:
        raise ValueError("an id that is not in the vocabulary")
    if not len(ids):
        return [b""] * (len(bounds) - 1)
    _, offsets, data = joined.buffers()
    ends = np.frombuffer(offsets, np.int32)[joined.offset :]
    raw = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(raw[ends[i] : ends[j]]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _encoded_blocks(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str, text: str):
    shards, tasks = wb.sizes_for(docs, text)
    data = docs.sparkSession.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    blocks = stored(wb.word_blocks(docs, splitter(pattern), shards, doc_id, text, level=LEVEL), "words")
    return blocks, wb.answered(blocks, shards, _encode_shard(data, pattern)), data, tasks


def encoded(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every text.

    A null text is an empty one and has no ids. Repeated rows and null ids are rows like any other; an empty
    table gives an empty result; other columns aren't read.
    """
    blocks, answers, _, tasks = _encoded_blocks(docs, ranks, pattern, doc_id, text)

    def finish(block: wb.Block, payloads: list[bytes]) -> pa.Table:
        parts = []
        for a, b, ids, own in pieces(block, payloads):
            lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(ids.astype(np.int32)))
            parts.append(pa.table({"doc_id": block.doc_ids.slice(a, b - a), "ids": lists}))
        return pa.concat_tables(parts)

    return wb.met(blocks, answers, finish, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>", tasks)


def decoded(ids: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids); null ids give null bytes."""
    data = ids.sparkSession.sparkContext.broadcast(ranks)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(data.value)
        for batch in batches:
            out = []
            for x in batch.column("ids"):
                own = None if not x.is_valid else np.array(x.as_py(), np.int64)
                out.append(None if own is None else decode_ids(own, np.array([0, len(own)]), table)[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(decode, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encoded`` and ``decoded``, keeping digests only."""
    blocks, answers, data, tasks = _encoded_blocks(docs, ranks, pattern, doc_id, text)

    def finish(block: wb.Block, payloads: list[bytes]) -> pa.Table:
        table = token_bytes(data.value)
        counts, of_ids, of_bytes = [], [], []
        for _, _, ids, own in pieces(block, payloads):
            raw = memoryview(ids.astype("<u4").tobytes())
            counts += np.diff(own).tolist()
            of_ids += [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            of_bytes += [hashlib.sha256(x).hexdigest() for x in decode_ids(ids, own, table)]
        return pa.table({"doc_id": block.doc_ids, "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())})

    return wb.met(blocks, answers, finish, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", tasks)
