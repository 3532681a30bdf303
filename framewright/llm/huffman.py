"""Token ids in files: canonical length-limited Huffman codes from global counts.

A file set is a Parquet folder ``codes`` (symbol, length: the code book, which canonical order completes) and a
Parquet folder ``blocks``: part, block, first (tokens of the part before the block), doc_ids, counts (tokens of
each document), sizes (bytes of each), marks (bit offsets, from a document's first bit, of every 1024th token
after its first) and bits. Documents begin at whole bytes, so blocks and documents decode alone; the marks split
long ones into lanes, which decode side by side from one table. Parts follow the order of ids, and so do the
documents in them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import wordblocks as wb
from framewright.llm.bytebpe import pieces
from framewright.llm.names import col
from framewright.llm.store import new_path, stored

#: The longest code, unless there are more symbols than it can tell apart; tokens of a block, at least; tokens of a lane.
MAX_BITS, BLOCK_TOKENS, LANE = 16, 65536, 1024
#: Tokens that a part should hold, and that are decoded at a time.
PART_TOKENS, DECODE_TOKENS = 16_000_000, 2_000_000
#: Lines of words that are encoded at a time.
LINES = 64


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over ``most`` bits, by package-merge. Counts are positive."""
    n = len(counts)
    if n <= 2:
        return np.ones(n, np.int64)
    most = max(most, (n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    packages = np.zeros(0, np.int64)
    is_leaf: list[np.ndarray] = []
    for _ in range(most):
        merged = np.concatenate([leaves, packages])
        by_weight = np.argsort(merged, kind="stable")
        is_leaf.append(by_weight < n)
        merged = merged[by_weight]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by (length, symbol), their lengths and codes."""
    order = np.lexsort((symbols, lengths))
    symbols, lengths = symbols[order], lengths[order].astype(np.int64)
    top = int(lengths.max(initial=1))
    steps = np.left_shift(1, top - lengths)
    codes = np.right_shift(np.cumsum(steps) - steps, top - lengths)
    return symbols, lengths, codes


def pack_bits(codes: np.ndarray, lengths: np.ndarray, at: np.ndarray, n_bytes: int) -> bytes:
    """Codes of up to 32 bits at ascending bit positions that don't overlap, first bit first."""
    words = np.zeros(n_bytes // 8 + 2, np.uint64)
    if len(codes):
        w, shift = at >> 6, 64 - (at & 63) - lengths
        codes = codes.astype(np.uint64)
        over = shift < 0
        high = np.where(over, codes >> np.maximum(-shift, 0).astype(np.uint64), codes << np.maximum(shift, 0).astype(np.uint64))
        heads = np.flatnonzero(np.diff(w, prepend=-1))
        words[w[heads]] |= np.bitwise_or.reduceat(high, heads)
        words[w[over] + 1] |= codes[over] << (64 + shift[over]).astype(np.uint64)
    return words.byteswap().tobytes()[:n_bytes]


def code_documents(ids: np.ndarray, bounds: np.ndarray, code_of: np.ndarray, length_of: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Each document's bits, from a whole byte on, and its marks."""
    lengths = length_of[ids].astype(np.int64)
    ends = np.cumsum(lengths)
    ends0 = np.concatenate([[0], ends])
    bits = np.diff(ends0[bounds])
    sizes = (bits + 7) // 8
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = np.diff(bounds)
    own = ends0[:-1] - np.repeat(ends0[bounds[:-1]], n)
    data = pack_bits(code_of[ids], lengths, own + np.repeat(8 * starts[:-1], n), int(starts[-1]))
    marks = [own[a + LANE : b : LANE] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return [data[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], marks


@lru_cache(4)
def decode_table(book: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length by the next bits; the number of those. ``book``: packed symbols and lengths."""
    symbols, lengths, codes = canonical_codes(*(a.astype(np.int64) for a in wb.unpack(book)))
    top = int(lengths.max(initial=1))
    # In canonical order the codes fill the table from its start.
    repeats = np.left_shift(1, top - lengths)
    symbol, length = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    filled = int(repeats.sum())
    symbol[:filled], length[:filled] = np.repeat(symbols, repeats), np.repeat(lengths, repeats)
    return symbol, length, top


def decode_lanes(data: bytes, at: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The tokens of lanes that begin at bit positions ``at``, lane after lane."""
    symbol, length, top = table
    raw = np.frombuffer(data + bytes(8), np.uint8)
    windows = np.ndarray((len(raw) - 4,), ">u4", raw, strides=(1,))
    order = np.argsort(-counts, kind="stable")
    at, left = at[order].copy(), counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint32)
    active_at = len(counts) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), side="right")
    mask = (1 << top) - 1
    for i, k in enumerate(active_at.tolist()):
        p = at[:k]
        peek = (windows[p >> 3].astype(np.int64) >> (32 - top - (p & 7))) & mask
        out[starts[:k] + i] = symbol[peek]
        p += length[peek]
    return out


def _encode_shard(data, added: dict[str, int]):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(data.value)
        known = {_word_of(i).encode(): [i] for i in added.values()}
        memo: dict[bytes, list[int]] = {}
        totals = np.zeros(1, np.int64)
        for batch in batches:
            out = []
            for p in batch.column("payload"):
                codes, words, (places,) = wb.unpack_words(p.as_py())
                fresh = [w for w in words if w not in memo]
                if len(memo) + len(fresh) > wb.MEMO:
                    memo.clear()
                    fresh = words
                memo.update(zip(fresh, encode_words(tokenizer, [w.decode() for w in fresh]), strict=True))
                ids = [known.get(w) or memo[w] for w in words]
                lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
                if len(flat):
                    found = np.bincount(flat, weights=np.repeat(places, lengths)).astype(np.int64)
                    if len(found) > len(totals):
                        totals = np.concatenate([totals, np.zeros(len(found) - len(totals), np.int64)])
                    totals[: len(found)] += found
                out.append(wb.pack(np.diff(codes, prepend=0), lengths, flat))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("shard"), pa.array(out, pa.binary())], names=["block", "shard", "payload"])
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([-1], pa.int32()), pa.array([wb.pack(seen, totals[seen])], pa.binary())], names=["block", "shard", "payload"])

    return answer


@lru_cache(4)
def tokenizer_of(data: bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.encode_special_tokens = True  # lower-cased words that look like added tokens are ordinary text
    return tokenizer


def added_tokens(data: bytes) -> dict[str, int]:
    """The strings that the tokenizer finds in a raw text, before it lower-cases the rest, and their ids."""
    return {t.content: i for i, t in tokenizer_of(data).get_added_tokens_decoder().items()}


def _word_of(added_id: int) -> str:
    """Stands for an added token among lower-cased words, none of which has a capital of A-Z."""
    return f"ID{added_id}"


def splitter(added: dict[str, int]):
    """As split_words, with each of these exact spellings in the raw text as a word of its own."""
    if not added:
        return split_words
    pattern = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))

    def cut(text: str) -> str:
        out, at = [], 0
        for m in pattern.finditer(text):
            out += [_split_marks(text[at : m.start()]), _word_of(added[m[0]])]
            at = m.end()
        return " ".join([*out, _split_marks(text[at:])])

    def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        has = pc.match_substring_regex(texts, pattern.pattern)
        words = _cut_marks(texts)
        if pc.any(has).as_py():
            words = pc.replace_with_mask(words, has, pa.array([cut(t) for t in texts.filter(has).to_pylist()], words.type))
        return wb.blank_split(words)

    return split


def _cut_marks(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,])(\s|$)", r"\1 \2\3")


def _split_marks(text: str) -> str:
    return _cut_marks(pa.array([text]))[0].as_py()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks, across which this kind of tokenizer never joins.

    To leave fewer distinct words, A-Z is lower-cased, as the tokenizer does itself, and a full stop or comma between a
    Latin-1 letter and a blank is taken off, where the tokenizer cuts anyway. (Other letters may end in a mark when
    lower-cased, which goes with what follows.)
    """
    return wb.blank_split(_cut_marks(texts))


def encode_words(tokenizer, words: list[str], together: int = 128) -> list[list[int]]:
    """Each word's ids. Words are encoded in lines, where a token's offset tells its word."""
    lines = [words[i : i + together] for i in range(0, len(words), together)]
    out: list[list[int]] = []
    for i in range(0, len(lines), LINES):
        some = lines[i : i + LINES]
        for own, e in zip(some, tokenizer.encode_batch([" ".join(x) for x in some], add_special_tokens=False), strict=True):
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            of = np.searchsorted(ends, np.array([a for a, _ in e.offsets], np.int64), side="right")
            cuts = np.searchsorted(of, np.arange(len(own) + 1)).tolist()
            ids = e.ids
            out += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _explode_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.column("payload"):
            ids, n = wb.unpack(p.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64))], names=["id", "n"])


def part_starts(docs: DataFrame, doc_id: str, parts: int) -> np.ndarray:
    """The first ids of about ``parts`` ranges of ids with as many rows; only ids are shuffled."""
    ids = docs.select(col(doc_id).alias("doc_id")).filter("doc_id is not null").repartitionByRange(parts, "doc_id")
    found = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).collect()
    return np.array(sorted(r["first"] for r in found), np.int64)


def write_ids(docs: DataFrame, tokenizer: bytes, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> None:
    """Encodes every whole text, appends ``end_id`` to each and writes a file set to ``path``.

    With ``added``, the tokenizer's added tokens are found in the texts, as it does by default; without, their strings
    are ordinary text.

    Words between blanks are encoded once for the whole table (see wordblocks); their counts and ids give the
    global counts of ids without another pass. A null text is an empty one: it has the end id alone. Ids are
    whole numbers; rows with a null one come last, equal ids one after another. Other columns aren't read.
    """
    spark: SparkSession = docs.sparkSession
    shards, tasks = wb.sizes_for(docs, text)
    data = spark.sparkContext.broadcast(tokenizer)  # as large as the tokenizer file
    found = added_tokens(tokenizer) if added else {}
    blocks = stored(wb.word_blocks(docs, splitter(found), shards, doc_id, text, counted=True), "words")
    answers = stored(wb.answered(blocks, shards, _encode_shard(data, found)), "word-ids")
    counted = answers.filter("block < 0").mapInArrow(_explode_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r["id"]: r["n"] for r in counted.collect()}  # at most the vocabulary
    n_docs = blocks.filter("shard < 0").select(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
    if n_docs:
        counts[end_id] = counts.get(end_id, 0) + n_docs
    symbols = np.array(sorted(counts), np.int64)
    lengths = code_lengths(np.array([counts[s] for s in symbols.tolist()], np.int64))
    book = spark.createDataFrame([(int(s), int(n)) for s, n in zip(symbols, lengths, strict=True)], "symbol long, length int")
    book.coalesce(1).write.parquet(f"{path}/codes")
    starts = part_starts(docs, doc_id, max(tasks, sum(counts.values()) // PART_TOKENS))
    tables = spark.sparkContext.broadcast((*canonical_codes(symbols, lengths), starts))  # the vocabulary and the parts

    def code(block: wb.Block, payloads: list[bytes]) -> pa.Table:
        by_length, own_lengths, own_codes, firsts = tables.value
        top = int(by_length.max(initial=0)) + 1
        code_of, length_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
        code_of[by_length], length_of[by_length] = own_codes, own_lengths
        out = []
        for a, b, ids, own in pieces(block, payloads):
            ids = np.insert(ids, own[1:], end_id)
            own = own + np.arange(len(own))
            bits, marks = code_documents(ids, own, code_of, length_of)
            doc_ids = block.doc_ids.slice(a, b - a)
            known = doc_ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            part = np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), len(firsts), np.maximum(np.searchsorted(firsts, known, side="right") - 1, 0))
            out.append(pa.table({"part": pa.array(part, pa.int32()), "doc_id": doc_ids.cast(pa.int64()), "n_tokens": pa.array(np.diff(own), pa.int64()), "marks": pa.array(marks, pa.list_(pa.int64())), "bits": pa.array(bits, pa.binary())}))
        return pa.concat_tables(out)

    coded = wb.met(blocks, answers.filter("block >= 0"), code, "part int, doc_id long, n_tokens long, marks array<long>, bits binary", tasks)
    ordered = coded.repartitionById(len(starts) + 1, "part").sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_last(), F.col("n_tokens"), F.col("bits"))
    schema = "part int, block long, first long, doc_ids array<long>, counts array<long>, sizes array<long>, marks array<long>, bits binary"
    ordered.mapInArrow(_fill_blocks, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _fill_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "block", "first", "doc_ids", "counts", "sizes", "marks", "bits"]
    longs = pa.list_(pa.int64())
    kinds = (pa.int32(), pa.int64(), pa.int64(), longs, longs, longs, longs, pa.binary())
    part, number, first, total, rows = None, 0, 0, 0, []

    def close() -> pa.RecordBatch:
        ids, counts, marks, bits = zip(*rows, strict=True)
        row = (part, number, first, list(ids), list(counts), [len(x) for x in bits], [m for x in marks for m in x], b"".join(bits))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        for p, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "marks", "bits")), strict=True):
            if rows and (p != part or total >= BLOCK_TOKENS):
                yield close()
                number, first, total, rows = number + 1, first + total, 0, []
            if p != part:
                part, number, first = p, 0, 0
            rows.append(row)
            total += row[1]
    if rows:
        yield close()


def read_ids(spark: SparkSession, path: str, summarise, schema: str) -> DataFrame:
    """Decodes a file set. ``summarise(doc_ids, starts, counts, flat ids)`` gives a table's columns for its documents."""
    book = spark.read.parquet(f"{path}/codes").collect()  # at most the vocabulary
    data = spark.sparkContext.broadcast(wb.pack(np.array([r["symbol"] for r in book], np.int64), np.array([r["length"] for r in book], np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # A row per part.
    before = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = blocks.join(before, blocks["part"] == before["of"]).select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "counts", "sizes", "marks", "bits")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(data.value)
        for batch in batches:
            sizes = [sum(x) for x in batch.column("counts").to_pylist()]
            a = 0
            while a < batch.num_rows:
                b, total = a + 1, sizes[a]
                while b < batch.num_rows and total + sizes[b] <= DECODE_TOKENS:
                    total += sizes[b]
                    b += 1
                yield _decode_rows(batch.slice(a, b - a), table, summarise)
                a = b

    return rows.mapInArrow(decode, schema)


def _decode_rows(batch: pa.RecordBatch, table, summarise) -> pa.RecordBatch:
    flat = lambda c: np.concatenate([np.array(x, np.int64) for x in batch.column(c).to_pylist()])
    counts, sizes, marks = flat("counts"), flat("sizes"), flat("marks")
    docs_in = np.array([len(x) for x in batch.column("counts")], np.int64)
    at = 8 * (np.cumsum(sizes) - sizes)
    lanes = np.maximum(1, -(-counts // LANE))
    lane_at = np.repeat(at, lanes)
    heads = np.cumsum(lanes) - lanes
    later = np.ones(len(lane_at), bool)
    later[heads] = False
    lane_at[later] += marks
    lane_counts = np.full(len(lane_at), LANE, np.int64)
    lane_counts[heads + lanes - 1] = counts - (lanes - 1) * LANE
    ids = decode_lanes(b"".join(x.as_py() for x in batch.column("bits")), lane_at, lane_counts, table)
    firsts = np.repeat(batch.column("first").to_numpy(zero_copy_only=False), docs_in)
    ends = np.cumsum(counts)
    within = ends - counts - np.repeat(np.concatenate([[0], ends])[np.cumsum(docs_in) - docs_in], docs_in)
    doc_ids = pa.array([d for x in batch.column("doc_ids").to_pylist() for d in x], pa.int64())
    return summarise(doc_ids, firsts + within, counts, ids)


def crc_rows(doc_ids: pa.Array, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    raw = memoryview(ids.astype("<u4").tobytes())
    ends = np.cumsum(counts)
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def id_rows(doc_ids: pa.Array, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(starts, pa.int64()), lists], names=["doc_id", "start", "ids"])


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before), ids of a file set."""
    return read_ids(spark, path, id_rows, "doc_id long, start long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: bytes, end_id: int, doc_id: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """Writes a file set to the shared folder and reads back doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, tokenizer, end_id, path, doc_id, text, added)
    return read_ids(docs.sparkSession, path, crc_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
