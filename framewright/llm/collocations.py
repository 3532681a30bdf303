"""Phrase collocations by stripes.

Each prefix keys an associative counter of what follows it. A stripe of word ``u`` counts its followers ``v``, and under each of
them the followers ``w`` of "u v"; a phrase that ends its piece is followed by a mark of its own. So one structure, added up
elementwise, has it all: an entry is the count of an extension, the sum of a stripe the count of its prefix (the mark
makes it complete), and its largest entry says whether an extension subsumes the prefix. Extensions to the left are the same
entries, keyed by their second word.

A task makes the stripes of a block of words, and sends each to the bucket of its prefix. A word that has more than a HOT_SHARE of
all words has its stripe cut by the second word, and a pair that has so much by the third as well; their sums are added up afterwards.
There are at most 1 / HOT_SHARE such words and pairs, however large the input. Every bucket merges some 16 MB of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.names import col
from framewright.llm.store import stored

LEAST = 10
#: An extension with this share of a phrase's count (in hundredths) subsumes it.
SUBSUMED = 50
TOP = 2000
#: A word or pair of words with more than this share of all words is cut over several buckets.
HOT_SHARE = 1 / 32768
#: Fewer places than this in a block never make a word hot.
LEAST_HOT = 64
BLOCK_WORDS, SLICE_BYTES, BUCKET_BYTES = 1_500_000, 2 << 20, 16 << 20
#: Entries that a bucket gathers before it merges them.
MERGE = 2_000_000
#: Buckets for the lists of the best phrases before the last one.
RANK_PARTS = 64

# Bytes that end a piece, and blanks between words.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_KIND[list(b" \t")] = 1

WORD_SUM, PAIR, TRIPLE, ALL = 1, 2, 3, 0


def words_and_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of texts without nulls, as bytes, and a number for each that is another one in another piece."""
    raw = pc.ascii_lower(texts.cast(pa.string())).cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[data]
    inner = kind == 0
    begins_text = np.zeros(len(data) + 1, bool)
    begins_text[offsets] = True
    starts = np.flatnonzero(inner & np.concatenate([[True], ~inner[:-1]])[: len(data)] | inner & begins_text[:-1])
    ends = np.flatnonzero(inner & (np.concatenate([~inner[1:], [True]])[: len(data)] | begins_text[1:])) + 1
    piece = np.cumsum(kind == 2, dtype=np.int64)[starts] if len(starts) else np.zeros(0, np.int64)
    piece += np.searchsorted(offsets, starts, side="right")
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[inner]))])
    return words, piece


def _distinct(words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode() if len(words) > 1 else words[0].dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


@dataclass
class Stripes:
    """Entries (u, v, w, n), sorted: u is a code of ``names``, v and w are codes plus one, or 0 for the end of a piece."""

    names: pa.Array
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    n: np.ndarray


def added_up(names: pa.Array, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> Stripes:
    """Equal entries as one."""
    base = len(names) + 1
    if base**3 < 1 << 63:
        key, of = np.unique((u * base + v) * base + w, return_inverse=True)
        out = key // (base * base), key // base % base, key % base
    else:
        pair, of_pair = np.unique(u * base + v, return_inverse=True)
        key, of = np.unique(of_pair * base + w, return_inverse=True)
        out = pair[key // base] // base, pair[key // base] % base, key % base
    total = np.bincount(of, minlength=len(key)) if n is None else _sums_by(of, n, len(key))
    return Stripes(names, *out, total.astype(np.int64))


def _sums_by(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    np.add.at(total, of, n)
    return total


def stripes_of(words: list[pa.Array], pieces: list[np.ndarray]) -> Stripes:
    """The stripes of consecutive words; words of one piece follow each other."""
    codes, names = _distinct(words)
    piece = np.concatenate(pieces)
    n = len(codes)
    v, w = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near, far = piece[1:] == piece[:-1], piece[2:] == piece[:-2]
    v[:-1][near] = codes[1:][near] + 1
    w[:-2][far] = codes[2:][far] + 1
    return added_up(names, codes, v, w)


Hot = dict[str, tuple[frozenset[bytes], frozenset[tuple[bytes, bytes]]]]


def _is_hot(s: Stripes, lang: str, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its first word, and its first pair, are hot."""
    words, pairs = hot.get(lang, (frozenset(), frozenset()))
    if not words and not pairs:
        return np.zeros(len(s.u), bool), np.zeros(len(s.u), bool)
    asked = sorted(words | {x for p in pairs for x in p})
    places = pc.index_in(pa.array(asked, pa.binary()), s.names).to_pylist()
    place = {x: p for x, p in zip(asked, places, strict=True) if p is not None}
    base = len(s.names) + 1
    first = np.isin(s.u, np.array([place[x] for x in words if x in place], np.int64))
    both = np.isin(s.u * base + s.v, np.array([place[a] * base + place[b] + 1 for a, b in pairs if a in place and b in place], np.int64))
    return first, both


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def buckets_of(s: Stripes, lang: str, hot: Hot, buckets: int) -> np.ndarray:
    own = np.array([xxhash.xxh3_64_intdigest(x.as_buffer()) for x in s.names] + [0], np.uint64)
    own = np.concatenate([own[-1:], own[:-1]])
    first, both = _is_hot(s, lang, hot)
    h = _mixed(own[s.u + 1] ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    h = np.where(first | both, _mixed(h + own[s.v]), h)
    h = np.where(both, _mixed(h + own[s.w]), h)
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _cut(s: Stripes, lang: str, of: np.ndarray) -> pa.RecordBatch:
    """Rows bucket, lang, entries (four planes of 32-bit numbers), lengths and body of the row's own words."""
    order = np.argsort(of, kind="stable")
    of, u, v, w, n = of[order], s.u[order], s.v[order], s.w[order], s.n[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    base = len(s.names) + 1
    # Each row numbers its words from 1, in the order of the block's codes; 0 stays the end of a piece.
    used = np.unique(np.concatenate([row * base + u + 1, row * base + v, row * base + w, np.arange(len(bounds) - 1) * base]))
    first = np.searchsorted(used, np.arange(len(bounds)) * base)
    local = lambda c: np.searchsorted(used, row * base + c) - first[row]
    planes = [x.astype(np.uint32) for x in (local(u + 1), local(v), local(w), n)]
    # A row's four planes stand one after another.
    size, flat = np.diff(bounds), np.empty(4 * len(u), np.uint32)
    within = np.arange(len(u)) - bounds[row]
    for i, plane in enumerate(planes):
        flat[4 * bounds[row] + i * size[row] + within] = plane
    code = used % base
    words = s.names.take(pa.array(code[code > 0] - 1))
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    word_bounds = first - np.arange(len(first))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    body = words.buffers()[2]
    column = lambda at, data: pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.asarray(at, np.int32)), data])
    return pa.RecordBatch.from_arrays(
        [pa.array(of[bounds[:-1]].astype(np.int32)), pa.array([lang] * (len(bounds) - 1), pa.string()), column(16 * bounds, pa.py_buffer(flat)), column(4 * word_bounds, pa.py_buffer(lengths)), column(ends[word_bounds], body if body is not None else pa.py_buffer(b""))],
        names=["bucket", "lang", "entries", "lengths", "body"],
    )


@dataclass
class Gathered:
    """What a bucket has of one language: merged stripes, and rows that wait for the next merge."""

    parts: list[Stripes] = field(default_factory=list)
    waiting: int = 0

    def add(self, entries: pa.Buffer, lengths: pa.Buffer, body: pa.Buffer) -> None:
        u, v, w, n = np.frombuffer(entries, np.uint32).reshape(4, -1).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32))]).astype(np.int32)
        names = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body.to_pybytes())])
        self.parts.append(Stripes(names, u - 1, v, w, n))
        self.waiting += len(u)
        if self.waiting > MERGE:
            self.merge()

    def merge(self) -> Stripes:
        if len(self.parts) > 1:
            codes, names = _distinct([p.names for p in self.parts])
            moved, at = [], 0
            for p in self.parts:
                own = np.concatenate([[0], codes[at : at + len(p.names)] + 1])
                at += len(p.names)
                moved.append((own[p.u + 1] - 1, own[p.v], own[p.w], p.n))
            self.parts = [added_up(names, *(np.concatenate(x) for x in zip(*moved, strict=True)))]
        elif self.waiting:
            p = self.parts[0]
            self.parts = [added_up(p.names, p.u, p.v, p.w, p.n)]
        self.waiting = 0
        return self.parts[0]


def _runs(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _found(s: Stripes, lang: str, hot: Hot, least: int) -> pa.RecordBatch:
    """Rows kind, lang, u, v, w, n, top: sums of words and pairs, and triples, that have ``least`` places or may have with other buckets'."""
    first, both = _is_hot(s, lang, hot)
    name = lambda codes: s.names.take(pa.array(codes)).cast(pa.string())
    none = lambda k: pa.nulls(k, pa.string())
    at = _runs(s.u)
    n = np.add.reduceat(s.n, at)
    keep = (n >= least) | np.maximum.reduceat(first | both, at)
    words = (s.u[at][keep], n[keep])
    at = _runs(s.u, s.v)
    n, top = np.add.reduceat(s.n, at), np.maximum.reduceat(np.where(s.w > 0, s.n, 0), at)
    keep = (s.v[at] > 0) & ((n >= least) | both[at])
    pairs = (s.u[at][keep], s.v[at][keep] - 1, n[keep], top[keep])
    keep = (s.w > 0) & (s.n >= least)
    triples = (s.u[keep], s.v[keep] - 1, s.w[keep] - 1, s.n[keep])
    sizes = [1, len(words[0]), len(pairs[0]), len(triples[0])]
    cat = lambda *parts: pa.concat_arrays(list(parts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array([ALL, WORD_SUM, PAIR, TRIPLE], np.int32), sizes)), pa.array([lang] * sum(sizes), pa.string()),
            cat(none(1), name(words[0]), name(pairs[0]), name(triples[0])), cat(none(1), none(sizes[1]), name(pairs[1]), name(triples[1])), cat(none(1), none(sizes[1]), none(sizes[2]), name(triples[2])),
            pa.array(np.concatenate([[s.n.sum()], words[1], pairs[2], triples[3]]).astype(np.int64)), pa.array(np.concatenate([np.zeros(1 + sizes[1]), pairs[3], np.zeros(sizes[3])]).astype(np.int64)),
        ],
        names=["kind", "lang", "u", "v", "w", "n", "top"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, list[pa.Array], list[np.ndarray]]]]:
    """Blocks of about BLOCK_WORDS words: for each language its words and their pieces."""
    held: dict[str, tuple[list[pa.Array], list[np.ndarray]]] = {}
    total, base = 0, 0
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            coded = part.column("lang").dictionary_encode()
            of = coded.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                words, piece = words_and_pieces(pc.fill_null(part.column("text").filter(pa.array(of == i)), ""))
                if not len(words):
                    continue
                own = held.setdefault(lang, ([], []))
                own[0].append(words)
                own[1].append(piece + base)
                base += int(piece[-1]) + 1
                total += len(words)
            if total >= BLOCK_WORDS:
                yield [(lang, *x) for lang, x in held.items()]
                held, total = {}, 0
                pa.default_memory_pool().release_unused()
    if held:
        yield [(lang, *x) for lang, x in held.items()]


def hot_prefixes(slim: DataFrame, share: float | None = None, least: int | None = None) -> Hot:
    """Words and pairs with more than ``share`` of all words: 1 / share of each at most, so the driver may have them.

    A block reports what has this share of its own words. What has it of all but not of single blocks can be missed by a
    part; it only balances buckets.
    """
    share, least = HOT_SHARE if share is None else share, LEAST_HOT if least is None else least

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            rows, total = [], sum(len(x) for _, words, _ in block for x in words)
            for lang, words, pieces in block:
                codes, names = _distinct(words)
                piece = np.concatenate(pieces)
                bar = max(least, share * total)
                often = np.bincount(codes, minlength=len(names))
                rows += [(lang, names[int(i)].as_py(), None, int(often[i])) for i in np.flatnonzero(often > bar)]
                near = (piece[1:] == piece[:-1]) & (often[codes[:-1]] > bar)
                key, n = np.unique((codes[:-1] * len(names) + codes[1:])[near], return_counts=True)
                rows += [(lang, names[int(k // len(names))].as_py(), names[int(k % len(names))].as_py(), int(c)) for k, c in zip(key[n > bar], n[n > bar], strict=True)]
            rows.append((None, None, None, total))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["lang", "u", "v", "n"])

    found = slim.mapInArrow(look, "lang string, u binary, v binary, n long").groupBy("lang", "u", "v").agg(F.sum("n").alias("n"))
    found = stored(found, "hot-prefixes")
    total = found.filter("lang is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot: dict[str, tuple[set, set]] = {}
    for r in found.filter("lang is not null").filter(F.col("n") > share * total).toLocalIterator():
        words, pairs = hot.setdefault(r["lang"], (set(), set()))
        if r["v"] is None:
            words.add(bytes(r["u"]))
        else:
            pairs.add((bytes(r["u"]), bytes(r["v"])))
    return {lang: (frozenset(a), frozenset(b)) for lang, (a, b) in hot.items()}


def merged_stripes(slim: DataFrame, least: int = LEAST, share: float | None = None) -> DataFrame:
    """kind, lang, u, v, w, n, top of rows (lang, text): what ``_found`` gives of every bucket, hot prefixes in parts."""
    hot = hot_prefixes(slim, share)
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(slim.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES + 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for lang, words, pieces in block:
                own = stripes_of(words, pieces)
                words.clear()
                yield _cut(own, lang, buckets_of(own, lang, hot, buckets))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Gathered] = {}
        for batch in batches:
            for lang, *parts in zip(batch.column("lang").to_pylist(), *(batch.column(c) for c in ("entries", "lengths", "body")), strict=True):
                held.setdefault(lang, Gathered()).add(*(p.as_buffer() for p in parts))
        for lang in list(held):
            yield _found(held.pop(lang).merge(), lang, hot, least)
        pa.default_memory_pool().release_unused()

    made = slim.mapInArrow(make, "bucket int, lang string, entries binary, lengths binary, body binary")
    return made.repartitionById(buckets, "bucket").mapInArrow(merge, "kind int, lang string, u string, v string, w string, n long, top long")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)): whole decimals, exact up to 38 digits (counts up to 5 * 10^15)."""
    whole = lambda c: c.cast("decimal(19,0)")
    over = (F.lit(1000000).cast("decimal(7,0)") * (whole(a) * whole(a)).cast("decimal(32,0)")).cast("decimal(38,0)")
    under = (whole(left) * whole(right)).cast("decimal(38,0)")
    return ((over - over % under) / under).cast("long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two and three words.

    Texts are lower-cased (A-Z) and cut at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words; phrases don't
    leave a piece and overlaps count. A phrase with ``least`` places or more is a candidate; its score is that of its worst
    cut, 1000000 a a / (l r) cut to a whole number, of equal ones the first. Pairs whose words stand in a candidate of three that
    has half their places are left out. Ties go by a, then by the phrase's bytes. A null language is ``und``, a null text
    an empty one; repeated rows count as often as they stand; texts of any length are whole; an empty table, or one without
    candidates, gives an empty result; other columns aren't read.
    """
    slim = docs.select(F.coalesce(col(lang), F.lit("und")).alias("lang"), col(text).alias("text"))
    rows = stored(merged_stripes(slim, least), "stripes")
    total = rows.filter(F.col("kind") == ALL).groupBy("lang").agg(F.sum("n").alias("n"))
    words = rows.filter(F.col("kind") == WORD_SUM).groupBy("lang", "u").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    pairs = rows.filter(F.col("kind") == PAIR).groupBy("lang", "u", "v").agg(F.sum("n").alias("a"), F.max("top").alias("right_top")).filter(F.col("a") >= least)
    triples = rows.filter(F.col("kind") == TRIPLE).select("lang", "u", "v", "w", F.col("n").alias("a"))

    def with_count(df: DataFrame, of: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
        other = of.select(F.col("lang").alias("_lang"), *(F.col(k).alias(f"_{k}") for k in keys), F.col("a").alias(name))
        on = [df["lang"] == other["_lang"], *(df[own] == other[f"_{k}"] for k, own in keys.items())]
        return df.join(other, on).drop("_lang", *(f"_{k}" for k in keys))

    left_top = triples.groupBy(F.col("lang").alias("_lang"), F.col("v").alias("_u"), F.col("w").alias("_v")).agg(F.max("a").alias("left_top"))
    free = pairs.join(left_top, (pairs["lang"] == left_top["_lang"]) & (pairs["u"] == left_top["_u"]) & (pairs["v"] == left_top["_v"]), "left")
    longest = F.greatest(F.coalesce("left_top", F.lit(0)), "right_top")
    free = free.filter((longest < least) | (100 * longest < SUBSUMED * F.col("a"))).select("lang", "u", "v", "a")
    two = with_count(with_count(free, words, {"u": "u"}, "l"), words, {"u": "v"}, "r")
    two = two.select("lang", F.concat_ws(" ", "u", "v").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = with_count(with_count(triples, words, {"u": "u"}, "l1"), pairs, {"u": "v", "v": "w"}, "r1")
    three = with_count(with_count(three, pairs, {"u": "u", "v": "v"}, "l2"), words, {"u": "w"}, "r2")
    three = three.withColumns({"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))})
    pick = lambda x: F.when(F.col("s1") <= F.col("s2"), F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias({"l": "l", "r": "r", "s": "score"}[x])
    three = three.select("lang", F.concat_ws(" ", "u", "v", "w").alias("phrase"), "a", pick("l"), pick("r"), pick("s"))
    # The best of each part first, so that no task orders a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return found.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
