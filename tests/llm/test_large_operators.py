"""Near-dedup, token files, encoders, language model and pipeline against plain versions."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc
import uuid
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import bytebpe, forest, groups, huffman, linededup, mixing, ngramlm, vectors
from framewright.llm import wordblocks as wb
from framewright.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, shard int, rep long, node string"
ODD = [
    (1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "the the  the\n", "s"), (4, "naïve Öl ——    1234 don't I'LL <|endoftext|>\x00\x1f\x85", "s"), (4, "naïve Öl ——    1234 don't I'LL <|endoftext|>\x00\x1f\x85", "s"),
    (5, "x" * 3000, "s"), (6, " \t\n ", "s"), (7, "é É, end. End, ퟿ 日本語。 K..", "s"), (1, "other text of id 1", "s"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 7, 3, 4, 5, "n") for i, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000)]
    nodes = {x for e in links if e[0] != e[1] for x in e}
    want = roots(nodes, [e for e in links if e[0] != e[1]])
    rows = components(spark.createDataFrame([*links, (None, 3)], "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Vectors ----------------------------------------------------------------------------------------------


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(groups, "CHUNK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), i % 2) for i in range(60)]
    centre = rng.normal(size=16)
    rows += [(100 + i, (centre + rng.normal(size=16) * 0.09).tolist(), 1) for i in range(70)] + [(200 + i, (centre * 2).tolist(), 1) for i in range(5)] + [(204, (centre * 2).tolist(), 1)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [], 1), (305, centre.tolist(), None), (306, centre.tolist()[:8], 1), (307, [float("inf")] * 16, 1), (308, (centre * 1e200).tolist(), 1), (None, centre.tolist(), 1)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, links string, rep long, component long")
    got = collections.defaultdict(list)
    for r in vectors.near_vectors(frame).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"], r["kept"]))
    good = [(i, np.array(v) / np.abs(v).max(), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98
    links = [(a[0], b[0]) for i, a in enumerate(good) for b in good[i + 1 :] if a[2] == b[2] and near(a[1], b[1])]
    count = collections.Counter(x for e in links for x in e)
    least = roots({r[0] for r in rows if r[0] is not None}, links)
    for i, found in got.items():
        for n, component, kept in found:
            if i == 204:  # stands twice
                assert n == count[i] // 2 and component == least[i]
            elif i is None:
                assert (n, component, kept) == (0, None, True)
            else:
                assert (n, component, kept) == (count[i], least[i], least[i] == i), i
    assert sum(map(len, got.values())) == len(rows) and len(links) > 500
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_table_shapes_grow_slowly():
    assert [vectors.table_shape(n)[0] for n in (10, 1000, 10**6)] == sorted(vectors.table_shape(n)[0] for n in (10, 1000, 10**6))
    k, tables = vectors.table_shape(5000)
    hit = vectors.same_cell(math.sqrt(0.04)) ** k
    assert 1 - (1 - hit) ** tables >= vectors.RECALL


# --- Jaccard join -----------------------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def against_all_pairs(rows, got):
    sets = [(r[0], shingle_set(r[1])) for r in rows if r[0] is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and len(x & y) >= 0.8 * len(x | y)]
    least = roots({i for i, _ in sets}, links)
    count = collections.Counter(x for e in links for x in e)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_links"], r["class_id"], r["kept"]) == (count[r["doc_id"]], least[r["doc_id"]], least[r["doc_id"]] == r["doc_id"]), r
    return links


def test_join_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(groups, "CHUNK", 24)
    monkeypatch.setattr(forest, "CLUSTER_CHUNK", 16)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: [words[i] for i in rng.integers(0, 500, n)]
    rows, k, base = [], 0, text(120)
    shared = text(60)
    for i in range(60):
        t = list(base)
        for j in rng.integers(0, 120, i % 5):
            t[j] = f"x{i}"
        rows.append((k + i, " ".join(t), "s"))
    rows += [(100 + i, " ".join(text(30) + shared), "s") for i in range(20)] + [(150 + i, " ".join(text(80)), "s") for i in range(40)]
    rows += [(200, "short text", "s"), (201, "short  text", "s"), (202, "short text two", "s"), (203, None, "s"), (204, "", "s"), (205, "  ", "s"), (206, "same five words stand here", "s"), (207, "same five words stand here", "s"), (None, "short text", "s")]
    got = forest.near_texts(docs(spark, rows)).collect()
    assert len(got) == len(rows) and len(against_all_pairs(rows, got)) > 300
    kept = forest.one_of_each(docs(spark, rows))
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None)
    assert forest.near_texts(empty(spark)).count() == forest.one_of_each(empty(spark)).count() == 0


def test_join_on_given_documents(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    against_all_pairs(rows, forest.near_texts(frame).collect())


def pairs_of(n, words, changed, seed):
    """Texts in pairs that differ in single words far from each other."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        t = [f"w{x}" for x in rng.integers(0, 10**6, words)]
        s = list(t)
        for j in range(changed):
            s[10 + 7 * j] = f"other{j}"
        rows += [(2 * i, " ".join(t), "s"), (2 * i + 1, " ".join(s), "s")]
    return rows


@pytest.mark.parametrize(("jaccard", "words", "changed"), [(0.8, 94, 2), (0.65, 54, 2)])
def test_recall_of_pairs_at_the_threshold(spark, jaccard, words, changed):
    """Pairs right at the threshold are found, whatever it is; a group of almost equal copies beside them changes nothing."""
    rows = pairs_of(300, words, changed, 3)
    a, b = shingle_set(rows[0][1]), shingle_set(rows[1][1])
    assert jaccard <= len(a & b) / len(a | b) < jaccard + 0.02
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(400)) + f" end{i}", "s") for i in range(100)]
    got = forest.near_texts(docs(spark, rows), jaccard=jaccard).collect()
    assert sum(r["n_links"] == 1 for r in got if r["doc_id"] < 1000) == 600 and all(r["n_links"] == 99 for r in got if r["doc_id"] >= 1000)


def test_prefixes_are_shortened_until_recall():
    assert forest.prefix_depth(0.8, 0.99) == forest.DEPTH and forest.prefix_depth(0.8, 0.9995) == forest.DEPTH - 1
    for jaccard in (0.4, 0.65, 0.8, 0.95):
        depth = forest.prefix_depth(jaccard)
        assert forest.found_at(jaccard, depth) >= forest.RECALL and (depth == forest.DEPTH or forest.found_at(jaccard, depth + 1) < forest.RECALL)
    with pytest.raises(ValueError, match="recall"):
        forest.prefix_depth(0.1)


def test_one_of_each_with_repeats(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base, "more"])
    rows = [(1, " ".join(base), "a"), (1, " ".join(base), "b"), (1, " ".join(base), "c"), (2, near, "s"), (2, "a text of its own", "s"), (3, near, "s"), (None, " ".join(base), "s"), (None, " ".join(base), "s"), (4, None, "s"), (4, None, "s"), (5, "twice the same words", "s"), (5, "twice the same words", "s")]
    frame = docs(spark, rows).withColumnRenamed("source", "the.source").withColumnRenamed("text", "a text")
    kept = forest.one_of_each(frame, text="a text")
    assert kept.columns == frame.columns
    assert sorted(map(str, ((r["doc_id"], r["a text"]) for r in kept.collect()))) == sorted(map(str, [(1, " ".join(base)), (2, "a text of its own"), (None, " ".join(base)), (None, " ".join(base)), (4, None), (4, None), (5, "twice the same words")]))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        forest.near_texts(docs(spark, rows[:1]).withColumn("doc_id", F.lit("x1"))).collect()


def test_long_texts_join(spark):
    words = [f"w{i % 9973}" for i in range(700_000)]
    rows = [(1, " ".join(words), "s"), (2, " ".join([*words[:-1000], *("x",) * 1000]), "s"), (3, "short", "s")]
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in forest.near_texts(docs(spark, rows)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_clusters_are_cut_by_size(spark, monkeypatch):
    """Texts of very different lengths in one cluster meet only if their lengths are near."""
    monkeypatch.setattr(forest, "CLUSTER_CHUNK", 8)
    sizes = [(i, 10 + 3 * i) for i in range(60)]
    sets = spark.createDataFrame([(i, 1, 5, 60, bytearray(np.arange(n, dtype=np.uint64).tobytes()), n) for i, n in sizes], "rep long, copies long, component long, size long, shingles binary, n long")
    found = groups.compare_blocks(forest._cluster_blocks(sets, 0.8), lambda t, b: forest._verify(t, b, 0.8), "rep long, links long, root long").groupBy("rep").agg(F.sum("links").alias("n")).collect()
    want = {i: sum(j != i and min(n, m) >= 0.8 * max(n, m) for j, m in sizes) for i, n in sizes}
    assert {r["rep"]: r["n"] for r in found} == {i: n for i, n in want.items() if n}
    rows = forest._cluster_blocks(sets, 0.8).groupBy("block_key").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert rows < 0.6 * 4 * 60 * 60


@settings(max_examples=50, deadline=None)
@given(hs.lists(hs.lists(hs.integers(0, 2**33), max_size=40), max_size=4))
def test_packed_numbers(arrays):
    arrays = [np.array(a, np.int64) for a in arrays]
    assert [a.tolist() for a in wb.unpack(wb.pack(*arrays))] == [a.tolist() for a in arrays]


def ranks():
    return bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def library():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_byte_bpe(spark, sf, monkeypatch):
    monkeypatch.setattr(bytebpe, "CHUNK", 50)
    rows = ODD + [(r["doc_id"] + 1000, r["text"], "s") for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    frame, e = docs(spark, rows), library()
    want = collections.Counter((i, tuple(e.encode_ordinary(t or ""))) for i, t, _ in rows)
    encoded = bytebpe.encoded(frame, ranks(), public_tokenizers.PATTERN)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == want
    back = collections.Counter((r["doc_id"], bytes(r["bytes"]).decode()) for r in bytebpe.decoded(encoded, ranks()).collect())
    assert back == collections.Counter((i, t or "") for i, t, _ in rows)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    digests = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.digests(frame, ranks(), public_tokenizers.PATTERN).collect())
    assert digests == collections.Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows for x in [e.encode_ordinary(t or "")])
    assert bytebpe.digests(empty(spark), ranks(), public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(hs.text(max_size=40))
def test_pre_tokens_are_the_library_s(text):
    import pyarrow as pa

    words, counts = bytebpe.splitter(public_tokenizers.PATTERN)(pa.array([text.encode("utf-8", "ignore").decode()]))
    e = library_once()
    assert [i for w in words.to_pylist() for i in e.encode_ordinary(w)] == e.encode_ordinary(text.encode("utf-8", "ignore").decode()) and counts.tolist() == [len(words)]


def library_once(found=[]):  # noqa: B006
    if not found:
        found.append(library())
    return found[0]


def word_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.one_of(hs.text(max_size=12), hs.sampled_from(["Abc.", "it's,", "É.", "x..", "a,b.", "<|endoftext|>", "İ.", "ŉ,"])), max_size=6).map(" ".join))
def test_words_encode_as_whole_texts(text):
    import pyarrow as pa

    text = text.encode("utf-8", "ignore").decode()
    t = word_tokenizer_once()
    words, _ = huffman.split_words(pa.array([text]))
    ids = huffman.encode_words(t, words.to_pylist(), together=3)
    assert [i for x in ids for i in x] == t.encode(text, add_special_tokens=False).ids


def word_tokenizer_once(found=[]):  # noqa: B006
    if not found:
        found.append(word_tokenizer())
    return found[0]


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.integers(1, 10**6), min_size=1, max_size=200), hs.integers(8, 16))
def test_code_lengths(counts, most):
    lengths = huffman.code_lengths(np.array(counts, np.int64), most)
    assert lengths.max() <= max(most, (len(counts) - 1).bit_length()) and (sum(2.0 ** -int(x) for x in lengths) <= 1)
    if most == 16 and len(counts) > 2:
        import heapq

        heap = [(n, i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        cost, deepest = 0, {i: 0 for i in range(len(counts))}
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            deepest[i] = max(deepest[i], deepest[j]) + 1
            heapq.heappush(heap, (a + b, i))
        if deepest[heap[0][1]] <= 16:
            assert int((lengths * np.array(counts)).sum()) == cost


def test_bits_round_trip():
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 9000) % 300
    symbols, counts = np.unique(ids, return_counts=True)
    book = wb.pack(symbols, huffman.code_lengths(counts.astype(np.int64), 10))
    by, lengths, codes = huffman.canonical_codes(*(a.astype(np.int64) for a in wb.unpack(book)))
    code_of, length_of = np.zeros(301, np.int64), np.zeros(301, np.int64)
    code_of[by], length_of[by] = codes, lengths
    bounds = np.array([0, 0, 1, 1025, 1026, 9000])
    bits, marks = huffman.code_documents(ids, bounds, code_of, length_of)
    at = 8 * np.concatenate([[0], np.cumsum([len(b) for b in bits])])[:-1]
    lane_at = np.concatenate([np.concatenate([[a], a + m]) for a, m in zip(at, marks, strict=True)])
    lane_n = np.concatenate([[min(1024, n - i) for i in range(0, max(n, 1), 1024)] for n in np.diff(bounds)])
    assert huffman.decode_lanes(b"".join(bits), lane_at.astype(np.int64), lane_n.astype(np.int64), huffman.decode_table(book)).tolist() == ids.tolist()


def test_token_files(spark, sf, tmp_path):
    rows = ODD + [(r["doc_id"] + 1000, r["text"], "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows.append((5000, "long " * 5000 + "é, x", "s"))
    data = bytebpe.read_ranks(public_tokenizers.path("word_bpe_49k.json"))
    t = word_tokenizer()
    ids = {k: t.encode(r[1] or "", add_special_tokens=False).ids + [2] for k, r in enumerate(rows)}
    huffman.write_ids(docs(spark, rows), data, 2, str(tmp_path / "ids"))
    got = huffman.ids_of(spark, str(tmp_path / "ids")).collect()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == collections.Counter((r[0], tuple(ids[k])) for k, r in enumerate(rows))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"])
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert known == sorted((i for i in known if i is not None)) + [None]
    crc = {(r["start"], r["n_tokens"], r["ids_crc32"]) for r in huffman.round_trip(docs(spark, rows), data, 2).collect()}
    assert crc == {(r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}
    assert huffman.round_trip(empty(spark), data, 2).count() == 0


def test_added_tokens_are_the_library_s(spark, monkeypatch):
    from framewright.llm import catalog

    texts = ["one <|endoftext|> two", "One.<|endoftext|>Two, <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>, <|endoftext|", "Id49407 ID49407 é<|startoftext|>\u0301x. y", "<|endoftext|>", "it<|endoftext|>'s", "plain Text.", None]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    assert ids[0] == [637, 49407, 1237, 2]
    monkeypatch.setattr(catalog, "_documents", lambda *_: docs(spark, rows))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in catalog.op4_huffman_ids(spark, "").collect()}
    assert got == {i: (sum(map(len, ids[:i])), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}


# --- Language model ---------------------------------------------------------------------------------------


def test_language_model(spark, sf):
    rows = ODD + [(r["doc_id"] + 1000, r["text"], "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + [""] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    one, two, three = collections.Counter(), {}, {}
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            p = [None, None, *t]
            for a, b, c in zip(p, p[1:], t, strict=False):
                two.setdefault(b, collections.Counter())[c] += 1
                three.setdefault((a, b), collections.Counter())[c] += 1
    n, v = sum(one.values()), len(one)

    def score(t):
        total, p = 0.0, [None, None, *t]
        for a, b, c in zip(p, p[1:], t, strict=False):
            q = (one[c] + 1) / (n + v + 1)
            for found in (two.get(b), three.get((a, b))):
                if found:
                    m = sum(found.values())
                    q = max(found[c] - 0.75, 0) / m + 0.75 * len(found) / m * q
            total += math.log10(q)
        return total

    got = collections.defaultdict(list)
    for r in ngramlm.scored(docs(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    for r, t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        fit = [g for g in got[r[0]] if g["n_tokens"] == len(t) and math.isclose(g["base_score"], base, rel_tol=1e-9)]
        assert fit and fit[0]["held_out"] == h and fit[0]["n_known"] == sum(one[w] > 0 for w in t) and fit[0]["train_tokens"] == n
        assert abs(fit[0]["score"] - score(t)) < 0.03 * len(t) + 0.01
    assert sum(map(len, got.values())) == len(rows) and ngramlm.scored(empty(spark)).count() == 0
    only = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    lone = ngramlm.scored(docs(spark, [(only, "a b", "s")])).first()
    assert lone["train_tokens"] == 0 and math.isclose(lone["score"], 0.0, abs_tol=1e-6)


def test_shards_grow_with_the_texts(spark, sf, monkeypatch):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert wb.sizes_for(frame) == wb.sizes_for(empty(spark)) == (cores, cores)
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = by(bytebpe.digests(frame, ranks, public_tokenizers.PATTERN), "doc_id")
    total = sum(len(r["text"].encode()) for r in frame.filter("text is not null").collect())
    monkeypatch.setattr(wb, "SHARD_BYTES", total // 20)
    monkeypatch.setattr(wb, "TASK_BYTES", total // 40)
    shards, tasks = wb.sizes_for(frame)
    assert 20 <= shards <= 22 and 40 <= tasks <= 42
    assert by(bytebpe.digests(frame, ranks, public_tokenizers.PATTERN), "doc_id") == want
    monkeypatch.setattr(wb, "MOST_SHARDS", 3)
    assert wb.sizes_for(frame) == (3, tasks)


@pytest.mark.parametrize("most", [3, 40])
def test_hot_words_are_cut_again(spark, sf, monkeypatch, most):
    rows = ODD + [(i, "the the the " * (i % 4) + f"of the w{i % 9} the of", "s") for i in range(100, 160)] + [(r["doc_id"] + 1000, r["text"], "s") for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    frame = docs(spark, rows)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["n_tokens"], r["base_score"])
    want = sorted(ngramlm.scored(frame).collect(), key=key)
    monkeypatch.setattr(ngramlm, "HOT_PLACES", most, raising=False)
    met, sent = wb.met, []
    monkeypatch.setattr(wb, "met", lambda *a: sent.append(met(*a)) or sent[-1])
    got = sorted(ngramlm.scored(frame).collect(), key=key)
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6] and abs(a["score"] - b["score"]) < 0.05 * a["n_tokens"] + 0.01
    # Training places that meet in a task: after one word, or in the second cut after one pair of words.
    one, two = collections.Counter(), collections.Counter()
    for r in sent[-1].filter("shard >= 0").collect():
        _, v, u, _, _, train = wb.unpack(bytes(r["payload"]))
        for x in zip([r["shard"]] * len(v), v[train > 0].tolist(), u[train > 0].tolist(), strict=False):
            one[x[:2]] += 1
            two[x] += 1
    top = max(s for s, _ in one) // 2 + 1
    assert all(n <= most for x, n in two.items()) and all(n <= most or s >= top for (s, _), n in one.items())


def test_words_of_held_out_texts_only_are_cut_too(spark, monkeypatch):
    held = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:60]
    rest = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    frame = docs(spark, [(i, f"only w{i} only x{i % 3} only only", "s") for i in held] + [(i, f"a{i % 5} b c", "s") for i in rest])
    met, sent = wb.met, []
    monkeypatch.setattr(wb, "met", lambda *a: sent.append(met(*a)) or sent[-1])
    monkeypatch.setattr(ngramlm, "HOT_SHARE", 1)
    want = by(ngramlm.scored(frame), "doc_id")
    assert len(sent) == 1  # nothing is over a whole table's places
    monkeypatch.setattr(ngramlm, "HOT_PLACES", 20)
    sent.clear()
    got = by(ngramlm.scored(frame), "doc_id")
    assert len(sent) == 3  # words, pairs of words, and the places
    parts = wb.sizes_for(frame)[1]
    one, two = collections.Counter(), collections.Counter()
    for r in sent[-1].filter("shard >= 0").collect():
        _, v, u, _, _, train = wb.unpack(bytes(r["payload"]))
        for x in zip([r["shard"]] * len(v), v.tolist(), u.tolist(), strict=True):
            one[x[:2]] += 1
            two[x] += 1
    assert all(n <= 20 for (s, _), n in one.items() if s < parts) and all(n <= 20 for n in two.values())
    assert set(got) == set(want)
    for i, (a,) in got.items():
        want_of = want[i][0]
        assert a[:6] == want_of[:6] and abs(a["score"] - want_of["score"]) < 0.05 * a["n_tokens"] + 0.01


def test_each_size_takes_the_cut(spark, sf, monkeypatch):
    """The bound follows the table's places, so a small table has hot words as a large one has; scores hardly move."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    met, sent = wb.met, []
    monkeypatch.setattr(wb, "met", lambda *a: sent.append(met(*a)) or sent[-1])
    got = by(ngramlm.scored(frame), "doc_id")
    assert len(sent) >= 2
    sent.clear()
    monkeypatch.setattr(ngramlm, "HOT_SHARE", 1)
    want = by(ngramlm.scored(frame), "doc_id")
    assert len(sent) == 1
    far = [abs(a["score"] - want[i][0]["score"]) / a["n_tokens"] for i, (a,) in got.items()]
    assert len(far) == len(want) and max(far) < 0.05 and sum(far) / len(far) < 0.01


def test_placing_a_block_takes_few_bytes_a_place(spark, monkeypatch, tmp_path):
    """What a worker holds at most while it deals out a block's places, of which there are millions; hot ones in pieces."""
    words = np.random.default_rng(5).zipf(1.3, 600_000) % 20_000
    rows = [(i, " ".join(f"w{x}" for x in part), "s") for i, part in enumerate(np.split(words, 300))]
    met, folder = wb.met, str(tmp_path)

    def traced(blocks, answers, finish, schema, tasks):
        def measured(block, payloads):
            tracemalloc.start()
            try:
                return finish(block, payloads)
            finally:
                Path(folder, uuid.uuid4().hex).write_text(str(tracemalloc.get_traced_memory()[1] / len(block.codes)))
                tracemalloc.stop()

        return met(blocks, answers, measured, schema, tasks)

    monkeypatch.setattr(wb, "met", traced)
    monkeypatch.setattr(ngramlm, "PIECE", 20_000, raising=False)
    assert ngramlm.scored(docs(spark, rows).coalesce(1)).agg(F.sum("n_tokens")).first()[0] == 600_300
    taken = [float(x.read_text()) for x in tmp_path.iterdir()]
    assert len(taken) >= 2 and max(taken) < 90, taken


# --- Pipeline ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, frame, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, sf).write.parquet(str(folder / name))
        frame = spark.read.parquet(str(folder / name))
        out.append(frame)
    return out


def test_stages(spark, sf, stages):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    good, clean, single, mixed, ids = stages
    assert all(x.schema == given.schema for x in stages[:-1])
    assert 0 < good.count() < given.count() and clean.count() == good.count()
    plain = {r["doc_id"]: r["text"] for r in good.collect()}
    lines = {s: collections.Counter(x.strip(" ") for r in rows for x in set(r["text"].split("\n"))) for s, rows in by(good, "source").items()}
    pages = {s: len(rows) for s, rows in by(good, "source").items()}
    for r in clean.collect():
        over = lambda x, s=r["source"]: x.strip(" ") and lines[s][x.strip(" ")] >= linededup.MIN_PAGES and lines[s][x.strip(" ")] > linededup.RATIO * pages[s]
        assert r["text"] == "\n".join(x for x in plain[r["doc_id"]].split("\n") if not over(x)) and r["n_chars"] == len(r["text"])
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    links = against_all_pairs(rows, forest.near_texts(clean).collect())
    least = roots({i for i, _ in rows}, links)
    assert {r["doc_id"] for r in single.collect()} == set(least.values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(single).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    e, texts = library(), {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert ids.count() == mixed.count() and all(r["ids"] == e.encode_ordinary(texts[r["doc_id"]]) for r in ids.collect())


def by(frame, column):
    out = collections.defaultdict(list)
    for r in frame.collect():
        out[r[column]].append(r)
    return out


def test_run(spark, sf, stages):
    key = lambda r: (r["doc_id"], r["ids"])
    assert sorted(corpus_pipeline.run(spark, sf).collect(), key=key) == sorted(stages[-1].collect(), key=key)
