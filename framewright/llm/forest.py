"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its word 5-shingles (words stand between blanks; a text of fewer words is one shingle).
Its MinHash signature is cut into TREES labels of DEPTH values; each tree is a prefix trie over the labels, and two
documents match in a tree to a depth if their labels share that long a prefix. All tries are one sorted table of
labels: a node of depth d is a run of labels with one prefix, and a label that shares none with its neighbours leaves.

A pair of similarity s matches to depth d with probability 1 - (1 - s^d)^TREES. Prefixes are shortened from the whole
label until a pair right at the threshold matches with the target recall, whatever else the table holds. They are
shortened by one more wherever the node stays small, tree by tree: that costs little and finds more. In a node, members
whose signatures come near the threshold link into clusters. In a cluster every two documents' whole shingle sets are
compared exactly, unless their numbers of shingles alone rule a link out.

Equal texts count as one with a weight. Nodes and clusters are compared in bounded blocks (see groups), from which
a row per member leaves, not a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.components import components
from framewright.llm.groups import chunk_of, compare_blocks, near_edges, neighbours, paired, roots_of
from framewright.llm.names import col, packed, unpacked
from framewright.llm.store import stored

#: Words of a shingle; pairs of this Jaccard similarity or more are links; share of them that has to be found.
WORDS, JACCARD, RECALL = 5, 0.8, 0.9995
TREES, DEPTH = 24, 6
#: A signature's estimate has a standard deviation of sqrt(J (1 - J) / (TREES * DEPTH)); pairs so many below the threshold are looked at.
DEVIATIONS = 4
#: Nodes of so many members are taken with a shorter prefix than the recall needs.
SMALL_NODE = 64
#: Documents of a chunk in a cluster: the larger, the more shingle sets a task holds.
CLUSTER_CHUNK = 128
#: Up to so many ids (8 bytes each) are sent to every executor to pick rows; beyond, the join shuffles.
BROADCAST_IDS = 2_000_000
MEMO = 200_000
_RNG = np.random.default_rng(5489)
_FACTORS = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_STEPS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def shingles(texts: list[bytes], hashes: dict[bytes, int], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, text after text, repeats kept; the texts' bounds in them."""
    found = [t.split() for t in texts]
    n = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((hashes[w] for ws in found for w in ws), np.uint64, int(n.sum()))
    counts = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.cumsum(n) - n
    out = np.zeros(int(bounds[-1]), np.uint64)
    # First words of the shingles of texts that are long enough, then the short texts one by one.
    long = n >= words
    first = np.repeat(starts[long] - (np.cumsum(counts[long]) - counts[long]), counts[long]) + np.arange(int(counts[long].sum()))
    place = np.repeat(long, counts)
    total = np.zeros(len(first), np.uint64)
    for i in range(words):
        total += flat[first + i] * _STEPS[i]
    out[place] = total
    for i in np.flatnonzero(~long & (n > 0)).tolist():
        own = flat[starts[i] : starts[i] + n[i]]
        out[bounds[i]] = (own * _STEPS[: n[i]]).sum(dtype=np.uint64) + np.uint64(n[i])
    return _mix(out), bounds


def signatures(hashed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of the least value of each hash function, a row per text. All texts must have shingles."""
    x = (hashed ^ (hashed >> np.uint64(32))).astype(np.uint32)
    out = np.empty((TREES * DEPTH, len(bounds) - 1), np.uint16)
    for i in range(TREES * DEPTH):
        out[i] = np.minimum.reduceat(x * _FACTORS[i] + _TERMS[i], bounds[:-1]).astype(np.uint16)
    return out.T


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h1 and h2 (a 128-bit hash of the text), signature (null without shingles)."""
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("h1"), F.xxhash64(F.lit(1), col(text)).alias("h2"), col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashed, bounds = shingles([t.as_py() or b"" for t in part.column("text").cast(pa.binary())], hashes)
                some = np.diff(bounds) > 0
                rows: list[bytes | None] = [None] * part.num_rows
                if some.any():
                    found = signatures(hashed, np.concatenate([bounds[:-1][some], bounds[-1:]]))
                    for i, s in zip(np.flatnonzero(some).tolist(), found, strict=True):
                        rows[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(rows, pa.binary())], names=["doc_id", "h1", "h2", "signature"])

    return rows.mapInArrow(sign, "doc_id long, h1 long, h2 long, signature binary")


def found_at(similarity: float, depth: int) -> float:
    """Probability that a pair matches to this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(jaccard: float = JACCARD, recall: float = RECALL) -> int:
    """How long prefixes may be for pairs right at ``jaccard`` to match with probability ``recall``: shortened from the whole label."""
    for depth in range(DEPTH, 0, -1):
        if found_at(jaccard, depth) >= recall:
            return depth
    raise ValueError(f"{TREES} trees can't reach a recall of {recall} at a similarity of {jaccard}")


def least_estimate(jaccard: float) -> float:
    """Signatures that agree in this share may belong to a pair of ``jaccard``: DEVIATIONS standard deviations below it."""
    return max(0.0, jaccard - DEVIATIONS * math.sqrt(jaccard * (1 - jaccard) / (TREES * DEPTH)))


def candidate_edges(reps: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """Edges (a, b) over reps (rep, signature) that hold near pairs together."""
    depth = prefix_depth(jaccard, recall)
    short = max(1, depth - 1)
    # A label is the tree's number and DEPTH values of 2 bytes: sorted, the labels are the tries one after another.
    labels = [F.concat(F.lit(bytes([t])), F.expr(f"substring(signature, {2 * DEPTH * t + 1}, {2 * DEPTH})")) for t in range(TREES)]
    entries = reps.select("rep", F.explode(F.array(*labels)).alias("label"))
    prefix = lambda d: F.xxhash64(F.substring("label", 1, 1 + 2 * d))
    matched = neighbours(entries, "label", "rep", 1 + 2 * short).select("rep", prefix(short).alias("short"), prefix(depth).alias("long"))
    matched = stored(matched, "prefixes")
    sizes = matched.groupBy("short").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("short", "of")
    members = matched.join(sizes, F.col("short") == F.col("of")).select("rep", F.when(F.col("n") <= SMALL_NODE, F.col("short")).otherwise(F.col("long")).alias("node"))
    least = math.ceil(least_estimate(jaccard) * TREES * DEPTH - 1e-9)
    near = lambda x, y: np.count_nonzero(x == y, axis=-1) >= least
    return near_edges(members, reps.select(F.col("rep").alias("id"), F.col("signature").alias("code")), near, np.uint16, TREES * DEPTH)


def _verify(table: pa.Table, bounds: np.ndarray, jaccard: float) -> pa.Table:
    """Exact similarities in blocks of a cluster: links by weight, and each member's least linked id."""
    rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
    links, roots = np.zeros(len(rep), np.int64), rep.copy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        common = _common(sets[a:b], sizes[a:b])
        linked = common >= jaccard * (sizes[a:b, None] + sizes[None, a:b] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if side[a:b].any():
            linked &= side[a:b, None] != side[None, a:b]
        if n and linked.any():
            links[a:b] = (linked * copies[a:b][None, :]).sum(axis=1)
            roots[a:b] = roots_of(rep[a:b], linked)
    some = links > 0
    return pa.table({"rep": rep[some], "links": links[some], "root": roots[some]})


def _common(sets: list[np.ndarray], sizes: np.ndarray, columns: int = 16384) -> np.ndarray:
    """How many shingles each two sets share."""
    n = len(sets)
    out = np.zeros((n, n))
    if n == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    keep = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [start, start + columns])
        has = np.zeros((n, columns), np.float32)
        has[owner[i:j], column[i:j] - start] = 1
        out += has @ has.T
    return out


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """rep, shingles (sorted, distinct, 8 bytes each), n (their number) of rows (rep, text, ...); the other columns pass."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                hashed, bounds = shingles([t.as_py() for t in part.column("text").cast(pa.binary())], hashes, words)
                sets = [np.unique(hashed[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = pa.array([len(x) // 8 for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), pa.array(sets, pa.binary()), n], names=[*(f.name for f in others), "shingles", "n"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others) + ", shingles binary, n long"
    return docs.mapInArrow(cut, schema)


def _cluster_blocks(sets: DataFrame, jaccard: float) -> DataFrame:
    """Rows (rep, copies, component, size, shingles, n) in blocks.

    The members of a cluster of more than a chunk stand in bands by their number of shingles, each 1 / jaccard times as
    wide as the one before: a link never leaves a band for another than the next, so only these are compared.
    """
    step = -math.log(jaccard) + 1e-9 if jaccard < 1 else 1e-9
    rows = sets.withColumn("band", F.when(F.col("size") > CLUSTER_CHUNK, F.floor(F.log("n") / step)).otherwise(F.lit(0)).cast("long"))
    along = Window.partitionBy("c").orderBy("b")
    held = rows.groupBy(F.col("component").alias("c"), F.col("band").alias("b")).agg(F.ceil(F.count(F.lit(1)) / CLUSTER_CHUNK).cast("long").alias("chunks"))
    beside = lambda f, by: F.when(f("b", 1).over(along) == F.col("b") + by, f("chunks", 1).over(along)).otherwise(F.lit(0).cast("long"))
    held = held.withColumns({"below": beside(F.lag, -1), "above": beside(F.lead, 1)})
    # Chunk i of a band is number band * 2^32 + i.
    first = lambda band: F.shiftleft(band, 32)
    some = lambda band, n: F.when(n > 0, F.sequence(first(band), first(band) + F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<long>"))
    rows = rows.join(held, (F.col("component") == F.col("c")) & (F.col("band") == F.col("b")))
    others = F.concat(some(F.col("band") - 1, F.col("below")), some(F.col("band"), F.col("chunks")), some(F.col("band") + 1, F.col("above")))
    own = first(F.col("band")) + chunk_of(F.col("rep"), F.col("chunks"))
    return paired(rows, "component", own, others).select("block_key", "side", "rep", "copies", "shingles")


def _classified(docs: DataFrame, doc_id: str, text: str, jaccard: float, recall: float) -> DataFrame:
    """A row per document: doc_id, h1, h2, usable (has an id and shingles), links, class, copies (these null if not usable)."""
    rows = stored(signed(docs, doc_id, text), "signatures")
    usable = F.col("doc_id").isNotNull() & F.col("signature").isNotNull()
    # A text is known by 128 bits of hash; 64 of them name it in the graph, where two texts of one name would be one node.
    reps = rows.filter(usable).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    reps = stored(reps.withColumn("rep", F.col("h1")), "texts")
    clusters = stored(components(candidate_edges(reps, jaccard, recall)), "clusters")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("component", "c")
    clustered = clusters.join(sizes, F.col("component") == F.col("c")).drop("c").join(reps.drop("signature"), F.col("node") == F.col("rep"))
    clustered = stored(clustered.select("rep", "least", "copies", "h1", "h2", "component", "size"), "clustered")
    # 8 bytes an id; beyond the bound the join shuffles.
    ids = clustered.select(F.col("least").alias("picked"))
    ids = F.broadcast(ids) if clustered.count() <= BROADCAST_IDS else ids
    own = docs.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"))
    own = own.join(ids, F.col("id") == F.col("picked"), "left_semi").select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    same = (F.col("id") == F.col("least")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
    texts = own.dropDuplicates(["id", "t1", "t2"]).join(clustered, same)
    sets = stored(_shingle_sets(texts.select("rep", "copies", "component", "size", "text"), WORDS), "shingles")
    found = stored(compare_blocks(_cluster_blocks(sets, jaccard), lambda t, b: _verify(t, b, jaccard), "rep long, links long, root long"), "links")
    links = found.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    ids = classes.join(clustered.select("rep", "least"), F.col("node") == F.col("rep")).select("node", "component", "least")
    ids = ids.join(ids.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("class")), F.col("component") == F.col("c")).select("node", "class")
    per = reps.select("h1", "h2", "rep", "least", "copies").join(links, F.col("rep") == F.col("r"), "left").join(ids, F.col("rep") == F.col("node"), "left")
    per = per.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("class", "least").alias("class"))
    named = rows.select("doc_id", "h1", "h2", usable.alias("usable"))
    return named.join(per, F.col("usable") & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left").drop("t1", "t2")


def near_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """A row per document: doc_id, n_links, class_id, copies (equal texts, itself included), kept.

    n_links counts the other documents of similarity ``jaccard`` or more, equal texts among them; class_id is the
    least id reachable over links; kept: doc_id is its class_id. Null texts and texts without words have no
    shingles and link with nothing. Ids are whole numbers that name documents (others are an error). Rows of one id
    and different texts are linked text by text, repeated rows are copies. A row with a null id links with nothing, its
    class is null and it is kept. A similarity of exactly ``jaccard`` is a link. A long text is one document, whose
    shingles one task holds at once (8 bytes a word). An empty table gives an empty result; other columns aren't read.
    """
    out = _classified(docs, doc_id, text, jaccard, recall)
    own = F.coalesce("class", "doc_id")
    return out.select("doc_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class: its least id and, of that id's texts in the class, the one of the least hash.

    Of repeated rows (equal id and text) one stays. Rows with a null id or without words are in no class and all stay.
    A text is judged by itself: if another text of its id goes, it stays. Columns may have any names.
    """
    rows = stored(_classified(docs, doc_id, text, jaccard, recall).filter("usable").select("doc_id", "h1", "h2", "links", "class"), "classes")
    linked = rows.filter("links > 0")
    # Of the texts that bear the class's own id, mostly one.
    least = linked.filter("doc_id = class").select("doc_id", F.struct("h1", "h2").alias("text")).distinct()
    first = least.groupBy(F.col("doc_id").alias("of")).agg(F.min("text").alias("first"))
    later = least.join(first, F.col("doc_id") == F.col("of")).filter(F.col("text") != F.col("first")).select("doc_id", "text.*")
    gone = stored(linked.filter("doc_id <> class").select("doc_id", "h1", "h2").unionByName(later).distinct(), "gone")
    twice = stored(rows.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").join(gone, ["doc_id", "h1", "h2"], "left_anti"), "repeated")
    packed_rows = docs.select(packed(docs).alias("row"), col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("t1"), F.xxhash64(F.lit(1), col(text)).alias("t2"))

    def split(keys: DataFrame, how: str, of: DataFrame) -> DataFrame:
        small = keys.count() <= BROADCAST_IDS // 3  # 24 bytes a key
        same = (of["id"] == keys["doc_id"]) & (of["t1"] == keys["h1"]) & (of["t2"] == keys["h2"])
        return of.join(F.broadcast(keys) if small else keys, same, how)

    left = split(gone, "left_anti", packed_rows)
    if twice.limit(1).count():
        left = split(twice, "left_anti", left).unionByName(split(twice, "left_semi", left).dropDuplicates(["id", "t1", "t2"]))
    return left.select(*unpacked("row", docs.columns))
