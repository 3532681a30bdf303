"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are brought to length 1, where cosine s means the distance sqrt(2 - 2 s). In each of L tables k
Gaussian projections, shifted and quantised to cells of WIDTH, make a bucket. Vectors that share a bucket of any
table and whose signs of further projections are near are linked into clusters; in a cluster all vectors are compared
by cosine in double precision.

k follows from the number of vectors (unrelated ones should rarely share a bucket), L from k and the recall that
pairs at the threshold must have. Equal vectors count as one with a weight. Buckets hold ids and signs only: a vector
travels to its cluster, not to each of its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.components import components
from framewright.llm.groups import compare_blocks, in_blocks, near_edges, neighbours, roots_of
from framewright.llm.names import col
from framewright.llm.store import stored

#: Links have this cosine at least; the share of pairs right at it that must meet; width of a cell.
COSINE, RECALL, WIDTH = 0.98, 0.9999, 2.0
#: Unrelated vectors, on average, that a vector may share a bucket of one table with.
STRAY = 1 / 16
#: Bits of a vector's sign code; how many standard deviations apart codes of a pair at the threshold may be.
SIGNS, DEVIATIONS = 256, 5
SEED = 20240607


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that a projection puts two vectors at this distance in one cell."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def table_shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """k and L for groups of at most n vectors."""
    far = same_cell(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, n) / STRAY) / -math.log(far)))
    hit = same_cell(math.sqrt(2 - 2 * cosine)) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _hash(vectors: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 64-bit bucket of each vector in each table."""
    rng = np.random.default_rng((SEED, vectors.shape[1]))
    directions, shifts = rng.normal(size=(vectors.shape[1], tables * k)), rng.uniform(0, WIDTH, tables * k)
    weights = rng.integers(1, 2**63, tables * k, dtype=np.uint64) | np.uint64(1)
    cells = np.floor((vectors @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64)
    mixed = (cells * weights).reshape(len(vectors), tables, k).sum(axis=2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).astype(np.int64)


def _unit(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1 without overflow."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(units: np.ndarray) -> np.ndarray:
    """The signs of SIGNS projections as bits, in 64-bit numbers."""
    rng = np.random.default_rng((SEED + 1, units.shape[1]))
    return np.packbits(units @ rng.normal(size=(units.shape[1], SIGNS)) > 0, axis=1).view(np.uint64)


def most_apart(cosine: float) -> int:
    """Signs in which vectors of this cosine may differ: DEVIATIONS standard deviations above the mean."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.floor(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p)))


def _compare(table: pa.Table, bounds: np.ndarray, cosine: float) -> pa.Table:
    rep, copies, side = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
    links, roots = np.zeros(len(rep), np.int64), rep.copy()
    vectors = table.column("vector")
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x = _unit(vectors.slice(a, b - a))
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        if side[a:b].any():
            linked &= side[a:b, None] != side[None, a:b]
        if linked.any():
            links[a:b] = (linked * copies[a:b][None, :]).sum(axis=1)
            roots[a:b] = roots_of(rep[a:b], linked)
    some = links > 0
    return pa.table({"rep": rep[some], "links": links[some], "root": roots[some]})


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal lengths are compared. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing. Equal vectors link with each other, repeated rows too. A cosine
    of exactly ``cosine`` is a link. Ids are whole numbers that name vectors (others are an error): different vectors of
    one id are one node of a component. A row with a null id counts as linked with nothing and is kept, its component
    null. An empty table gives an empty result. Other columns aren't read.
    """
    rows = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(vector).alias("vector"), col(label).alias("label"))
    kind = rows.schema["vector"].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~odd & F.exists("vector", lambda x: x != 0)
    # A vector is known by 128 bits of hash, so that vectors are shuffled once and never compared as keys.
    prints = {"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "label", "vector"), "fit": F.coalesce(fit, F.lit(False))}
    rows = rows.withColumns(prints)
    reps = rows.filter("fit").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    reps = stored(reps, "vectors")
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = table_shape(largest, cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket of all tables: its number without the label, which is added below."""
        for batch in batches:
            for part in _of_one_length(batch):
                found = _hash(_unit(part.column("vector")), k, tables)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("own"), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * tables, pa.int32()), pa.array(found.ravel()))], names=["rep", "own", "buckets"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _of_one_length(batch):
                codes = [x.tobytes() for x in _signs(_unit(part.column("vector")))]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(codes, pa.binary())], names=["id", "code"])

    slim = reps.select("rep", F.xxhash64("label", F.size("vector")).alias("own"), "vector")
    entries = slim.mapInArrow(hashed, "rep long, own long, buckets array<long>").select("rep", "own", F.posexplode("buckets").alias("table", "bucket"))
    entries = entries.select(F.xxhash64("own", "table", "bucket").alias("node"), "rep")
    members = stored(neighbours(entries, "node", "rep"), "buckets")
    most = most_apart(cosine)
    near = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= most
    edges = near_edges(members, slim.select("rep", "vector").mapInArrow(signed, "id long, code binary"), near, np.uint64, SIGNS // 64)
    clusters = stored(components(edges), "clusters")
    sizes = clusters.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    # A cluster may hold several labels of one id, so its blocks are cut by label and length.
    clustered = clusters.join(sizes, F.col("component") == F.col("c")).join(reps.drop("h1", "h2"), F.col("node") == F.col("rep"))
    clustered = clustered.select("rep", "copies", "vector", F.xxhash64("component", "label", F.size("vector")).alias("group"), "size")
    blocks = in_blocks(clustered, "group", "size", F.col("rep")).select("block_key", "side", "rep", "copies", "vector")
    found = stored(compare_blocks(blocks, lambda t, b: _compare(t, b, cosine), "rep long, links long, root long"), "links")
    links = found.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links"))
    of = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = reps.select("h1", "h2", "rep", "copies").join(links, F.col("rep") == F.col("r"), "left").join(of, F.col("rep") == F.col("node"), "left")
    per = per.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    named = rows.select("vec_id", "h1", "h2", "fit")
    out = named.join(per, F.col("fit") & (F.col("h1") == F.col("v1")) & (F.col("h2") == F.col("v2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _of_one_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut by the length of its vectors."""
    sizes = np.array(batch.column("vector").value_lengths())
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n))
