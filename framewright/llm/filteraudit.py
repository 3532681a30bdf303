"""How filters overlap, whatever order they run in: path counting over the lattice of filter subsets.

A document's failures are bits. A state of the lattice is the set of filters that have run; an edge adds one filter, and
what it removes is what fails it and none of the state's. Paths from no filter to all of them are the orders. Forward
counts say how many orders reach a state, backward counts how many leave it for the end, so their product over an edge is
the number of orders that take it: weighted by it, an edge's removals add up to the filter's Shapley total over all orders.
The same edges, read along one path, are that order's steps. Nothing is run a second time for any order.

Documents become a histogram of bits a part, so the lattice meets (parts x 2^filters) rows, never documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.names import col

WORD = r"[^\x20\x09-\x0D]+"
#: Most filters of an audit: its orders are a table of factorial length.
MOST_FILTERS = 7
# The filters of the query, by letter, and their limits.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def own_failures(text: Column) -> Column:
    """Bits of A (few words, 1), B (few distinct words, 2), C (many capitals, 4) and D (a symbol, 8) of a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    bit = lambda at, fails: F.when(fails, F.lit(1 << at)).otherwise(F.lit(0))
    return (
        bit(0, n < LEAST_WORDS)
        + bit(1, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n)
        + bit(2, 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"))
        + bit(3, text.rlike(r"[#$%&*|]"))
    ).cast("int")


def failures(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """part, bits (A to D as ``own_failures``, E 16: equal to a smaller id's text), good, toxic, n: how many documents there are of each.

    A null text is an empty one, a null part an empty string. Rows without an id are no smaller than any and fail E never; of
    repeated rows of the smallest id none fails it. A document is good or toxic if any of its labels says so; without labels
    neither. Texts don't travel: a row is an id, a digest and bits; copies of a text are added up before they meet.
    """
    body = F.coalesce(col(text), F.lit(""))
    slim = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(lang), F.lit("")).alias("part"), own_failures(body).alias("own"), F.unhex(F.sha2(body, 256)).alias("print"))
    rows = slim.groupBy("doc_id", "print", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("of")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(marks, rows["doc_id"] == marks["of"], "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")})
    has_id = F.col("doc_id").isNotNull()
    # Copies in one part, with one label: how many, how many without an id, and the smallest id with its rows.
    copies = rows.groupBy("print", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("n_free"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("print"))
    clear = F.col("n_free") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    both = copies.withColumn("clear", clear).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("bits"), F.col("clear").alias("n")), F.struct((F.col("own") + 16).alias("bits"), (F.col("n") - F.col("clear")).alias("n")))).alias("x"))
    return both.groupBy("part", F.col("x.bits").alias("bits"), "good", "toxic").agg(F.sum("x.n").alias("n")).filter("n > 0")


def path_counts(n: int, before: frozenset[tuple[int, int]] = frozenset()) -> tuple[list[int], list[int]]:
    """For each state: the orders that reach it, and those that go on from it to the end. ``before`` has pairs (a, b): a runs ahead of b."""
    reach, leave = [0] * (1 << n), [0] * (1 << n)
    reach[0] = leave[-1] = 1
    for state in range(1 << n):
        for f in _open(state, n, before):
            reach[state | 1 << f] += reach[state]
    for state in reversed(range((1 << n) - 1)):
        leave[state] = sum(leave[state | 1 << f] for f in _open(state, n, before))
    return reach, leave


def _open(state: int, n: int, before: frozenset[tuple[int, int]]) -> list[int]:
    return [f for f in range(n) if not state >> f & 1 and all(state >> a & 1 for a, b in before if b == f)]


def orders(n: int, before: frozenset[tuple[int, int]] = frozenset()) -> Iterator[tuple[int, ...]]:
    """All admissible orders, as paths through the lattice."""

    def walk(state: int, path: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if len(path) == n:
            yield path
        for f in _open(state, n, before):
            yield from walk(state | 1 << f, (*path, f))

    return walk(0, ())


def edges(counted: DataFrame, n: int, before: frozenset[tuple[int, int]] = frozenset()) -> DataFrame:
    """part, state, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, ways (orders that take the edge), shapley.

    Every edge of the lattice that an order takes, for every part, zeros included.
    """
    reach, leave = path_counts(n, before)
    found = [(s, f, reach[s] * leave[s | 1 << f]) for s in range(1 << n) for f in _open(s, n, before) if reach[s] and leave[s | 1 << f]]
    flat = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("own"), F.lit(w).cast("long").alias("ways")) for s, f, w in found))
    rows = counted.select("part", "bits", "good", "toxic", "n", F.explode(flat).alias("e")).select("part", "bits", "good", "toxic", "n", "e.*")
    bits, state, own = F.col("bits"), F.col("state"), F.col("own")
    fails, seen = bits.bitwiseAND(own) != 0, bits.bitwiseAND(state) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    per = rows.groupBy("part", "state", "filter", "ways").agg(
        total(~fails & ~seen).alias("kept"), total(fails & ~seen).alias("removed"), total(fails & seen).alias("redundant"), total(bits == own).alias("unique_fails"),
        total(fails & ~seen & F.col("good")).alias("good_lost"), total(fails & ~seen & F.col("toxic")).alias("toxic_lost"),
    )
    return per.withColumn("shapley", F.sum(F.col("ways") * F.col("removed")).over(Window.partitionBy("part", "filter")))


def audit(counted: DataFrame, names: str, before: frozenset[tuple[int, int]] = frozenset()) -> DataFrame:
    """part, filter_order, step and the numbers of the step's edge, for every admissible order of the filters.

    ``counted`` has rows (part, bits, good, toxic, n); ``names`` one letter a filter, that of bit 0 first. Without documents
    there are no parts and no rows. ``shapley`` is the filter's removals summed over all admissible orders.
    """
    n = len(names)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters, not {n}")
    steps, letters = [], lambda path: "".join(names[f] for f in path)
    for path in orders(n, before):
        steps += [(letters(path), k + 1, f, sum(1 << g for g in path[:k])) for k, f in enumerate(path)]
    read = counted.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, state int")
    # At most 7 * 7! steps, so their size is known.
    found = edges(counted, n, before).join(F.broadcast(read), ["state", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``audit`` of the filters A to E over documents, by language."""
    return audit(failures(docs, labels, doc_id, text, lang), "ABCDE")
