"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A document's expected number of copies varies within its source, the shorter documents being
likelier, since they steer a word total more finely; the size-weighted mean of the expected copies
is exactly target / source size. Whole copies of the expectation are certain. For the fraction p that
is left, a document draws a fixed uniform u from a hash of its id and text, and ranks by the Pareto
variable (u / (1 - u)) / (p / (1 - p)). From the smallest on, documents are taken while their words
fit into what the certain copies leave of the target: the sample's size is fixed, in words. The gap before
the first document that doesn't fit is filled in the same order with documents that are no larger than it.

No source is ever sorted as a whole. A rank is a place in 0 .. 2^52; places go into 2^BIN_BITS bins, words are summed by
(source, bin), and only the bin in which the target falls, one document in 2^BIN_BITS or so, is ordered. The decision
then is a comparison with a row per source, so that no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.names import col, packed, unpacked
from framewright.llm.store import stored

#: What stands between words.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Bits of a document's place by rank, and of a bin's.
PLACE_BITS, BIN_BITS = 52, 14
#: A document of so many words is half as short as an empty one.
TYPICAL_WORDS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, size): per source its size, number of documents and target in words.

    Sources take the weights in turn by code point, null last, and share all words. A target stops at
    ``max_copies`` times its source's size; the excess goes to the others by weight. That is
    water-filling: the sources that fill first come first in the order of capacity over weight.
    One row per source is left when the windows without partition run.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(_shortness() * F.col("size")).alias("short_words"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("capacity", F.col("source_size") * max_copies)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("capacity") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    per = per.withColumns({
        "words": F.sum("source_size").over(everything),
        "weights": F.sum("weight").over(everything),
        "full_words": F.coalesce(F.sum("capacity").over(before), zero),
        "full_weights": F.coalesce(F.sum("weight").over(before), zero),
    })
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    full = exact("capacity") * (F.col("weights") - F.col("full_weights")) <= (F.col("words") - F.col("full_words")) * exact("weight")
    per = per.withColumn("full", full)
    per = per.withColumns({
        "rest_words": F.col("words") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(zero)).over(everything),
        "rest_weights": F.col("weights") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(zero)).over(everything),
    })
    share = (F.col("weight").cast("double") * F.col("rest_words").cast("double")) / F.col("rest_weights").cast("double")
    target = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(share)
    mean = F.when(F.col("source_size") > 0, F.col("short_words") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "weight", target.alias("target"), mean.alias("mean_shortness"))


def _draw(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _shortness() -> Column:
    """1 to 1000, the larger the shorter a document is. Whole, so that sums are exact."""
    return F.ceil(1000 * TYPICAL_WORDS / (TYPICAL_WORDS + F.col("size"))).cast("long")


def _expected() -> Column:
    """Expected copies, from 0 to the most allowed."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    room = F.least(ratio, F.lit(float(MAX_COPIES)) - ratio) * 0.5
    tilt = (_shortness() - F.col("mean_shortness")) / 1000.0
    return F.greatest(F.lit(0.0), F.least(F.lit(float(MAX_COPIES)), ratio + room * tilt))


def _ranked(df: DataFrame) -> DataFrame:
    """Adds certain copies and the place by Pareto rank (null without a fraction) to rows (size, draw and their source's row)."""
    u = (F.pmod(F.col("draw"), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    df = df.withColumn("expected", _expected()).withColumn("certain", F.floor("expected").cast("long"))
    part = F.col("expected") - F.col("certain")
    # Of odds u / (1 - u) over odds p / (1 - p): their share of themselves and 1.
    above, below = u * (1.0 - part), (1.0 - u) * part
    place = F.floor(above / (above + below) * float(1 << PLACE_BITS)).cast("long")
    return df.withColumn("place", F.when((part > 0) & (F.col("size") > 0), place)).drop("expected")


def _beside(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with their source's row of ``plan``."""
    return rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")), how).drop("plan_source")


#: What a document needs to know of its source.
_OF = ("source", "source_size", "target", "mean_shortness")


def sampling_plan(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``sizes`` (source, size, draw and others): the ranked rows, and the cuts of each source that has any."""
    ranked = stored(_ranked(_beside(sizes, source_targets(sizes).drop("weight"))), "ranked")
    cut = stored(_cut(ranked, F.col("target"), 1.0, "cut"), "cut")
    left = _beside(ranked.filter("place is not null"), cut.select("source", "gap", "cut_place", "cut_draw")).filter(~_before("cut") & (F.col("size") <= F.col("gap")))
    fill = _cut(left.withColumn("certain", F.lit(0)), F.col("gap"), 0.5, "fill", "gap")
    fill = fill.select(F.col("source").alias("fill_source"), "fill_place", "fill_draw")
    plan = cut.join(fill, F.col("source").eqNullSafe(F.col("fill_source")), "left").select("source", "gap", "cut_place", "cut_draw", "fill_place", "fill_draw")
    return ranked, stored(plan, "plan")


def _before(which: str) -> Column:
    """Whether a document stands before a cut of its source, or at it."""
    place, draw = F.col(which + "_place"), F.col(which + "_draw")
    return F.coalesce((F.col("place") < place) | ((F.col("place") == place) & (F.col("draw") <= draw)), F.lit(False))


def _cut(rows: DataFrame, budget: Column, part: float, name: str, *more: str) -> DataFrame:
    """source, and ``name`` _place and _draw: to where documents fit into what certain copies leave of the ``budget``; gap: what is left then.

    A document fits if this ``part`` of it does. Rows of equal place and draw are taken together. Sources without a
    document that has a place have no row.
    """
    of, shift = [*_OF, *more], PLACE_BITS - BIN_BITS
    every, along = Window.partitionBy("source"), Window.partitionBy("source").orderBy("bin")
    sums = rows.groupBy(*of, F.shiftright("place", shift).alias("bin")).agg(F.sum(F.when(F.col("place").isNotNull(), F.col("size"))).alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"))
    sums = sums.select("source", "bin", "words", (budget - F.sum("sure").over(every)).alias("rest"), F.sum("words").over(along).alias("up_to")).filter("bin is not null")
    here = F.struct("bin", (F.col("up_to") - F.col("words")).alias("ahead"))
    # Where everything fits, the last bin is the one that is ordered.
    at = sums.groupBy("source", "rest").agg(F.coalesce(F.min(F.when(F.col("up_to") > F.col("rest"), here)), F.max(here)).alias("at"))
    at = at.select("source", "rest", "at.*")
    inside = _beside(rows.select("source", "size", "place", "draw"), at).filter(F.shiftright("place", shift) == F.col("bin"))
    tied = inside.groupBy("source", "place", "draw", "rest", "bin", "ahead").agg(F.sum("size").alias("words"))
    tied = tied.withColumn("up_to", F.col("ahead") + F.sum("words").over(Window.partitionBy("source").orderBy("place", "draw")))
    fits = F.col("up_to") - F.col("words") * (1.0 - part) <= F.col("rest")
    last = tied.groupBy("source", "rest", "bin", "ahead").agg(F.max(F.when(fits, F.struct("place", "draw", "up_to"))).alias("last"))
    place = F.coalesce("last.place", F.shiftleft("bin", shift))
    return last.select("source", place.alias(name + "_place"), F.col("last.draw").alias(name + "_draw"), (F.col("rest") - F.coalesce("last.up_to", "ahead")).alias("gap"))


def _copies() -> Column:
    filler = F.coalesce(F.col("size") <= F.col("gap"), F.lit(False)) & _before("fill")
    return F.col("certain") + (_before("cut") | filler).cast("long")


def _sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(col(doc_id).alias("doc_id"), col(source).alias("source"), word_count(col(text)).alias("size"), _draw(col(doc_id), col(text)).alias("draw"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: doc_id, size, source_size, target, copies, taken (words).

    Null texts have no words; documents without words are taken by no draw, so their taken is 0. A null
    source is a source, a null id is an id as any other. Rows equal in id and text share one draw and
    so one fate, and no other rows tie but by a hash's chance; equal texts under other ids draw apart. A text of any
    length is counted whole and is taken whole or not at all. An empty table gives an empty result. Other columns are
    not read.
    """
    ranked, plan = sampling_plan(stored(_sizes(docs, doc_id, text, source), "sizes"))
    rows = _beside(ranked, plan, "left").withColumn("copies", _copies())
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each row as often as it is taken. Same columns as ``docs``, whatever their names.

    A first pass reads ids and sizes; the second compares each document with its source's row. Only
    the plan, a row per source, is joined. Nulls, ties and empty tables are as in ``mixture``.
    """
    ranked, plan = sampling_plan(stored(_sizes(docs, doc_id, text, source), "sizes"))
    # Stored, so that Spark knows that it is small and no text is shuffled.
    plan = stored(_beside(ranked.select(*_OF).distinct(), plan, "left"), "plan")
    rows = docs.select(packed(docs).alias("row"), word_count(col(text)).alias("size"), _draw(col(doc_id), col(text)).alias("draw"), col(source).alias("source"))
    taken = _ranked(_beside(rows, plan)).select("row", _copies().alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*unpacked("row", docs.columns))
