"""Quality rules as a ledger: every rule is evaluated once a document, its failure is a bit, and its measurements stay.

Measuring is the only step that reads texts. A ledger row is an id, whole numbers and bits; policies are applied to the ledger. A policy
names the rules that reject and may give a rule another limit: bits under that limit follow from the measurements, so a
policy of any version can be tried, compared and reverted without the texts. Ablations (what would be kept without a rule,
what only it catches) are aggregates of bit patterns: a histogram of patterns a policy, from which all rules are read.

Bits are for ever: a new rule takes the next free bit, a withdrawn one leaves its bit unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.names import col
from framewright.llm.wordblocks import blank_split

#: Words of a window that counts as repeated if found twice in a text.
WINDOW = 8
SLICE_BYTES = 4 << 20
#: Measurements, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_bars", "n_echoes")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over measurements and ``{limit}``, a whole number, so that it is exact at any length."""

    bit: int
    fails: str
    limit: int


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of ``rules``; ``limits`` replaces those of some."""

    rules: tuple[str, ...]
    limits: dict[str, int] = field(default_factory=dict)

    def mask(self) -> int:
        return sum(1 << RULES[r].bit for r in self.rules)

    def bits(self) -> Column:
        """The ledger's bits under this policy's limits."""
        if not self.limits:
            return F.col("bits")
        fixed = sum(1 << RULES[r].bit for r in self.limits)
        return F.col("bits").bitwiseAND(F.lit(~fixed).cast("long")) + sum((_bit(RULES[r], limit) for r, limit in self.limits.items()), F.lit(0).cast("long"))


RULES = {
    "few_words": Rule(0, "n_words < {limit}", 20),
    "repeats": Rule(1, "100 * n_repeat_words > {limit} * n_words", 30),
    "symbols": Rule(2, "100 * n_symbols > {limit} * n_words", 20),
    "repeated_lines": Rule(3, "100 * n_dup_lines > {limit} * n_lines", 40),
    "capitals": Rule(4, "100 * n_upper > {limit} * word_chars", 25),
    "shouts": Rule(5, "100 * n_shouts > {limit} * n_words", 10),
    "bars": Rule(6, "100 * n_bars > {limit} * n_words", 10),
    "echoes": Rule(7, "100 * n_echoes > {limit} * n_words", 30),
}
#: Rules that every policy of the query has, whatever else it says.
BASE = ("few_words", "repeats")
POLICIES = {
    "v1": Policy(("few_words", "repeats", "symbols", "repeated_lines")),
    "v2": Policy(tuple(RULES)),
    "v3": Policy(tuple(RULES), {"repeats": 20, "symbols": 10}),
}
CURRENT = "v2"


def _bit(rule: Rule, limit: int | None = None) -> Column:
    return F.when(F.expr(rule.fails.format(limit=int(rule.limit if limit is None else limit))), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_SYMBOLS, _UPPER, _SHOUT, _BAR = _table(b"#*$%&|<>"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), b"!!", b"|"


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values each."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts, dtype=np.int64)
    return total[ends] - total[ends - counts]


def _codes(values: pa.Array) -> np.ndarray:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: words in windows of WINDOW words that stand in it more than once, the first included.

    Windows are compared by numbers of their halves, of these halves' halves and so on, so equality is exact.
    """
    n = len(codes)
    owner = np.repeat(np.arange(len(counts)), counts)
    if n < WINDOW:
        return np.zeros(len(counts), np.int64)
    ids, width = codes, 1
    while width < WINDOW:
        joined = ids[:-width] * (int(ids.max(initial=0)) + 1) + ids[width:]
        ids, width = np.unique(joined, return_inverse=True)[1].astype(np.int64), 2 * width
    at = np.flatnonzero(owner[: len(ids)] == owner[WINDOW - 1 :])
    _, of, seen = np.unique(owner[at] * (int(ids.max(initial=0)) + 1) + ids[at], return_inverse=True, return_counts=True)
    starts = at[seen[of] > 1]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, counts)


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """Measurements of texts without nulls."""
    words, counts = blank_split(texts)
    coded = _codes(words)
    echoes = np.concatenate([[False], coded[1:] == coded[:-1]])[: len(coded)]
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    echoes[firsts] = False
    raw = texts.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    lists = pc.split_pattern(texts, "\n")
    lines, n_lines = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    owner = np.repeat(np.arange(len(sizes)), n_lines)[full]
    codes = _codes(lines.filter(pa.array(full)))
    with_words = np.bincount(owner, minlength=len(sizes))
    distinct = np.bincount(np.unique(owner * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1), minlength=len(sizes)) if len(codes) else with_words
    flags = lambda found: found.to_numpy(zero_copy_only=False).astype(np.uint8)
    return {
        "n_words": counts, "word_chars": _sums(pc.utf8_length(words).to_numpy(zero_copy_only=False), counts), "n_symbols": _sums(_SYMBOLS[data], sizes),
        "n_dup_lines": with_words - distinct, "n_repeat_words": _repeated_words(coded, counts), "n_lines": with_words, "n_upper": _sums(_UPPER[data], sizes),
        "n_shouts": _sums(flags(pc.ends_with(words, _SHOUT.decode())), counts), "n_bars": _sums(flags(pc.equal(words, _BAR.decode())), counts), "n_echoes": _sums(echoes, counts),
    }


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the MEASURES and bits (bit i: the rule of bit i fails), a row per document; one pass, no shuffle.

    Words are maximal runs without blanks (space and \\t to \\r), symbols ``#*$%&|<>``, lines parts between "\\n" that hold a word;
    n_upper counts A-Z, n_shouts words that end in "!!", n_bars words that are "|", n_echoes words equal to the one
    before. A null text is an empty one; texts of
    any length are read whole; repeated rows and null ids are rows like any other; an empty table gives an empty ledger; other
    columns aren't read. Measurements and limits are whole numbers, so a measure right at its limit passes.
    """
    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = measured(pc.fill_null(part.column("text").cast(pa.string()), ""))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["doc_id", *MEASURES])

    rows = slim.mapInArrow(look, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("bits", sum((_bit(r) for r in RULES.values()), F.lit(0).cast("long")))


def judged(entries: DataFrame, policy: Policy) -> DataFrame:
    """A ledger with base_failed (a BASE rule fails, at its own limit) and kept (that isn't so, and the policy doesn't reject)."""
    base = sum(1 << RULES[r].bit for r in BASE)
    failed = F.col("bits").bitwiseAND(base) != 0
    return entries.withColumns({"base_failed": failed, "kept": ~failed & (policy.bits().bitwiseAND(policy.mask()) == 0)})


def ablations(entries: DataFrame, policies: dict[str, Policy] | None = None) -> DataFrame:
    """policy, rule, n (documents), kept, failed (of the rule), only (rejected by it alone), kept_without: a row per policy and rule.

    Documents are counted by bit pattern under each policy's limits, before anything moves; rules are read from the patterns.
    """
    policies = POLICIES if policies is None else policies
    under = F.array(*(F.struct(F.lit(name).alias("policy"), F.lit(p.mask()).cast("long").alias("mask"), p.bits().bitwiseAND(p.mask()).alias("bits")) for name, p in policies.items()))
    patterns = entries.select(F.explode(under).alias("x")).groupBy("x.policy", "x.mask", "x.bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for name, r in RULES.items()))
    each = patterns.select("*", F.explode(rules).alias("r")).filter(F.col("mask").bitwiseAND(F.col("r.bit")) != 0)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    bits, bit = F.col("bits"), F.col("r.bit")
    rest = bits.bitwiseAND(F.bitwise_not(bit))
    return each.groupBy("policy", F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n"), total(bits == 0)("kept"), total(bits.bitwiseAND(bit) != 0)("failed"), total(bits == bit)("only"), total(rest == 0)("kept_without")
    )
