"""The rule ledger, the filter audit and collocations against plain versions."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import collocations, filteraudit, ruleledger

SCHEMA = "doc_id long, text string, lang string, n_words long, bits long, part string, u string, n long, state string"


def frame(spark, rows):
    """Rows (doc_id, text, lang), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, 7, 8, "p", "u", 9, "s") for i, t, lang in rows], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- Rule ledger ------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return (
        len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered), len(lines), sum("A" <= x <= "Z" for x in text),
        sum(w.endswith("!!") for w in words), words.count("|"), sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def texts():
    rng = np.random.default_rng(5)
    out = [None, "", " \n\t ", "a", "\n\n", "one\x0btwo\x1fthree\rfour", "é! É!! | <x>", "# * $\n# * $\n\n# * $ ", "!! !!"]
    out += [" ".join(rng.choice(["a", "b", "C"], 40)) for _ in range(5)]
    out += ["x y z w v u t s r " * 3, "\n".join(["the same line of words here now"] * 4), "w " * 100_000, " ".join(f"w{i % 1009}" for i in range(60_000)), "A" * 300_000]
    out += [" ".join(rng.choice([f"w{i}" for i in range(300)], n)) for n in (7, 8, 9, 19, 20, 21, 500)]
    return out + ["the words " * 5, "the words " * 5]


def test_ledger(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(None, "a b", None), (3, "a", "x"), (3, "a", "x")]
    got = ruleledger.judged(ruleledger.ledger(frame(spark, rows)), ruleledger.POLICIES["v2"]).collect()
    assert len(got) == len(rows)
    want = Counter((i, *plain_measures(t)) for i, t, _ in rows)
    assert Counter(tuple(r)[: len(ruleledger.MEASURES) + 1] for r in got) == want
    for r in got:
        names = r.asDict()
        fails = {n: bool(eval(rule.fails.format(limit=rule.limit), {}, names)) for n, rule in ruleledger.RULES.items()}
        assert r["bits"] == sum(1 << ruleledger.RULES[n].bit for n, f in fails.items() if f)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not any(fails.values()))


def test_policies_and_ablations(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    entries = ruleledger.ledger(frame(spark, rows)).cache()
    measures = [r.asDict() for r in entries.collect()]
    got = {(r["policy"], r["rule"]): r for r in ruleledger.ablations(entries).collect()}
    seen = 0
    for name, policy in ruleledger.POLICIES.items():
        fails = [{n for n in policy.rules if eval(ruleledger.RULES[n].fails.format(limit=policy.limits.get(n, ruleledger.RULES[n].limit)), {}, m)} for m in measures]
        base = [{n for n in ruleledger.BASE if eval(ruleledger.RULES[n].fails.format(limit=ruleledger.RULES[n].limit), {}, m)} for m in measures]
        kept = {r["doc_id"]: r["kept"] for r in ruleledger.judged(entries, policy).collect()}
        assert [kept[m["doc_id"]] for m in measures] == [not f and not b for f, b in zip(fails, base, strict=True)]
        for rule in policy.rules:
            r = got[name, rule]
            seen += 1
            assert (r["n"], r["kept"], r["failed"], r["only"], r["kept_without"]) == (
                len(rows), sum(not f for f in fails), sum(rule in f for f in fails), sum(f == {rule} for f in fails), sum(not f - {rule} for f in fails)
            )
    assert seen == len(got)


def test_ledger_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ruleledger.judged(ruleledger.ledger(empty), ruleledger.POLICIES["v1"]).collect() == []
    assert ruleledger.ablations(ruleledger.ledger(empty)).collect() == []


def test_bits_are_distinct():
    bits = [r.bit for r in ruleledger.RULES.values()]
    assert len(set(bits)) == len(bits) and all(set(p.limits) <= set(p.rules) <= set(ruleledger.RULES) for p in ruleledger.POLICIES.values())


# --- Filter audit -----------------------------------------------------------------------------------------


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    texts = [t or "" for _, t, _ in rows]
    fails = []
    for (i, _, _), t in zip(rows, texts, strict=True):
        w = words_of(t)
        f = set()
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            f.add("C")
        if re.search("[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and x == t for (j, _, _), x in zip(rows, texts, strict=True)):
            f.add("E")
        fails.append(f)
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails, strict=True) if (lang or "") == part]
        removed_of = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_of[x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed_of[order[k - 1]])
    return out


def test_audit(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        n = int(rng.choice([0, 5, 99, 100, 101, 150]))
        t = " ".join(f"w{int(x)}" for x in rng.integers(0, int(rng.choice([20, 2000])), n)) + rng.choice(["", " #", " | x", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 5, " é" * 10])
        rows.append((i, t, rng.choice(["en", "de", ""])))
    rows += [(100 + i, rows[i % 7][1], ["en", "fr", None][i % 3]) for i in range(30)]
    rows += [(None, rows[0][1], "en"), (None, None, None), (200, None, "en"), (201, "", "en"), (0, rows[0][1], "en"), (0, "another # text", "xx"), (300, rows[3][1], "en"), (300, rows[3][1], "en"), (400, "Ab cd " * 50_000, "long")]
    labels = [(i, int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 90)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (500, 1, 1), (7, 0, 1), (7, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.filter_audit(frame(spark, rows), marks).collect()
    want = plain_audit(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want
    assert len(got) == len(want) == 600 * 6


def test_audit_of_nothing(spark):
    empty = frame(spark, [(1, "a", "b")]).limit(0)
    assert filteraudit.filter_audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


@pytest.mark.parametrize("before", [frozenset(), frozenset({(0, 1)}), frozenset({(2, 0), (1, 3)})])
def test_paths_are_orders(before):
    n = 4
    allowed = [p for p in itertools.permutations(range(n)) if all(p.index(a) < p.index(b) for a, b in before)]
    assert sorted(filteraudit.orders(n, before)) == sorted(allowed)
    reach, leave = filteraudit.path_counts(n, before)
    assert reach[-1] == leave[0] == len(allowed)
    for state in range(1 << n):
        members = {f for f in range(n) if state >> f & 1}
        passing = sum(set(p[: len(members)]) == members for p in allowed)
        assert reach[state] * leave[state] == passing
    if not before:
        assert reach == [math.factorial(s.bit_count()) for s in range(1 << n)]


def test_audit_of_other_filters(spark):
    """Three filters with an order between two: shapley sums the removals over the admissible orders."""
    counted = spark.createDataFrame([("p", b, False, False, 10 + b) for b in range(8)], "part string, bits int, good boolean, toxic boolean, n long")
    got = filteraudit.audit(counted, "xyz", frozenset({(0, 2)})).collect()
    assert {r["filter_order"] for r in got} == {"xyz", "xzy", "yxz"}
    for letter in "xyz":
        own = [r for r in got if r["filter_order"][r["step"] - 1] == letter]
        assert {r["shapley"] for r in own} == {sum(r["removed"] for r in own)}
    with pytest.raises(ValueError):
        filteraudit.audit(counted, "")


# --- Collocations -----------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            longer = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return out


def phrase_rows():
    rng = np.random.default_rng(2)
    vocabulary = ["the", "of", "new", "york", "city", "a", "b", "c", "É", "é", "Über", "x-y", "1", "the,", "end.", "q!", "\t", "  ", "\n", "\x0b", "z\x1f"]
    p = np.array([8, 6, 3, 3, 3] + [1] * 16, float)
    rows = [(i, " ".join(rng.choice(vocabulary, int(n), p=p / p.sum())), rng.choice(["en", "de"])) for i, n in enumerate(rng.integers(0, 80, 150))]
    rows += [(None, "New York city", None), (None, None, None), (5, "", "en"), (5, "New York CITY. " * 40, None), (6, "tie one two; tie two one. " * 5, "tt"), (7, "tie one two; tie two one. " * 5, "tt"), (8, "end of the world" + " w" * 5000, "ww"), (9, "y" * 70_000 + " z", "ww")]
    return rows + [rows[3]] * 4


@pytest.mark.parametrize("least, top, hot, block", [(2, 50, None, None), (2, 10_000, 0.01, 300), (3, 7, 0.2, 1000), (10, 2000, 0.0001, 100)])
def test_collocations(spark, monkeypatch, least, top, hot, block):
    if hot:
        monkeypatch.setattr(collocations, "HOT_SHARE", hot)
        monkeypatch.setattr(collocations, "LEAST_HOT", 1)
    if block:
        monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
        monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
        monkeypatch.setattr(collocations, "MERGE", 50)
        monkeypatch.setattr(collocations, "BUCKET_BYTES", 2000)
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows).repartition(5), least=least, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations(rows, least, top))
    assert got


def test_no_collocations(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(frame(spark, [(1, "a b c", "en"), (2, None, "en")])).collect() == []


def test_scores_are_exact(spark):
    """Products of 128 bits: one more or less in a count decides about the last whole number."""
    rows = [(10**15 + 7, 3 * 10**15 + 1, 10**15 + 9), (999_999_999_999, 10**12, 10**12 - 1), (3, 7, 11), (10, 10, 10), (4 * 10**15, 4 * 10**15, 5 * 10**15)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = df.select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 1_000_000 * r["a"] * r["a"] // (r["l"] * r["r"]) for r in got)


def test_hot_prefixes_are_few(spark):
    rows = [(i, "hot pair of words " * 50, "en") for i in range(20)]
    slim = frame(spark, rows).select("lang", "text")
    hot = collocations.hot_prefixes(slim, share=0.1, least=10)
    assert hot == {"en": (frozenset({b"hot", b"pair", b"of", b"words"}), frozenset({(b"hot", b"pair"), (b"pair", b"of"), (b"of", b"words"), (b"words", b"hot")}))}
    assert collocations.hot_prefixes(slim, share=0.3, least=10) == {}


def test_entries_beyond_64_bits():
    """Codes of very many words don't fit one 64-bit number together; they are added up in two steps."""

    class Many(list):
        def __len__(self):
            return 3_000_000

    rng = np.random.default_rng(0)
    u, v, w = (rng.integers(0, 2_999_999, 500) for _ in range(3))
    u, v, w = (np.concatenate([x, x[:200]]) for x in (u, v, w))
    got = collocations.added_up(Many(), u, v, w, np.arange(1, 701))
    want = Counter()
    for key, n in zip(zip(u.tolist(), v.tolist(), w.tolist(), strict=True), range(1, 701), strict=True):
        want[key] += n
    assert list(zip(got.u.tolist(), got.v.tolist(), got.w.tolist(), strict=True)) == sorted(want)
    assert got.n.tolist() == [want[k] for k in sorted(want)]
