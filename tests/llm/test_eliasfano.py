import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs

from framewright.llm.eliasfano import EliasFano, Levels, Trie, probability, quantised


@settings(max_examples=80, deadline=None)
@given(hs.lists(hs.integers(0, 5000), max_size=300), hs.integers(0, 40), hs.lists(hs.integers(0, 2**20), max_size=50))
def test_sequence_against_a_sorted_list(values, shift, asked):
    top = (5001 << shift) + 1
    values = sorted(v << shift for v in values)
    levels = Levels()
    EliasFano.put(levels, "x", np.array(values, np.int64), top)
    seq = EliasFano(levels, "x")
    assert seq.access(np.arange(len(values))).tolist() == values
    asked = np.array([a % top for a in asked] + values + [v + 1 for v in values], np.int64)
    assert seq.successor(asked).tolist() == np.searchsorted(values, asked).tolist()
    there = seq.find(asked).tolist()
    assert all((i >= 0) == (a in set(values)) and (i < 0 or values[i] == a) for i, a in zip(there, asked.tolist(), strict=True))


def test_trie_against_plain_counts():
    rng = np.random.default_rng(3)
    v, u, w = (rng.zipf(1.5, 20000) % 50 for _ in range(3))
    learn = np.arange(20000) < 15000
    trie = Trie(v[learn], u[learn], w[learn], 60)
    got = trie.probabilities(v, u, w, np.full(20000, 0.01))
    pairs, triples = {}, {}
    for a, b, c in zip(u[learn].tolist(), v[learn].tolist(), w[learn].tolist(), strict=True):
        pairs.setdefault(b, {}).setdefault(c, 0)
        pairs[b][c] += 1
        triples.setdefault((a, b), {}).setdefault(c, 0)
        triples[a, b][c] += 1
    for i in range(0, 20000, 7):
        p = 0.01
        for found in (pairs.get(v[i]), triples.get((u[i], v[i]))):
            if found:
                n = sum(found.values())
                p = max(found.get(w[i], 0) - 0.75, 0) / n + 0.75 * len(found) / n * p
        assert abs(math.log10(got[i]) - math.log10(p)) < 0.04
    assert (trie.probabilities(np.array([59]), np.array([59]), np.array([1]), np.array([0.5])) == 0.5).all()
    assert probability(quantised(np.array([1.0]))) == 1.0


def test_empty_trie():
    none = np.zeros(0, np.int64)
    assert Trie(none, none, none, 5).probabilities(np.array([1]), np.array([1]), np.array([1]), np.array([0.25])).tolist() == [0.25]
