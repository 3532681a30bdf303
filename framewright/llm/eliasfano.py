"""Elias-Fano sequences and an n-gram trie whose levels are such sequences, as numpy arrays in a mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

_ONE = np.uint64(1)


class Levels:
    """Arrays appended to one unnamed file, mapped read-only once it is closed for writing."""

    def __init__(self) -> None:
        self._file = tempfile.TemporaryFile()
        self._places: dict[str, tuple[int, int, np.dtype]] = {}
        self._map: np.ndarray | None = None

    def put(self, name: str, array: np.ndarray) -> None:
        self._file.write(b"\0" * (-self._file.tell() % 8))
        self._places[name] = (self._file.tell(), len(array), array.dtype)
        self._file.write(np.ascontiguousarray(array).tobytes())

    def get(self, name: str) -> np.ndarray:
        if self._map is None:
            self._file.write(b"\0" * 8)
            self._file.flush()
            self._map = np.memmap(self._file, np.uint8, "r")
        at, n, kind = self._places[name]
        return self._map[at : at + n * kind.itemsize].view(kind)

    @property
    def size(self) -> int:
        return self._file.tell()


class EliasFano:
    """An ascending sequence of n numbers below ``top`` in about n * (2 + log2(top / n)) bits."""

    def __init__(self, levels: Levels, name: str) -> None:
        self.n, self.low_bits, self.buckets = (int(x) for x in levels.get(name + ".shape"))
        self.low, self.high, self.ones = (levels.get(f"{name}.{k}") for k in ("low", "high", "ones"))

    @staticmethod
    def put(levels: Levels, name: str, values: np.ndarray, top: int) -> None:
        n = len(values)
        low_bits = max(0, (max(1, top) // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        buckets = (max(1, top) >> low_bits) + 1
        at = high + np.arange(n)
        words = np.zeros((n + buckets) // 64 + 1, np.uint64)
        _or_runs(words, at >> 6, _ONE << (at & 63).astype(np.uint64))
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            part, place = values & np.uint64((1 << low_bits) - 1), np.arange(n, dtype=np.int64) * low_bits
            _or_runs(low, place >> 6, part << (place & 63).astype(np.uint64))
            over = (place & 63) + low_bits > 64
            _or_runs(low, (place[over] >> 6) + 1, part[over] >> (64 - (place[over] & 63)).astype(np.uint64))
        levels.put(name + ".shape", np.array([n, low_bits, buckets], np.int64))
        levels.put(name + ".low", low)
        levels.put(name + ".high", words)
        levels.put(name + ".ones", np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        w, s = at >> 6, (at & 63).astype(np.uint64)
        rest = np.where(s > 0, self.low[w + 1] << (np.uint64(64) - np.maximum(s, _ONE)), np.uint64(0))
        return ((self.low[w] >> s) | rest) & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Positions of the k-th ones, or zeros, of the upper halves."""
        before = np.arange(len(self.ones)) * 64 - self.ones if zeros else self.ones
        w = np.searchsorted(before, k, side="right") - 1
        word = self.high[w]
        if zeros:
            word = ~word
        left, at = (k - before[w]).astype(np.int64), w * 64
        for width in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            on = left >= c
            at += on * width
            left -= on * c
            word = np.where(on, word >> np.uint64(width), word)
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        high = self._select(i, zeros=False) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the first number that is ``x`` or more, the end of those with the upper half of x, x's lower half."""
        h, low = x >> self.low_bits, (x & ((1 << self.low_bits) - 1)).astype(np.uint64)
        h = np.minimum(h, self.buckets - 1)
        at = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros=True) + 1, 0)
        start = at - h
        # The ones up to the next zero; where they reach the end of their word, the zero is looked for.
        shift = (at & 63).astype(np.uint64)
        rest = ~(self.high[at >> 6] >> shift)
        run = np.bitwise_count((rest & (np.uint64(0) - rest)) - _ONE).astype(np.int64)
        over = np.flatnonzero(run >= 64 - (at & 63))
        run[over] = self._select(h[over], zeros=True) - at[over]
        end = start + run
        # Numbers with one upper half stand together, often many of them: halve the stretch by the lower half.
        todo = np.flatnonzero(start < end)
        a, b, x_low = start[todo], end[todo], low[todo]
        while len(todo):
            middle = (a + b) >> 1
            less = self._low(middle) < x_low
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            done = a >= b
            if done.any():
                start[todo[done]] = a[done]
                open_ = ~done
                todo, a, b, x_low = todo[open_], a[open_], b[open_], x_low[open_]
        return start, end, low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is ``x`` or more; n if there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of ``x``, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        i, end, low = self._search(x)
        inside = i < end
        return np.where(inside & (self._low(np.where(inside, i, 0)) == low), i, -1)


def _or_runs(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """ORs bits into words at ascending places."""
    if len(at):
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[heads]] |= np.bitwise_or.reduceat(bits, heads)


#: Probabilities and weights are kept in a byte, in steps of this power of ten.
STEP = 0.03


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 255).astype(np.uint8)


def probability(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * q)


def _numbered(values: np.ndarray, counted: bool = False):
    """Distinct values and each value's place among them (32 bits), in little more memory than a sorted copy."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    heads = np.flatnonzero(new)
    distinct = ordered[heads]
    counts = np.diff(heads, append=len(ordered)) if counted else None
    del ordered, new, heads
    place = np.empty(len(values), np.int32)
    for i in range(0, len(values), 1 << 18):
        place[i : i + (1 << 18)] = np.searchsorted(distinct, values[i : i + (1 << 18)])
    return (distinct, place, counts) if counted else (distinct, place)


class Trie:
    """Trigrams (u, v, w) under their middle words v, counted from some training places.

    Levels: the contexts v; under each its successors w; under each the words u before it, as contexts (u, v); and
    under these their successors, each written not as a word but as its place among the successors of v alone. All are
    Elias-Fano sequences, as are the pointers from a context to its successors. Discounted probabilities and the weights
    of the next shorter context are quantised.
    """

    DISCOUNT = 0.75

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, words: int) -> None:
        """Equal-length arrays of training trigrams, repeats standing for counts; all ids are below ``words``."""
        v, u, w = (a if a.dtype.kind == "i" else a.astype(np.int64) for a in (v, u, w))
        levels, d = Levels(), self.DISCOUNT
        self.words = words
        contexts, place = _numbered(v)
        EliasFano.put(levels, "contexts", contexts, words)
        n, totals = len(contexts), np.bincount(place, minlength=len(contexts))
        keys = place.astype(np.int64)
        keys *= words
        keys += w
        pairs, place2, counts = _numbered(keys, counted=True)
        of = pairs // words
        EliasFano.put(levels, "pairs", pairs, n * words)
        types = np.bincount(of, minlength=n)
        pointers = np.concatenate([[0], np.cumsum(types)])
        EliasFano.put(levels, "pair_pointers", pointers, len(pairs) + 1)
        levels.put("pair_p", quantised((counts - d) / totals[of]))
        levels.put("context_b", quantised(d * types / np.maximum(totals, 1)))
        del of, counts, pairs
        keys += u
        keys -= w
        place2 -= pointers.astype(np.int32)[place]
        del place, v, u, w
        befores, place1 = _numbered(keys)
        del keys
        EliasFano.put(levels, "befores", befores, n * words)
        room = types[befores // words]  # a successor's place among those of v is below this
        bases = np.concatenate([[0], np.cumsum(room)])
        EliasFano.put(levels, "base_pointers", bases, int(bases[-1]) + 1)
        totals3 = np.bincount(place1, minlength=len(befores))
        keys = bases[place1]
        keys += place2
        del place1, place2
        keys.sort()
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        heads = np.flatnonzero(new)
        triples, counts3 = keys[heads], np.diff(heads, append=len(keys))
        del keys, new, heads
        EliasFano.put(levels, "triples", triples, int(bases[-1]) + 1)
        owner = np.searchsorted(bases, triples, side="right") - 1
        types3 = np.bincount(owner, minlength=len(befores))
        levels.put("triple_p", quantised((counts3 - d) / totals3[owner]))
        levels.put("before_b", quantised(d * types3 / np.maximum(totals3, 1)))
        self.levels = levels
        self._of = {k: EliasFano(levels, k) for k in ("contexts", "pairs", "pair_pointers", "befores", "base_pointers", "triples")}

    def probabilities(self, v: np.ndarray, u: np.ndarray | None, w: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of w after u, v, or after v if ``u`` is None; ``single`` holds those of w alone."""
        get, ef = self.levels.get, self._of
        heads, back = np.unique(v, return_inverse=True)
        heads_at = ef["contexts"].find(heads)
        context = heads_at[back]
        known = np.flatnonzero(context >= 0)
        p = single.copy()
        if not len(known):
            return p
        first = ef["pair_pointers"].access(np.maximum(heads_at, 0))[back][known]  # looked up once a context, not once a place
        context = context[known]
        pairs, back = np.unique(context * self.words + w[known], return_inverse=True)
        pair = ef["pairs"].find(pairs)[back]
        has = pair >= 0
        seen = np.zeros(len(known))
        seen[has] = probability(get("pair_p")[pair[has]])
        p[known] = seen + probability(get("context_b")[context]) * p[known]
        if u is None:
            return p
        befores, back = np.unique(context * self.words + u[known], return_inverse=True)
        before = ef["befores"].find(befores)
        base = ef["base_pointers"].access(np.maximum(before, 0))[back]
        before = before[back]
        longer = np.flatnonzero(before >= 0)
        before, at = before[longer], known[longer]
        seen = np.zeros(len(longer))
        both = np.flatnonzero(has[longer])
        if len(both):
            of = longer[both]
            triples, back = np.unique(base[of] + pair[of] - first[of], return_inverse=True)
            triple = ef["triples"].find(triples)[back]
            hit = triple >= 0
            seen[both[hit]] = probability(get("triple_p")[triple[hit]])
        p[at] = seen + probability(get("before_b")[before]) * p[at]
        return p
