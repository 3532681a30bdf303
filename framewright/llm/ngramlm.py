"""LM scoring with an Elias-Fano n-gram trie.

The model is a trigram model with interpolated absolute discounting over the add-one unigram. Its counts are taken
from all training documents and its trie is cut by the middle word of the trigrams: a shard of middle words holds
everything that is needed for the places after these words, but for the unigrams.

Flow: distinct words of each block meet by word, get a number and their training count (see wordblocks); each
block sums its base scores and sends every place (word before, middle word, word, document) to the shard of its
middle word; a shard counts its training trigrams, builds the trie, maps its levels and scores all its places;
blocks gather sums by document.

A middle word of more than HOT_PLACES places, or of one in HOT_SHARE of all, is cut a second time. Its counts (v, w) are summed over distinct
rows of each block and the blocks get them back, so that its places travel with the probability of w after v and meet by
(v, u), which is all that the next level needs. What follows a pair (u, v) that is as frequent is counted in the same way
by (v, u, w); its places are scored where they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import wordblocks as wb
from framewright.llm.arrow import release
from framewright.llm.eliasfano import Trie
from framewright.llm.names import col
from framewright.llm.store import stored

FOLDS, HELD_OUT = 7, 2
#: Places that a shard of the trie should see.
SHARD_PLACES = 1_000_000
#: Places after one word, or after one pair of words, that a task may take; beyond, they are cut again. Where a part in
#: HOT_SHARE of all places is less, that is the bound, so that smaller tables take the same way.
HOT_PLACES, HOT_SHARE = 4_000_000, 2048
#: Unigram log10 probabilities travel in steps of this.
UNIGRAM_STEP = 1 / 24
#: Places of hot words whose probabilities are worked out at a time.
PIECE = 1 << 18


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between blanks with A-Z lower-cased; the end is added by wordblocks."""
    return wb.blank_split(pc.ascii_lower(texts))


def _number_words(shards: int, hot: int):
    """Answers each word with its number and its training count, and says each shard's totals and words of over ``hot`` places.

    One shard at a time is held: its words once, its rows as places among them.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[bytes, int] = {}
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        sums: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        own = None
        for batch in batches:
            for block, shard, p in zip(batch.column("block").to_pylist(), batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if held and shard != own:
                    yield from said(own, index, held, sums)
                    index, held, sums = {}, [], [np.zeros(0, np.int64)] * 2
                own = shard
                codes, words, counts = wb.unpack_words(p)
                at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
                for i, n in enumerate(counts):
                    if len(sums[i]) < len(index):
                        sums[i] = np.concatenate([sums[i], np.zeros(len(index), np.int64)])
                    sums[i][at] += n.astype(np.int64)  # a row has a word once
                held.append((block, codes.astype(np.int32), at))
        if held:
            yield from said(own, index, held, sums)

    def said(shard: int, index: dict[bytes, int], rows: list[tuple[int, np.ndarray, np.ndarray]], sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        counts, places = (x[: len(index)] for x in sums)
        # Frequent words get small numbers, which pack well; ties by the word.
        names, order = list(index), counts.tolist()
        number = np.empty(len(names), np.int64)
        number[sorted(range(len(names)), key=lambda i: (-order[i], names[i]))] = np.arange(len(names)) * shards + shard
        for block, codes, at in rows:
            yield _row(block, shard, wb.pack(np.diff(codes, prepend=0), number[at], counts[at]))
        yield _row(-1, shard, wb.pack(np.array([counts.sum()]), np.array([(counts > 0).sum()]), np.array([len(names) * shards + shard]), number[places > hot]))

    return answer


def _distinct(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """Distinct (v, u, w) in order, the sums of n, and each row's place among them. Ids are below ``base``."""
    pairs, first = np.unique(v * base + u, return_inverse=True)
    keys, back = np.unique(first * base + w, return_inverse=True)
    of = pairs[keys // base]
    return of // base, of % base, keys % base, np.bincount(back, weights=n, minlength=len(keys)).astype(np.int64), back


def _sum_counts(base: int, hot: int):
    """Answers rows (v, u, w, n) with the sums of n. ``base - 1`` stands for no word: such rows with no w aren't answered.

    Says (v, u, n, types) of what follows each v or (v, u), and of rows with no w those of over ``hot`` places, types 0.
    """

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("block").to_pylist(), batch.column("shard").to_pylist(), ([x.astype(np.int64) for x in wb.unpack(p.as_py())] for p in batch.column("payload")), strict=True)
        if not rows:
            return
        v, u, w, n, back = _distinct(*(np.concatenate([r[2][i] for r in rows]) for i in range(4)), base)
        at = 0
        for block, shard, own in rows:
            of = back[at : at + len(own[0])]
            at += len(of)
            of = of[own[2] < base - 1]
            if len(of):
                yield _row(block, shard, wb.pack(v[of], u[of], w[of], n[of]))
        whole = w < base - 1
        heads, of = np.unique((v * base + u)[whole], return_inverse=True)
        totals = (np.bincount(of, weights=x, minlength=len(heads)).astype(np.int64) for x in (n[whole], n[whole] > 0))
        frequent = ~whole & (n > hot)
        more = v[frequent], u[frequent], n[frequent], np.zeros(int(frequent.sum()), np.int64)
        yield _row(-1, -1, wb.pack(*(np.concatenate(x) for x in zip((heads // base, heads % base, *totals), more, strict=True))))

    return answer


def _row(block: int, shard: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([payload], pa.binary())], names=["block", "shard", "payload"])


def _among(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``x`` in ascending keys, and which of them are there."""
    at = np.searchsorted(keys, x)
    there = at < len(keys)
    there[there] = keys[at[there]] == x[there]
    return np.where(there, at, 0), there


def _discounted(n: np.ndarray, total: np.ndarray, types: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    d, total = Trie.DISCOUNT, np.maximum(total, 1)
    return np.maximum(n - d, 0) / total + np.where(types > 0, d * types / total, 1) * shorter


def _shard_of(v: np.ndarray, shards: int) -> np.ndarray:
    return ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id's text modulo FOLDS is not HELD_OUT; a null id is in no fold and
    is learned from. A null text is an empty one, of one end. Repeated rows count as often as they stand. A long text is
    one document of one block, scored whole. An empty table gives an empty result; without training rows the model is the
    uniform one. Other columns aren't read.
    """
    shards, tasks = wb.sizes_for(docs, text)
    held_out = F.coalesce(F.pmod(F.crc32(col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), (~held_out).alias("train"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    blocks = stored(wb.word_blocks(slim, tokens, shards, extra="train", counted=True, end=True), "words")
    every, n_docs = blocks.filter("shard < 0").select(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)), F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()
    n_places = every / 1.5  # about a byte and a half of packed codes a place
    most = max(1, min(HOT_PLACES, int(n_places / HOT_SHARE)))
    answers = stored(wb.answered(blocks, shards, _number_words(shards, most)), "word-counts")
    totals = [wb.unpack(bytes(r["payload"])) for r in answers.filter("block < 0").select("payload").collect()]  # a row per shard
    train_tokens, vocabulary = sum(int(t[0][0]) for t in totals), sum(int(t[1][0]) for t in totals)
    start = max((int(t[2][0]) for t in totals), default=0) + 1  # the number of what stands before a text
    # At most HOT_SHARE words, or one in HOT_PLACES places.
    hot = np.sort(np.concatenate([*(t[3].astype(np.int64) for t in totals), np.array([start] if n_docs > most else [], np.int64)]))
    none, base = start + 1, start + 2
    parts = max(tasks, int(n_places / SHARD_PLACES) + 1)
    mass = np.log10(train_tokens + vocabulary + 1)
    fields = f"block long, shard long, doc_ids array<{kind}>, held array<boolean>, payload binary"

    def placed(block: wb.Block, payloads: list[bytes]) -> tuple[np.ndarray, ...]:
        """Codes of the word, the word before and that before it of each place; the number and the training count of each code.

        What stands before a text has the last code. Places stay codes of four bytes: there are millions in a block, and fewer words.
        """
        got = [wb.unpack(p) for p in payloads]
        codes = np.concatenate([np.cumsum(g[0], dtype=np.int64) for g in got] or [np.zeros(0, np.int64)])
        numbers, counts = np.full(len(codes) + 1, start), np.zeros(len(codes) + 1, np.int64)
        for g, own in zip(got, np.split(codes, np.cumsum([len(g[0]) for g in got])[:-1]) if got else [], strict=True):
            numbers[own], counts[own] = g[1], g[2]
        w, firsts = block.codes.astype(np.uint32, copy=False), block.bounds[:-1]
        v, u = np.empty_like(w), np.empty_like(w)
        v[1:], v[firsts] = w[:-1], len(codes)
        u[1:], u[firsts] = v[:-1], len(codes)
        return w, v, u, numbers, counts

    def counted(pairs: np.ndarray | None) -> DataFrame:
        """Counts of what follows the hot words and of what stands before them; with ``pairs``, of what follows these."""

        def ask(block: wb.Block, payloads: list[bytes]) -> pa.Table:
            w, v, u, numbers, _ = placed(block, payloads)
            train = np.repeat(np.array(block.extra, bool), np.diff(block.bounds))
            some = np.flatnonzero(_among(hot, numbers)[1][v])
            asks: list[list[tuple[np.ndarray, ...]]] = [[], []]
            for at in np.split(some, range(PIECE, len(some), PIECE)):
                x, y, z, n = numbers[v[at]], numbers[u[at]], numbers[w[at]], train[at].astype(np.int64)
                if pairs is None:
                    no = np.full(len(at), none)
                    asks[0].append(_distinct(x, no, z, n, base)[:4])
                    asks[1].append(_distinct(x, y, no, np.ones_like(n), base)[:4])
                else:
                    here = _among(pairs, x * base + y)[1]
                    asks[0].append(_distinct(x[here], y[here], z[here], n[here], base)[:4])
            del w, v, u, train, some
            rows = []
            for pieces in asks if pairs is None else asks[:1]:
                *own, _ = _distinct(*(np.concatenate(x) for x in zip(*pieces, strict=True)), base)
                of = _shard_of(own[0] * 31 + own[1] * 7919 + own[2], parts)
                order = np.argsort(of, kind="stable")
                rows += [(int(of[x[0]]), wb.pack(*(y[x] for y in own))) for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(x)]
            del asks, pieces, own, of, order
            release()
            return pa.table({"block": pa.array([block.number] * len(rows), pa.int64()), "shard": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

        asked = wb.met(blocks, answers.filter("block >= 0"), ask, "block long, shard int, payload binary", tasks)
        return stored(wb.answered(asked, parts, _sum_counts(base, most)), "hot-counts")

    def said(counts: DataFrame) -> np.ndarray:
        """v, u, n and types, summed over the shards: a column per hot word or pair."""

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.column("payload"):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in wb.unpack(p.as_py())], names=["v", "u", "n", "types"])

        rows = counts.filter("block < 0").select("payload").mapInArrow(opened, "v long, u long, n long, types long")
        found = rows.groupBy("v", "u").agg(F.sum("n"), F.sum("types")).orderBy("v", "u").collect()
        return np.array(found, np.int64).reshape(-1, 4).T

    def by_context(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[0] * base + x[1], x[2], x[3]

    nothing = np.zeros(0, np.int64)
    after_hot, after_pairs, pairs, given = (nothing,) * 3, (nothing,) * 3, nothing, answers.filter("block >= 0")
    if len(hot):
        counts_two = counted(None)
        x = said(counts_two)
        frequent = x[:, (x[1] != none)]
        after_hot, pairs = by_context(x[:, x[1] == none]), frequent[0] * base + frequent[1]
        given = given.unionByName(counts_two.filter("block >= 0"))
        if len(pairs):
            counts_three = counted(pairs)
            after_pairs, given = by_context(said(counts_three)), given.unionByName(counts_three.filter("block >= 0"))

    def sure(table: list[np.ndarray], after: tuple[np.ndarray, ...]) -> Callable[..., np.ndarray]:
        """Probabilities of w after contexts (v, u) whose counts the block has been given in ``table``."""
        contexts, at = np.unique(table[0] * base + table[1], return_inverse=True)
        keys = at * base + table[2]
        order = np.argsort(keys)
        keys, counts = keys[order], table[3][order]
        total, known = _among(after[0], contexts)

        def probabilities(v: np.ndarray, u: np.ndarray | int, w: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            if not len(keys) or not len(after[0]):
                return shorter
            at, there = _among(contexts, v * base + u)
            found, has = _among(keys, at * base + w)
            n = np.where(has & there, counts[found], 0)
            return np.where(known[at] & there, _discounted(n, after[1][total[at]], after[2][total[at]], shorter), shorter)

        return probabilities

    def places(block: wb.Block, payloads: list[bytes]) -> pa.Table:
        # The answers for words have three arrays, those for hot ones four.
        w, v, u, numbers, counts = placed(block, [p for p in payloads if p[0] == 3])
        firsts, n_tokens = block.bounds[:-1], np.diff(block.bounds)  # a text has an end at least
        logs = np.log10(counts + 1.0)
        base_score = np.add.reduceat(logs[w], firsts) - n_tokens * mass
        known = np.add.reduceat((counts > 0)[w], firsts, dtype=np.int64)
        single = np.round((mass - logs) / UNIGRAM_STEP).astype(np.uint16)[w]
        owner, local = np.repeat(np.arange(len(n_tokens), dtype=np.int32), n_tokens), np.zeros(len(n_tokens))
        # Shards of the trie, then as many of hot words; places that are scored here come last.
        of = _shard_of(numbers, parts).astype(np.min_scalar_type(2 * parts))[v]
        own_hot = np.flatnonzero(_among(hot, numbers)[1][v])
        if len(own_hot):
            got = [wb.unpack(p) for p in payloads if p[0] == 4]
            table = [np.concatenate([g[i].astype(np.int64) for g in got]) for i in range(4)]
            two = table[1] == none
            after_word, after_pair = sure([t[two] for t in table], after_hot), sure([t[~two] for t in table], after_pairs)
            del got, table
            for at in np.split(own_hot, range(PIECE, len(own_hot), PIECE)):
                x, y, z = numbers[v[at]], numbers[u[at]], numbers[w[at]]
                p = after_word(x, none, z, 10.0 ** (logs[w[at]] - mass))
                single[at] = np.maximum(np.round(-np.log10(p) / UNIGRAM_STEP), 0)
                of[at] = parts + _shard_of(x * 31 + y * 7919, parts)
                here = np.flatnonzero(_among(pairs, x * base + y)[1])
                if len(here):
                    p = after_pair(x[here], y[here], z[here], p[here])
                    local += np.bincount(owner[at[here]], np.log10(np.minimum(p, 1.0)), len(local))
                    of[at[here]] = 2 * parts
            del after_word, after_pair, own_hot
        order = np.argsort(of, kind="stable")  # of two bytes, they are ordered by radix
        ends = np.cumsum(np.bincount(of, minlength=2 * parts)[: 2 * parts])
        del of
        train = np.array(block.extra, bool)
        ids = block.doc_ids
        number = block.number
        rows = [(number, -1 - number, ids, pa.array(~train), wb.pack(n_tokens, known) + base_score.tobytes() + local.tobytes())]
        for shard in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
            part = order[ends[shard - 1] if shard else 0 : ends[shard]]
            own = owner[part]
            rows.append((number, shard, None, None, wb.pack(np.diff(own, prepend=0), numbers[v[part]], numbers[u[part]], numbers[w[part]], single[part], train[own])))
        del w, v, u, single, owner, order
        release()
        lists = lambda i, t: pa.array([r[i].to_pylist() if r[i] is not None else None for r in rows], pa.list_(t))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([r[1] for r in rows], pa.int64()), "doc_ids": lists(2, ids.type), "held": lists(3, pa.bool_()), "payload": pa.array([r[4] for r in rows], pa.binary())})

    def score_shard(table: pa.Table) -> pa.Table:
        table = table.drop_columns("task")
        if table.column("shard")[0].as_py() < 0:
            return table
        kind = np.int32 if start < 2**31 else np.int64
        by_pair = table.column("shard")[0].as_py() >= parts  # contexts of the hot words, whose shorter ones are worked out

        def learned() -> list[np.ndarray]:
            parts: list[list[np.ndarray]] = [[], [], []]
            for p in table.column("payload"):
                _, *ids, _, train = wb.unpack(p.as_py())
                for part, x in zip(parts, ids, strict=True):
                    part.append(x[train > 0].astype(kind))
            return [np.concatenate(part) for part in parts]

        if by_pair:
            v, u, w = learned()
            contexts, place = np.unique(v.astype(np.int64) * base + u, return_inverse=True)
            trie = Trie(place, np.zeros(len(place), np.int64), w.astype(np.int64), max(start, len(contexts)) + 1)
            del v, u, w, place
        else:
            trie = Trie(*learned(), start + 1)
        out = []
        # Rows are unpacked a second time: all of them at once would be larger than the trie.
        for payload in table.column("payload"):
            steps, v, u, w, single, _ = wb.unpack(payload.as_py())
            owner = np.cumsum(steps, dtype=np.int64)
            v, u, w, single = v.astype(np.int64), u.astype(np.int64), w.astype(np.int64), 10.0 ** (-UNIGRAM_STEP * single)
            if by_pair:
                at, there = _among(contexts, v * base + u)
                p = trie.probabilities(np.where(there, at, len(contexts)), None, w, single)
            else:
                p = trie.probabilities(v, u, w, single)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            sums = np.add.reduceat(np.log10(np.minimum(p, 1.0)), heads)
            out.append(wb.pack(np.diff(owner[heads], prepend=0)) + sums.astype("<f4").tobytes())
        del trie
        release()
        return table.set_column(table.column_names.index("payload"), "payload", pa.array(out, pa.binary()))

    def gather(table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_numpy()
        at = int(np.flatnonzero(shard < 0)[0])
        own = table.column("payload")[at].as_py()
        ids = table.column("doc_ids")[at].values
        n, known = (x.astype(np.int64) for x in wb.unpack(own))
        base_score, score = np.frombuffer(own[len(own) - 16 * len(ids) :], np.float64).reshape(2, -1)
        score = score.copy()
        for i in np.argsort(shard, kind="stable").tolist():
            if i != at:
                p = table.column("payload")[i].as_py()
                owner = np.cumsum(wb.unpack(p)[0], dtype=np.int64)
                score[owner] += np.frombuffer(p[len(p) - 4 * len(owner) :], "<f4")
        return pa.table({"doc_id": ids, "held_out": table.column("held")[at].values, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(ids), train_tokens), "base_score": base_score, "score": score})

    sent = wb.met(blocks, given, places, fields, tasks)
    turn = wb.turns(blocks)
    done = wb.in_tasks(sent, parts, F.when(F.col("shard") < 0, turn).otherwise(F.col("shard"))).groupBy("task", "shard").applyInArrow(score_shard, fields)
    return wb.in_tasks(done, tasks, turn).groupBy("task", "block").applyInArrow(gather, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
