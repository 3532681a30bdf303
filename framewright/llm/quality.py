"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; the rest of the web text is unlabelled. A small network is fitted to
minimise the non-negative unbiased risk: prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)),
where the prior, the share of good text in the unlabelled, is estimated first. Labels of bad text are never
learned from. Features describe a whole text by shares and shapes, none of its ids, source or language.

The fit runs on the driver over a bounded sample (POSITIVES and UNLABELLED rows, those with the smallest hash
of their id); features and scores are computed by Spark over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.arrow import slices
from framewright.llm.names import col

#: Bounds of the sample that the classifier is fitted on.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
HIDDEN, EPOCHS, RATE = 16, 300, 0.02

_SPACE = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
_CLASSES = {
    "upper": [range(65, 91)], "lower": [range(97, 123)], "digit": [range(48, 58)], "blank": [range(32, 33), range(9, 14)],
    "wide": [range(128, 256)], "stop": [b".,"], "loud": [b"!?"], "pipe": [b"|"], "symbol": [b"#$%&*+=@^~<>\\_`"],
    "brace": [b"()[]{}"], "mark": [b"-/:;'\""],
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _sets in enumerate(_CLASSES.values()):
    for _s in _sets:
        _TABLE[list(_s), _i] = 1
FEATURES = [*_CLASSES, "entropy", "log_words", "word_bytes", "distinct", "repeat", "top", "loud_ends", "stop_ends", "short", "long", "lines", "line_words", "twin_lines", "pairs", "cycle", "upper_words"]


def features_of(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _TABLE) / n
    p = counts[counts > 0] / n
    words = text.translate(_SPACE).split()
    m = max(1, len(words))
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    repeat = sum(map(bytes.__eq__, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:], strict=False))) / m
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    cycle = _cycle(words)
    return [
        *shares, float(-(p * np.log2(p)).sum()), math.log1p(m), float(lengths.mean()), len(seen) / m ** 0.8, repeat,
        max(seen.values(), default=0) / m, sum(w[-1] in b"!?" for w in words) / m, sum(w[-1] in b".," for w in words) / m,
        float((lengths <= 2).mean()), float((lengths >= 16).mean()), math.log1p(k), math.log1p(m / k), 1 - len(set(lines)) / k,
        pairs, cycle, sum(map(bytes.isupper, words)) / m,
    ]


#: Words of a run that has to stand again for its distance to count.
RUN = 4


def _cycle(words: list[bytes]) -> float:
    """Share of the words that stand again one period later; the period is the commonest distance between two equal runs of RUN words."""
    n = len(words) - RUN + 1
    if n < 2:
        return 0.0
    index: dict[bytes, int] = {}
    codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.uint64, len(words))
    runs = np.zeros(n, np.uint64)
    for i in range(RUN):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + codes[i : n + i]
    order = np.argsort(runs, kind="stable")
    gaps = np.diff(order)[runs[order][1:] == runs[order][:-1]]
    if not len(gaps):
        return 0.0
    period = int(np.bincount(gaps).argmax())
    return int((codes[period:] == codes[:-period]).sum()) / len(words)


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, features (array of doubles); a null text is an empty one."""
    slim = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [features_of(t.as_py() or b"") for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return slim.mapInArrow(look, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, features array<double>")


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id's text modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.layers, np.clip((x - self.mean) / self.scale, -8, 8))[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = layers
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c[0]


def _gradient(layers: list[np.ndarray], x: np.ndarray, hidden: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    inner = np.outer(by, layers[2]) * (1 - hidden**2)
    return [x.T @ inner, inner.sum(0), hidden.T @ by, np.array([by.sum()])]


def _adam(layers: list[np.ndarray], steps: int, gradient) -> None:
    m, v = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    for t in range(1, steps + 1):
        for i, g in enumerate(gradient(t)):
            g = g + 1e-4 * layers[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            layers[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def _start(width: int) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    return [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives in the unlabelled.

    A classifier of positive against unlabelled is fitted on one half of each; on the other half, for each
    threshold, the unlabelled's share above it over the positives' bounds the prior from above, up to noise
    that is added as a confidence term; the least bound is an estimate. The halves then change places, and the lower
    of the two estimates is taken.
    """
    return min(_bound(pos[::2], unl[::2], pos[1::2], unl[1::2]), _bound(pos[1::2], unl[1::2], pos[::2], unl[::2]))


def _bound(pos: np.ndarray, unl: np.ndarray, pos_after: np.ndarray, unl_after: np.ndarray) -> float:
    layers = _start(pos.shape[1])
    x = np.vstack([pos, unl])
    y = np.r_[np.ones(len(pos)), np.zeros(len(unl))]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))

    def gradient(_t: int) -> list[np.ndarray]:
        hidden, z = _forward(layers, x)
        return _gradient(layers, x, hidden, weight * (_sigmoid(z) - y))

    if not len(pos) or not len(unl) or not len(pos_after) or not len(unl_after):
        return 0.5
    _adam(layers, EPOCHS // 2, gradient)
    p, u = (np.sort(_forward(layers, a)[1]) for a in (pos_after, unl_after))
    at = np.quantile(p, np.linspace(0, 0.95, 96))
    above = lambda a: 1 - np.searchsorted(a, at) / len(a)
    noise = np.sqrt(np.log(200) / (2 * len(u))) + np.sqrt(np.log(200) / (2 * len(p)))
    bound = (above(u) + noise) / np.maximum(above(p), 1e-9)
    best = int(np.argmin(bound))
    return float(np.clip(above(u)[best] / above(p)[best], 0.05, 0.98))


def risk_of(layers: list[np.ndarray], pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """Non-negative unbiased risk, its part for the negatives (before it is cut at 0), and the gradient to step down along.

    Where that part is below 0 the step climbs it back instead: the unlabelled are overfitted.
    """
    (hp, zp), (hu, zu) = _forward(layers, pos), _forward(layers, unl)
    sp, su = _sigmoid(zp), _sigmoid(zu)
    negative = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    risk = float(prior * np.logaddexp(0, -zp).mean()) + max(0.0, negative)
    if negative >= 0:
        by_p, by_u = prior * (sp - 1) / len(zp) - prior * sp / len(zp), su / len(zu)
    else:
        by_p, by_u = prior * sp / len(zp), -su / len(zu)
    return risk, negative, [a + b for a, b in zip(_gradient(layers, pos, hp, by_p), _gradient(layers, unl, hu, by_u), strict=True)]


def fit(pos: np.ndarray, unl: np.ndarray) -> Model:
    """Non-negative PU risk with the logistic loss. Without positives or unlabelled, every score is one half."""
    width = len(FEATURES)
    if not len(pos) or not len(unl):
        return Model(np.zeros(width), np.ones(width), [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], 0.5)
    mean, scale = unl.mean(0), np.maximum(unl.std(0), 1e-6)
    pos, unl = (np.clip((a - mean) / scale, -8, 8) for a in (pos, unl))
    prior = estimate_prior(pos, unl)
    layers = _start(width)
    best: list = [np.inf, None]

    def gradient(t: int) -> list[np.ndarray]:
        risk, _, by = risk_of(layers, pos, unl, prior)
        if t > EPOCHS // 2 and risk < best[0]:
            best[:] = [risk, [a.copy() for a in layers]]
        return by

    _adam(layers, EPOCHS, gradient)
    return Model(mean, scale, best[1] or layers, prior)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fits on rows outside the held-out fold: labelled good ones, and any, whose labels are not looked at.

    Rows with null ids are in no fold and are not learned from. Repeated labels of an id count once; of repeated ids
    the row of the least features is learned from. Without labels or rows every score is one half.
    """
    learn = fold(F.col("id")) != HELD_OUT
    good = labels.select(F.col("doc_id").alias("id"), "quality").filter(learn & (F.col("quality") == 1)).select("id").distinct()
    some = docs.select(col(doc_id).alias("id")).filter(learn).distinct()
    order = lambda seed: (F.xxhash64(F.lit(seed), "id"), F.col("id"))
    good = good.orderBy(*order(1)).limit(POSITIVES).withColumn("kind", F.lit(1))
    some = some.orderBy(*order(2)).limit(UNLABELLED).withColumn("kind", F.lit(0))
    picked = good.unionByName(some).groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    # At most POSITIVES + UNLABELLED ids: a proven bound.
    sample = rows.join(F.broadcast(picked), rows["doc_id"] == picked["id"], "left_semi")
    # One row an id, whatever its repeats, so what is collected has the same bound.
    one = featured(sample).groupBy("doc_id").agg(F.min("features").alias("features"))
    found = sorted(one.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("doc_id", "features", "kinds").collect(), key=lambda r: r["doc_id"])
    of = lambda kind: np.array([r["features"] for r in found if kind in r["kinds"]]).reshape(-1, len(FEATURES))
    return fit(of(1), of(0))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on, a tie with it too).

    Null texts are empty ones; a row with a null id is not held out. Texts of any length are read whole. Repeated rows
    score alike; an empty table gives an empty result; other columns aren't read.
    """

    @F.pandas_udf("double")
    def score(features):
        import pandas as pd

        return pd.Series(model.scores(np.stack(features.to_numpy())) if len(features) else [], dtype="float64")

    rows = featured(docs, doc_id, text).withColumn("score", score("features"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their columns, whatever their names. Null texts are empty ones."""
    names = docs.columns
    own = f"c{names.index(text)}"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own):
                x = np.array([features_of(t.as_py() or b"") for t in part.column(own).cast(pa.binary())])
                yield part.filter(pa.array(model.scores(x) >= THRESHOLD))

    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return rows.mapInArrow(keep, rows.schema).toDF(*names)
