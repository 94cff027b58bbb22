"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the
categories before it, taken out of fold when it is fitted.

Features are the presence of words (lower case, outer punctuation off) and of token shapes, hashed.
The models are fitted on a bounded sample of labelled rows (``SAMPLE`` rows, those of smallest id
hash); scoring covers every document and the whole of its text.

Edge cases: null or empty text scores the base rate and is never flagged; a category with one class
among the labels (or none) is the constant base rate (or 0) and flags nothing; several label rows of
an id count as one with the larger values, null labels as unknown; ids without a document are
ignored; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, FEATURES, FOLDS, LEAST_DOCS = 12_000, 512, 5, 4
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-Z]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+")


class Tokens(dict):
    """Token to the hashes of its word and shape; bounded."""

    def __missing__(self, token: str) -> tuple[int, int]:
        word = token.strip("\"'.,;:!?()[]{}<>*#$%&|-_").lower()
        shape = _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", token)))
        if len(self) > 400_000:
            self.clear()
        found = self[token] = (xxhash.xxh32_intdigest(word.encode()), xxhash.xxh32_intdigest(shape.encode(), 1))
        return found


def hashed(tokens: Tokens, text: str | None) -> np.ndarray:
    """Sorted distinct feature hashes of a text."""
    found = [tokens[t] for t in set((text or "").split())]
    return np.unique(np.asarray(found, np.uint32)) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """Weights by feature hash, of the chain's earlier probabilities, and the flagging threshold."""

    weights: dict[int, float]
    chain: list[float]
    bias: float
    threshold: float

    def score(self, features: np.ndarray, earlier: list[float]) -> float:
        z = self.bias + sum(self.weights.get(int(x), 0.0) for x in features) + sum(w * p for w, p in zip(self.chain, earlier, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 150) -> np.ndarray:
    """Ridge-penalised logistic regression by accelerated gradient steps; the last weight is the bias."""
    n = len(y)
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    step = 4 / (np.linalg.norm(x, axis=0) ** 2).sum() * min(x.shape[1], 20)
    w = np.zeros(x.shape[1], x.dtype)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    pull = np.full(x.shape[1], penalty, x.dtype)
    pull[-1] = 0

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (pull * v * v).sum())

    for _ in range(rounds):
        grad = x.T @ (1 / (1 + np.exp(-(x @ ahead))) - y) + pull * ahead
        base, square = loss(ahead), float(grad @ grad)
        while loss(ahead - step * grad) > base - 0.5 * step * square and step > 1e-12:
            step /= 2
        new = ahead - step * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
        step *= 1.1
    return w


def select(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Features of the largest chi-square statistic against the labels."""
    every = np.concatenate(rows) if rows else np.empty(0, np.uint32)
    mine = np.concatenate([r for r, v in zip(rows, y, strict=True) if v]) if y.any() else np.empty(0, np.uint32)
    features, total = np.unique(every, return_counts=True)
    hits = np.zeros(len(features))
    found, n = np.unique(mine, return_counts=True)
    hits[np.searchsorted(features, found)] = n
    size, positive = len(y), y.sum()
    expected = total * positive / size
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (hits - expected) ** 2 / np.maximum(expected * (1 - total / size) * (1 - positive / size), 1e-9)
    chi[total < LEAST_DOCS] = 0
    order = np.lexsort((features, -chi))[:most]
    return np.sort(features[order[chi[order] > 3.8]])


def matrix(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        out[i, np.searchsorted(features, r[np.isin(r, features, assume_unique=True)])] = 1
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of the largest F1 among out-of-fold probabilities, half way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits, at = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    f1 = np.where(last, 2 * hits / (at + y.sum()), 0)
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray) -> list[Model]:
    """One model a column of ``labels`` (0, 1, NaN unknown), in chain order."""
    models: list[Model] = []
    earlier = np.zeros((len(rows), 0), np.float32)
    fold = np.arange(len(rows)) % FOLDS
    for column in labels.T:
        known = ~np.isnan(column)
        y = np.where(known, column, 0)
        if known.sum() < 2 * FOLDS or y[known].min() == y[known].max():
            rate = float(y[known].mean()) if known.any() else 0.0
            models.append(Model({}, [0.0] * earlier.shape[1], float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), 1.1))
            out = np.full(len(rows), rate, np.float32)
        else:
            out = np.zeros(len(rows), np.float32)
            for k in [*range(FOLDS), None]:
                use = np.flatnonzero(known & (fold != k)) if k is not None else np.flatnonzero(known)
                if y[use].min() == y[use].max():
                    out[fold == k] = y[use].mean()
                    continue
                features = select([rows[i] for i in use], y[use], FEATURES)
                x = np.hstack([matrix([rows[i] for i in use], features), earlier[use]])
                w = fit_linear(x, y[use].astype(np.float32))
                if k is None:
                    weights = dict(zip(map(int, features), map(float, w), strict=False))
                    models.append(Model(weights, [float(v) for v in w[len(features) : -1]], float(w[-1]), best_threshold(out[known].astype(float), y[known])))
                else:
                    rest = np.flatnonzero(fold == k)
                    z = np.hstack([matrix([rows[i] for i in rest], features), earlier[rest]]) @ w[:-1] + w[-1]
                    out[rest] = 1 / (1 + np.exp(-z))
        earlier = np.hstack([earlier, out[:, None].astype(np.float32)])
    return models


def train(docs: DataFrame, labels: DataFrame, chain: list[Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Model]:
    """Fits the chain on at most ``sample`` labelled documents; ``chain``: 0/1 columns of ``labels``."""
    names = [f"_c{i}" for i in range(len(chain))]
    known = labels.select(F.col(id_col).alias("_id"), *[c.cast("double").alias(n) for c, n in zip(chain, names, strict=True)]).where(F.col("_id").isNotNull())
    known = known.groupBy("_id").agg(*[F.max(n).alias(n) for n in names])
    # at most `sample` labelled ids, so the broadcast is bounded by that parameter
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            cells = pa.array([hashed(tokens, t.as_py()).tobytes() for t in b.column("_text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.int64()), *(b.column(n) for n in names), cells], ["_id", *names, "_f"])

    got = joined.select("_id", *names, "_text").mapInArrow(featured, "_id long, " + ", ".join(f"{n} double" for n in names) + ", _f binary").collect()
    got.sort(key=lambda r: (r["_id"], r["_f"]))
    rows = [np.frombuffer(r["_f"], np.uint32) for r in got]
    values = np.asarray([[np.nan if r[n] is None else r[n] for n in names] for r in got], float).reshape(len(got), len(names))
    return fit_chain(rows, values)


def predict(docs: DataFrame, models: list[Model], categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_<category> and <category> (flag) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most FEATURES weights a category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, tokens = shared.value, Tokens()
        wanted = {k for m in chain for k in m.weights}
        useful: dict[str, tuple[int, ...]] = {}
        for b in batches:
            probabilities, flags = [[] for _ in chain], [[] for _ in chain]
            for text in b.column("_text"):
                words = set((text.as_py() or "").split())
                found = set()
                for w in words:
                    u = useful.get(w)
                    if u is None:
                        if len(useful) > 400_000:
                            useful.clear()
                        u = useful[w] = tuple(h for h in tokens[w] if h in wanted)
                    if u:
                        found.update(u)
                earlier: list[float] = []
                features = np.fromiter(found, np.uint32, len(found))
                for m, p, f in zip(chain, probabilities, flags, strict=True):
                    earlier.append(m.score(features, earlier))
                    p.append(earlier[-1])
                    f.append(bool(words) and earlier[-1] >= m.threshold)
            cells = [x for p, f in zip(probabilities, flags, strict=True) for x in (pa.array(p, pa.float64()), pa.array(f, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *cells], ["_id", *(x for c in categories for x in (f"p_{c}", c))])

    key = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {key}, " + ", ".join(f"p_{c} double, {c} boolean" for c in categories)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
