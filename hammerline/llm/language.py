"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile is the ranking of a language's most frequent letter n-grams (one to four letters, word
ends included), counted over every training document. A document's own ranking is compared with
each profile by the sum of rank differences, a missing n-gram costing a whole profile length.
N-grams are 32-bit hashes, so that a text is counted without a Python loop.

Edge cases: null text and text without letters is ``und`` with score 0; with nothing to learn from,
every document is ``und``; languages at equal distance resolve to the smallest name; n-grams of
equal frequency are ranked by their hash; repeated rows count as often as they occur; rows with a
null language are never learnt from; input columns named lang_pred or score give way to the results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

LENGTHS = (1, 2, 3, 4)
PROFILE, MAX_LANGUAGES = 400, 500
#: Parts of a language's n-grams, each ranked on its own before the driver merges their heads.
SALTS = 8
#: N-gram counts that a training task holds before it adds them up.
HELD_GRAMS = 2_000_000
UNKNOWN = "und"


class Grams:
    """Distinct n-gram hashes of a text and their counts, most frequent first on request."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letters = self.letter[codes]
        if not letters.any():
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        marks = np.concatenate(([0], np.where(letters, codes, 0), [0])).astype(np.uint32)
        # runs of other characters shrink to one mark
        marks = marks[np.concatenate(([True], (marks[1:] != 0) | (marks[:-1] != 0)))]
        ends, every = marks == 0, []
        for n in LENGTHS:
            size = len(marks) - n + 1
            if size <= 0:
                continue
            h, inside = np.full(size, n, np.uint32), np.zeros(size, bool)
            for i in range(n):
                h = h * np.uint32(0x01000193) + marks[i : i + size] * np.uint32(0x9E3779B1)
                if n == 1 or 0 < i < n - 1:
                    inside |= ends[i : i + size]
            every.append((h ^ (h >> np.uint32(15)))[~inside])
        values = np.sort(np.concatenate(every))
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        return values[first], np.diff(np.append(first, len(values)))


def ranking(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by hash."""
    if len(grams) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:most]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of every non-null language in ``docs``; at most MAX_LANGUAGES of them."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, size = Grams(), defaultdict(list), 0

        def emitted() -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for lang, parts in held.items():
                g, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([x for _, x in parts])).astype(np.int64)
                langs += [lang] * len(g)
                grams.append(g), counts.append(n)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(grams).astype(np.int64)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                g, n = make(text.as_py())
                held[lang].append((g, n))
                size += len(g)
                if size > HELD_GRAMS:
                    yield emitted()
                    held.clear()
                    size = 0
        if size:
            yield emitted()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the head of a language is among the heads of its parts, so no task sorts a whole language
    salted = W.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    heads = totals.withColumn("salt", F.pmod("gram", F.lit(SALTS))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= profile)
    held: dict[str, list[tuple[int, int]]] = defaultdict(list)
    most = MAX_LANGUAGES * SALTS * profile
    for r in heads.select("lang", "gram", "n").limit(most + 1).collect():  # heads only; more languages raise
        held[r["lang"]].append((-r["n"], r["gram"]))
    if len(held) > MAX_LANGUAGES or sum(map(len, held.values())) > most:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {lang: [g for _, g in sorted(grams)[:profile]] for lang, grams in held.items()}


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.make, self.size, self.names, self.tables = Grams(), size, sorted(profiles), []
        for name in self.names:
            grams = np.asarray(profiles[name], np.uint32)
            order = np.argsort(grams)
            self.tables.append((grams[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranking(*self.make(text or ""), self.size) if self.names else np.empty(0, np.uint32)
        if not len(own):
            return UNKNOWN, 0.0
        place, costs = np.arange(len(own)), []
        for grams, rank in self.tables:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            costs.append(int(np.where(grams[at] == own, np.abs(rank[at] - place), self.size).sum()))
        best = int(np.argmin(costs))
        return self.names[best], 1 - costs[best] / (len(own) * self.size)


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score; every other column passes through."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # at most MAX_LANGUAGES * size numbers
    docs = docs.drop("lang_pred", "score")
    names, at = docs.columns, docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value, size)
        for b in batches:
            found = [classify(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
