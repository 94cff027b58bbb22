"""Lempel-Ziv phrase fingerprints: LZ78 phrases of a text, hashed as a set, as a minimum-hash signature.

The likeness of two fingerprints is the share of equal places and estimates the Jaccard similarity of
their phrase sets. A text and an edit that keeps its head share the parse of that head, so it is
parsed once and both tails continue from the same dictionary.

Edge cases: a null text counts as empty; an empty text has the fingerprint of no phrase (all ones),
and two empty texts have likeness 1; the next document of the last is the first, and a single
document is its own next; equal ids are ordered by a hash of their text; rows with a null id come
first, ordered likewise; a frequent id and null ids are dealt over parts by that hash (equal texts of
an id stay together); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingPowers, mix64, partitions

PLACES = 64  # minimum hashes a fingerprint, 16 bits each
NONE = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
_FACTORS = mix64(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def parse(text: str, known: set[str], pending: str = "") -> tuple[list[int], str]:
    """Ends of the LZ78 phrases that begin in ``text`` (after ``pending``) and the unfinished phrase."""
    ends, phrase, add = [], pending, known.add
    for at, c in enumerate(text, 1):
        phrase += c
        if phrase not in known:
            add(phrase)
            ends.append(at)
            phrase = ""
    return ends, phrase


class Fingerprinter:
    def __init__(self) -> None:
        self.powers = RollingPowers()

    def _least(self, text: str, ends: list[int], first: int) -> np.ndarray:
        """Minimum hashes of the phrases that end at ``ends``; the first begins at ``first``."""
        if not ends:
            return NONE
        codes = mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))
        stops = np.asarray(ends)
        starts = np.concatenate(([first], stops[:-1]))
        hashes = self.powers.spans(codes, starts, stops) + (stops - starts).astype(np.uint64)
        least = NONE.copy()
        for at in range(0, len(hashes), 4096):
            np.minimum(least, (hashes[at : at + 4096, None] * _FACTORS[None, :]).min(axis=0), out=least)
        return least

    def __call__(self, text: str, edited: str | None = None, shared: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
        """Signatures of ``text`` and of ``edited``, which has the first ``shared`` characters in common."""
        known: set[str] = set()
        head, pending = parse(text[:shared], known)
        base = self._least(text[:shared], head, 0)
        twin = known.copy() if edited is not None else known

        def tail(whole: str, seen: set[str]) -> np.ndarray:
            first = shared - len(pending)
            ends, rest = parse(whole[shared:], seen, pending)
            ends = [x + shared - first for x in ends]
            part = whole[first:]
            if rest:
                ends.append(len(part))
            return np.minimum(base, self._least(part, ends, 0))

        own = tail(text, known)
        return own, None if edited is None else tail(edited, twin)


def packed(signature: np.ndarray) -> str:
    return (mix64(signature) >> np.uint64(48)).astype("<u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    x, y = np.frombuffer(bytes.fromhex(a), "<u2"), np.frombuffer(bytes.fromhex(b), "<u2")
    return float((x == y).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(make(t.as_py() or "")[0]) for t in b.column(1)], pa.string())], ["_id", "fingerprint"])

    key = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {key}, fingerprint string").withColumnRenamed("_id", id_col)


def in_order(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """Rows dealt by ranges of (id, hash of the text), each range followed by a guest: the first row of
    the next range (after the last range: of the first). Only one row a range crosses over, and a
    range's first row is found from ids and hashes alone."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    shares = [i / parts for i in range(1, parts)]
    cut = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), *([F.percentile_approx("id", shares, 20 * parts).alias("cuts")] if shares else [])).first()
    bounds = np.asarray((cut["cuts"] if shares else None) or [], np.int64)  # one a part; a frequent id stands here several times
    for_nulls = min(parts, -(-parts * cut["nulls"] // max(1, cut["n"])))
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, known: pd.Series, ties: pd.Series) -> pd.Series:
        """Null ids come first, in ``for_nulls`` parts; an id that fills several ranges has a part of each hash range."""
        own, known, cuts = ids.to_numpy(), known.to_numpy(), shared.value
        low, high = np.searchsorted(cuts, own, "left"), np.searchsorted(cuts, own, "right")
        steps = np.where(known, np.maximum(high - low, 1), max(for_nulls, 1))
        place = ((ties.to_numpy().astype(np.int64) >> np.int64(32)) + (1 << 31)) * steps >> 32
        # the rows before an id's first bound share a part with the rows of the bound before, as those after its last
        within = np.where(high > low, low + 1 + place, low)
        return pd.Series(np.where(known, for_nulls + within, place).astype(np.int32))

    dealt = rows.withColumn("part", part_of(F.coalesce("id", F.lit(0)), F.col("id").isNotNull(), F.col("tie")))
    at = F.struct(F.col("id").isNotNull().alias("known"), F.col("id"), F.col("tie"))
    firsts = [(r["part"], r["first"]["id"], r["first"]["tie"]) for r in dealt.groupBy("part").agg(F.min(at).alias("first")).orderBy("part").collect()]  # one row a range
    if not firsts:
        return dealt.withColumn("guest", F.lit(False)).limit(0)
    keys = [(p, i, t, firsts[k - 1][0]) for k, (p, i, t) in enumerate(firsts)]
    small = spark.createDataFrame(keys, "part int, first long, least long, before int")  # one row a range
    heads = dealt.join(F.broadcast(small), "part").where(F.col("id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("least"))).groupBy("part", "before").agg(F.min("text").alias("text"), F.first("first").alias("id"), F.first("tie").alias("tie"))
    guests = heads.select("id", "text", "tie", F.col("before").alias("part"), F.lit(True).alias("guest"))
    return dealt.select("id", "text", "tie", "part", F.lit(False).alias("guest")).union(guests)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit (last quarter replaced by the head of the next
    document), the likeness of both, and the likeness to the next document's fingerprint."""
    parts = max(4 * partitions(docs.sparkSession), 1)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is finished when its follower's fingerprint is known: one row is carried along."""
        make, held = Fingerprinter(), None
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for i, text, part, guest in zip(b.column("id").to_pylist(), b.column("text"), b.column("part").to_pylist(), b.column("guest").to_pylist(), strict=True):
                text = text.as_py()
                if held is not None and held[1] == part:
                    _, _, before, waiting = held
                    n, cut = len(before), len(before) // 4
                    edited = before[: n - cut] + text[:cut]
                    own, other = make(before, edited, n - cut)
                    a, e = packed(own), packed(other)
                    if waiting is not None:
                        waiting[6] = likeness(waiting[3], a)
                        for column, x in zip(out, waiting, strict=True):
                            column.append(x)
                    waiting = [held[0], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, e, likeness(a, e), None]
                    if guest:
                        waiting[6] = likeness(a, packed(make(text)[0]))
                        for column, x in zip(out, waiting, strict=True):
                            column.append(x)
                        waiting = None
                else:
                    waiting = None
                held = None if guest else (i, part, text, waiting)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    rows = in_order(docs, id_col, text_col, parts)
    rows = rows.repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "guest", "id", "tie", "text")
    done = rows.mapInArrow(compared, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumnRenamed("id", id_col)
