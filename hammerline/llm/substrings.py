"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Each task hashes all windows of its documents and keeps, per batch, one claim a window hash: that of
the smallest document (a map-side combine, so a passage in a third of the corpus costs one claim a
batch; windows of the batch's other documents are decided there). Claims travel as packed arrays to
a range of the hash space, where the smallest document of each hash is found. Starts that lose travel,
packed again, to a bucket of documents and merge there into one row of maximal removal intervals a document.

Claims carry 56 bits of each hash besides those that the target range tells: at w windows a false
removal has a chance of about w / (2**56 * ranges) a window. Edge cases: null or empty text has no word and
nothing to remove; documents shorter than a window lose nothing; repeated rows of one id never
remove each other; equal ids with different texts are kept apart by a hash of the text; rows
with a null id are never a source of removals and lose nothing; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingPowers, WordHashes, lean, mix64, partitions

#: Text characters hashed together in a task, and text characters that one target range gets on average.
BATCH_CHARS, RANGE_CHARS = 6_000_000, 8_000_000
KEPT = 7  # bytes of a window's place in its range


def _blocks(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch in blocks of a bounded number of characters."""
    columns, rows, size = [b.column(n) for n in names], [], 0
    for row in zip(*columns, strict=True):
        row = [x.as_py() for x in row]
        rows.append(row)
        size += len(row[-1] or b"")
        if size >= BATCH_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _packed(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, cuts: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Documents, their keys, their numbers of places, and the places as byte planes of their steps;
    ``cuts`` are where the next document begins."""
    begins = np.concatenate(([0], cuts)).astype(np.int64)
    steps = np.diff(places.astype(np.int64), prepend=0)
    steps[cuts] = places[cuts]
    return ids[begins].tobytes(), keys[begins].tobytes(), np.diff(np.append(begins, len(places))).astype("<u4").tobytes(), steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _claims(width: int, ranges: int):
    schema = ["range", "ids", "keys", "counts", "places", "hashes", "lost"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = WordHashes(), RollingPowers()
        step = -(-(1 << 64) // ranges)
        for b in batches:
            for rows in _blocks(b, "_id", "_key", "_text"):
                rows.sort(key=lambda r: r[0])
                hashes, sizes = [], []
                for _, _, text in rows:
                    hashes.append(powers.windows(words.of(text.split()), width))
                    sizes.append(len(hashes[-1]))
                words.trim()
                every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
                if not len(every):
                    continue
                del hashes
                row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
                place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
                ids, keys = (np.asarray([r[i] for r in rows], np.int64) for i in (0, 1))
                order = np.argsort(every, kind="stable")
                ordered = every[order]
                first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
                del ordered
                by_hash = row[order]  # documents ascend within a hash: the first has the smallest id
                owner = np.repeat(by_hash[first], np.diff(np.append(first, len(order))))
                loses = np.zeros(len(order), bool)
                loses[order] = ids[by_hash] > ids[owner]
                del order, first, by_hash, owner
                out: dict[str, list] = {k: [] for k in schema}

                def put(range_: int, at: np.ndarray, lost: bool, row=row, place=place, ids=ids, keys=keys, every=every, out=out) -> None:
                    """One row of claims, or of starts that are already lost, of documents in order."""
                    packed = b"" if lost else (every[at] - np.uint64(range_ * step)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()
                    of = row[at]
                    for k, v in zip(schema, (range_, *_packed(ids[of], keys[of], place[at], np.flatnonzero(np.diff(of)) + 1), packed, lost), strict=True):
                        out[k].append(v)

                target = (every // np.uint64(step)).astype(np.int32)
                mine = np.flatnonzero(~loses)
                mine = mine[np.argsort(target[mine], kind="stable")]
                for at in np.split(mine, np.flatnonzero(np.diff(target[mine])) + 1):
                    if len(at):
                        put(int(target[at[0]]), at, False)
                gone = np.flatnonzero(loses)
                if len(gone):
                    put(int(every[gone[0]] % np.uint64(ranges)), gone, True)
                yield pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in schema[1:6]), pa.array(out["lost"], pa.bool_())], schema)

    return run, "range long, ids binary, keys binary, counts binary, places binary, hashes binary, lost boolean"


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document of each claim, its key and its place in the document."""
    counts = np.frombuffer(row["counts"], "<u4")
    steps = np.frombuffer(row["places"], np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    total = np.cumsum(steps)
    starts = np.cumsum(counts, dtype=np.int64) - counts
    place = total - np.repeat(total[starts] - steps[starts], counts)
    return np.repeat(np.frombuffer(row["ids"], np.int64), counts), np.repeat(np.frombuffer(row["keys"], np.int64), counts), place


def _decide(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """Starts of one range that a smaller document owns: a row a bucket of documents."""
        ids, keys, places, hashes, lost = [], [], [], [], []
        for row in table.to_pylist():
            i, k, p = _opened(row)
            if row["lost"]:
                lost.append((i, k, p))
                continue
            wide = np.zeros((len(i), 8), np.uint8)
            wide[:, :KEPT] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, KEPT)
            ids.append(i), keys.append(k), places.append(p), hashes.append(wide.view("<u8").ravel())
        if ids:
            i, k, p, h = (np.concatenate(x) for x in (ids, keys, places, hashes))
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            least = np.minimum.reduceat(i[order], first)
            gone = order[i[order] > np.repeat(least, np.diff(np.append(first, len(order))))]
            lost.append((i[gone], k[gone], p[gone]))
        i, k, p = (np.concatenate(x) for x in zip(*lost, strict=True)) if lost else (np.empty(0, np.int64),) * 3
        bucket = (mix64(i.view(np.uint64) ^ k.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((p, k, i, bucket))
        i, k, p, bucket = i[order], k[order], p[order], bucket[order]
        rows = []
        for at in np.split(np.arange(len(i)), np.flatnonzero(np.diff(bucket)) + 1) if len(i) else []:
            rows.append((int(bucket[at[0]]), *_packed(i[at], k[at], p[at], np.flatnonzero((np.diff(i[at]) != 0) | (np.diff(k[at]) != 0)) + 1)))
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *(pa.binary(),) * 4), strict=True)], ["bucket", "ids", "keys", "counts", "places"])

    return run, "bucket long, ids binary, keys binary, counts binary, places binary"


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        """A row a document of one bucket: its lost windows as maximal intervals [start, end)."""
        i, k, p = (np.concatenate(x) for x in zip(*(_opened(row) for row in table.to_pylist()), strict=True))
        order = np.lexsort((p, k, i))
        i, k, p = i[order], k[order], p[order]
        other = (np.diff(i) != 0) | (np.diff(k) != 0)
        begins = np.flatnonzero(np.concatenate(([True], other | (np.diff(p) > width))))
        ends = np.append(begins[1:], len(p)) - 1
        spans = np.stack((p[begins], p[ends] + width), 1).astype("<u4")
        i, k = i[begins], k[begins]
        cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(k) != 0)) + 1
        first = np.concatenate(([0], cuts)).astype(np.int64)
        return pa.table({"_id": pa.array(i[first], pa.int64()), "_key": pa.array(k[first], pa.int64()), "_spans": pa.array([x.tobytes() for x in np.split(spans, cuts)], pa.binary())})

    return run, "_id long, _key long, _spans binary"


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _n_words, _n_removed, _kept_text: words covered by a window whose sequence also
    starts in a document of smaller id are removed; kept words are joined by one space."""
    spark, fields = docs.sparkSession, docs.schema.names
    id_col, text_col = f"c{fields.index(id_col)}", f"c{fields.index(text_col)}"
    docs = docs.toDF(*[f"c{i}" for i in range(len(fields))])  # names of other columns can't meet those used here
    chars = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(2 * partitions(spark), -(-chars // RANGE_CHARS))
    keyed = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_key", F.xxhash64(F.col(text_col)))
    run, schema = _claims(width, ranges)
    claims = keyed.where(F.col("_id").isNotNull() & F.col(text_col).isNotNull()).select("_id", "_key", F.col(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)
    lost = claims.groupBy("range").applyInArrow(*_decide(ranges)).groupBy("bucket").applyInArrow(*_merge(width))
    names, at = docs.columns, docs.columns.index(text_col)

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, removed, texts = [], [], []
            for text, spans in zip(b.column(at).cast(pa.binary()), b.column("_spans"), strict=True):
                words = (text.as_py() or b"").split()
                n, gone = len(words), 0
                if spans.is_valid:
                    change = np.zeros(n + 1, np.int32)
                    begins, ends = np.frombuffer(spans.as_py(), "<u4").reshape(-1, 2).T
                    change[begins] += 1
                    change[ends] -= 1
                    keep = np.cumsum(change[:n]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    gone = n - len(words)
                counts.append(n), removed.append(gone), texts.append(b" ".join(words))
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), kept], [*names, "_n_words", "_n_removed", "_kept_text"])

    joined = keyed.join(lost, ["_id", "_key"], "left").select(*[F.col(f"`{c}`") for c in names], "_spans")
    added = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_kept_text", T.StringType())]
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *added])).toDF(*fields, *[f.name for f in added])
