"""Near-duplicate classes: MinHash bands for candidates, odd sketches to sift them, exact sets to confirm.

One pass turns every document into a row of fixed size (set size, set digest, band keys, odd sketch).
Equal sets collapse to one representative, so copies never meet pair by pair. Within a band bucket
the XOR population counts of odd sketches say which representatives may be similar; a bucket hands on
a spanning forest of that graph, never its pairs. Components of the forests are the families. The
shingle sets of a family travel once and meet in one task (or, for a family with more than
FAMILY_SHINGLES, in tasks for pairs of its blocks), which confirms links on the full sets with an
inverted list and hands on a spanning forest of the links. Components of these are the answer: a link
is left out only where others connect its ends. Nothing is capped; a pair at similarity 0.8 shares
no bucket with probability 8e-7, and its estimate falls short of the slack at five standard errors.

Edge cases: a null text, or one without words, has an empty set, size 0, and is its own component;
fewer words than a shingle make one shingle of the whole sequence; rows that share an id count as one
document, whose set is the one of smallest digest, and have its component; rows with a null id keep a
null component and are not linked; ties go to the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingPowers, WordHashes, lean, mix64, partitions, written

BANDS, ROWS, BITS = 46, 6, 1024
#: Pairs whose estimate is this far below the threshold are dropped: about five standard errors of the sketch.
SLACK = 0.16
#: Representatives of a bucket compared in one task; larger buckets are dealt out as pairs of blocks.
BLOCK = 4096
#: Shingles of a family that one task holds; larger families are dealt out as pairs of blocks.
FAMILY_SHINGLES = 1 << 21
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int) -> None:
        self.width, self.words, self.powers = width, WordHashes(), RollingPowers()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        self.words.trim()
        hashes = self.words.of(words)
        return np.unique(self.powers.windows(hashes, min(self.width, len(words))) + np.uint64(min(self.width, len(words)) < self.width))


def _coefficients() -> np.ndarray:
    return (mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each of the hash functions; 32-bit products, which the processor takes in vectors."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(folded), 512):
        np.minimum(least, (folded[at : at + 512, None] * factors[None, :]).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (position, minimum) samples as 64-bit words."""
    n = len(samples)
    at = mix64(samples.astype(np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)
    bits = np.bincount(at.astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def estimate(differing: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """Similarity from the number of set bits of the XOR of two odd sketches."""
    share = np.minimum(2 * differing / BITS, 0.999)
    return 1 + BITS / (4 * samples) * np.log(1 - share)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest, bands (array<long>), sketch: one narrow row a document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, factors = Shingler(width), _coefficients()
        mixers = mix64(np.arange(ROWS, dtype=np.uint64) + np.uint64(17)) | np.uint64(1)
        for b in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for text in b.column("_text"):
                s = shingles(text.as_py())
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                least = minima(s, factors).astype(np.uint64)
                digests.append(hashlib.md5(s.tobytes()).digest())
                rows = mix64(least).reshape(BANDS, ROWS)
                keys = mix64((rows * mixers[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                bands.append(keys.view(np.int64))
                sketches.append(odd_sketch(least).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "n_shingles", "digest", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables that hold whole runs of equal keys, with the limits of the runs; the input is sorted by them."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = np.asarray(t[k])
            change |= v[1:] != v[:-1]
        cuts = (np.flatnonzero(change) + 1).tolist()
        if cuts:
            yield t.slice(0, cuts[-1]), [0, *cuts]
            held = t.slice(cuts[-1])
        else:
            held = t
    if held is not None:
        yield held, [0, held.num_rows]


def forest(n: int, side: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n nodes, by breadth-first search. ``linked(i, others)``: mask of
    the neighbours of i. Side 1 meets only side 2 and the other way round, side 0 all."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            may = left if side[i] == 0 else left[side[left] != side[i]]
            near = may[linked(i, may)] if len(may) else may
            if len(near):
                edges += [(i, int(j)) for j in near]
                queue += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return edges


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])


def _similar(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning forests of the sketch graph of each bucket block."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["bucket", "i", "j"]):
            ids, side = np.asarray(t["id"]), np.asarray(t["side"])
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            starts, sizes = np.asarray(cuts[:-1]), np.diff(cuts)
            two = starts[sizes == 2]
            near = estimate(np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int64)) >= least
            near &= (side[two] == 0) | (side[two] != side[two + 1])
            a, b = [ids[two[near]]], [ids[two[near] + 1]]
            for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = sketch[at : at + n]
                found = forest(n, side[at : at + n], lambda i, others, own=own: estimate(np.bitwise_count(own[others] ^ own[i]).sum(axis=1, dtype=np.int64)) >= least)
                if found:
                    x, y = np.asarray(found).T
                    a.append(ids[at + x]), b.append(ids[at + y])
            yield _edges(a, b)

    return run


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spanning forests of the links of each family block: 100 * intersection >= percent * union on full sets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in whole_runs(batches, ["family", "i", "j"]):
            a, b = [], []
            every_id, every_side = np.asarray(t["id"]), np.asarray(t["side"])
            for at, end in zip(cuts, cuts[1:], strict=False):
                ids, side, n = every_id[at:end], every_side[at:end], end - at
                sets = [np.frombuffer(x, np.uint64) for x in t["shingles"].slice(at, n).to_pylist()]
                sizes = np.asarray([len(x) for x in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
                _, code = np.unique(flat, return_inverse=True)
                order = np.argsort(code, kind="stable")
                posting, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
                begins = np.concatenate(([0], np.cumsum(sizes)))

                def linked(i: int, others: np.ndarray, code=code, posting=posting, first=first, begins=begins, sizes=sizes, n=n) -> np.ndarray:
                    mine = code[begins[i] : begins[i + 1]]
                    lengths = first[mine + 1] - first[mine]
                    spots = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
                    both = np.bincount(posting[spots], minlength=n)[others]
                    return 100 * both >= percent * (sizes[i] + sizes[others] - both)

                found = forest(n, side, linked)
                if found:
                    x, y = np.asarray(found).T
                    a.append(ids[x]), b.append(ids[y])
            yield _edges(a, b)

    return run


def _block_pairs(rows: DataFrame, blocks: str, key: str) -> DataFrame:
    """Rows with (i, j, side): one pair of blocks each if there is one block, else a row for each pair
    that the own block is part of; every two rows of a key meet in some pair."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")).withColumn("other", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", side).drop("own", "other", blocks)
    return dealt.repartition(partitions(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j")


def shrink(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): smallest reachable id, by repeated hooking of
    roots onto smaller neighbours and pointer jumping, a written table each round."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        ends = edges.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
        hooks = ends.where("ca <> cb").select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to"))
        jumps = labels.select(F.col("id").alias("root"), F.col("component").alias("to")).where("root <> to")
        best = written(hooks.union(jumps).groupBy("root").agg(F.min("to").alias("to")), "hooks")
        changed = labels.join(best, labels.component == best.root, "left").select("id", F.least("component", F.coalesce("to", "component")).alias("component"), (F.col("to") < F.col("component")).alias("moved"))
        labels = written(changed, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("id", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: one row a row of ``docs``."""
    spark = docs.sparkSession
    signed = written(signatures(docs, width, id_col, text_col), "signatures")
    linked = signed.where("digest is not null and id is not null")
    repeated = written(linked.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("last")).where("digest < last").drop("last"), "repeated")
    several = not repeated.isEmpty()
    if several:  # the other sets of an id are no document
        linked = linked.join(repeated.select("id", F.col("digest").alias("own")), "id", "left").where("own is null or digest = own").drop("own")
    groups = written(linked.groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("most"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "groups")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose bucket has another row; the input is sorted by bucket."""
        last_key, last_id, told = None, None, True
        for b in batches:
            keys, ids = np.asarray(b.column("bucket")), np.asarray(b.column("id"))
            if not len(keys):
                continue
            same_before = np.concatenate(([last_key is not None and keys[0] == last_key], keys[1:] == keys[:-1]))
            keep = same_before.copy()
            keep[:-1] |= same_before[1:]
            if same_before[0] and not told:
                yield pa.RecordBatch.from_arrays([pa.array([last_key], pa.int64()), pa.array([last_id], pa.int64())], ["bucket", "id"])
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep])], ["bucket", "id"])
            last_key, last_id, told = int(keys[-1]), int(ids[-1]), bool(keep[-1])

    members = groups.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id")).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    members = written(members.mapInArrow(shared, "bucket long, id long"), "members")
    counts = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sketched = members.join(groups.select(F.col("rep").alias("id"), "sketch"), "id").join(counts, "bucket")
    near = _block_pairs(sketched.select("bucket", "id", "sketch", "blocks"), "blocks", "bucket").mapInArrow(_similar(percent / 100 - SLACK), "a long, b long")
    families = shrink(written(near.distinct(), "near"))

    @lean
    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for b in batches:
            sets = [shingles(t.as_py()).tobytes() for t in b.column("_text")]
            out = pa.RecordBatch.from_arrays([b.column("id"), b.column("family"), b.column("blocks"), pa.array(sets, pa.binary())], ["id", "family", "blocks", "shingles"])
            if several:
                out = out.filter(pa.array([hashlib.md5(x).digest() == d for x, d in zip(sets, b.column("digest").to_pylist(), strict=True)], pa.bool_()))
            yield out

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("_text"))
    reps = groups.select(F.col("rep").alias("id"), "n_shingles", "digest")
    sizes = families.join(reps, "id").groupBy("component").agg(F.ceil(F.sum("n_shingles") / FAMILY_SHINGLES).alias("blocks"))
    named = families.join(sizes, "component").select("id", F.col("component").alias("family"), "blocks")
    named = written(named.join(reps.select("id", "digest"), "id") if several else named, "families")  # narrow, so that it stays a broadcast as long as it may
    sets = texts.join(named, "id").mapInArrow(full_sets, "id long, family long, blocks long, shingles binary")
    links = _block_pairs(sets, "blocks", "family").mapInArrow(_confirmed(percent), "a long, b long")
    labels = shrink(written(links.distinct(), "links"))
    own = groups.join(labels, groups.rep == labels.id, "left").select("digest", "rep", "most", F.coalesce("component", "rep").alias("class"))
    # a digest of a third of the rows is split by salts; the repeated side holds only digests that change a row
    salts = 16
    classes = written(own.where("most > rep or class < rep").select("digest", "class"), "classes").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = signed.select("id", "n_shingles", "digest")
    if several:
        every = every.join(repeated.select("id", F.col("digest").alias("own")), "id", "left").select("id", "n_shingles", F.coalesce("own", "digest").alias("digest"))
    result = every.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(classes, ["digest", "salt"], "left")
    result = result.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("component_id"))
    return result.withColumn("kept", F.col(id_col) == F.col("component_id"))
