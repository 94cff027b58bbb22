"""Best-fit packing of tokenised documents into fixed-capacity sequences by linear grouping.

The plan is made from the histogram of piece lengths alone (at most ``capacity`` rows, whatever the
corpus holds): large lengths are rounded up to the maximum of equal-cardinality groups, a
configuration linear programme over those few sizes is solved by column generation, actual lengths
replace the rounded ones, and every piece that is left goes to the tightest open sequence. Configured
sequences are kept as far as they cost no sequence more than best-fit decreasing. The plan is a list
of sequence classes with multiplicities; pieces meet it by their rank among pieces of equal length,
computed in salted cells so that one frequent length never lands in one task.

Edge cases: null text is tokenised as empty (one separator id); an empty table gives an empty
result; repeated rows are packed as often as they occur; ties between equal lengths are broken by
(id, piece, checksum); other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORKER_CACHES, partitions, released, written

#: Texts whose ids a worker remembers; a full cache is emptied.
CACHE_TEXTS = 250_000
#: Bytes of text that are taken apart at a time.
SLICE_BYTES = 2 << 20
#: A word and ASCII marks after it (no apostrophe, which the tokenizer may read as a contraction).
WORD_AND_MARKS = r"^(?P<word>\p{L}+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"


class ChunkEncoder:
    """Token ids of texts as one uint32 array.

    Blank-separated chunks are encoded independently, which equals encoding the whole text for a
    tokenizer that drops white space before its merges; a word and the marks after it likewise.
    Arrow splits the texts and numbers their distinct chunks, so that Python sees each chunk of a
    slice once; ids of words, marks and other chunks come from one bounded cache. New words are
    encoded in one go and told apart by the tokens that end a word, anything else on its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, texts: list[str]) -> None:
        for at in range(0, len(texts), 5000):
            some = texts[at : at + 5000]
            self.known.update(zip(some, (np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def _learn_words(self, new: list[str]) -> None:
        for at in range(0, len(new), 5000):
            some = new[at : at + 5000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and (not len(ids) or stops[-1] == len(ids)):
                data, begin = ids.tobytes(), 0
                for w, stop in zip(some, stops.tolist(), strict=True):
                    self.known[w] = data[4 * begin : 4 * stop]
                    begin = stop
            else:
                self._learn(some)

    def _ids(self, texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct texts one after another, and how many each has."""
        some, known = texts.to_numpy(zero_copy_only=False).tolist(), self.known
        (self._learn_words if words else self._learn)([x for x in some if x not in known])
        found = [known[x] for x in some]
        for x in some if not words else ():
            if len(x) > 64:
                known.pop(x, None)
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct chunks, whose words, marks and other forms recur."""
        if len(self.known) > CACHE_TEXTS:
            self.known.clear()
        plain = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
        split = pc.extract_regex(plain, WORD_AND_MARKS)
        told = split.is_valid()
        word, mark = (pc.if_else(told, split.field(i), pa.scalar(None, pa.string())).dictionary_encode() for i in (0, 1))
        other = pc.if_else(told, pa.scalar(None, pa.string()), plain).dictionary_encode()
        ids, sizes, codes = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], []  # text 0 has no ids
        for part, words in ((word, True), (mark, False), (other, False)):
            base = sum(map(len, sizes))
            codes.append(np.asarray(pc.fill_null(pc.add(part.indices.cast(pa.int64()), base), 0)))
            found = self._ids(part.dictionary, words)
            ids.append(found[0]), sizes.append(found[1])
        pairs = np.stack([codes[0] + codes[2], codes[1]], axis=1)  # word or other form, then marks
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        return gathered(ids, sizes, pairs.reshape(-1)), sizes[pairs].sum(axis=1)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text ends."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        chunks = parts.flatten().dictionary_encode()
        ids, sizes = self._of_chunks(chunks.dictionary)
        code = np.asarray(chunks.indices)
        last = np.cumsum(np.asarray(pc.list_value_length(parts))) - 1
        return gathered(ids, sizes, code), np.cumsum(sizes[code])[last]


def gathered(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` (of the given sizes) that the codes name, one after another."""
    size = sizes[codes]
    ends = np.cumsum(size)
    begin = (np.cumsum(sizes) - sizes)[codes] - (ends - size)
    return ids[np.repeat(begin, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, so that its cache outlives a task (but not a task of another operator)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
        WORKER_CACHES.append(_ENCODERS[path].known)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The texts in order, in runs of about ``most`` bytes; a longer text is a run of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    run = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield texts.slice(a, b - a)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Only longer documents are cut."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path), np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            i, out = 0, ([], [], [], [], [])
            for texts in slices(b.column(1)):
                ids, ends = encoder.batch(texts)
                for begin, stop in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                    whole = ids[begin:stop].tobytes() + end
                    for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        for column, x in zip(out, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
                    i += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["_id", "piece", "start", "length", "ids_crc32"])
        released()

    key_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(pieces, f"_id {key_type}, piece int, start long, length long, ids_crc32 long")


def configuration_programme(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Basic optimum of min sum(x), A x = demand over cutting patterns, by revised simplex with columns
    from an unbounded knapsack. Returns (patterns as columns, their multiplicities)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, price = inverse @ demand, inverse.sum(axis=0)
        best, chosen = np.zeros(capacity + 1), []  # best[c]: most worth in capacity c by as many sizes as rounds so far
        for _ in range(int(capacity // sizes.min())):
            more, pick = best.copy(), np.full(capacity + 1, -1)
            for j, size in enumerate(sizes):
                gain = best[: capacity + 1 - size] + price[j]
                better = gain > more[size:] + 1e-12
                more[size:][better], pick[size:][better] = gain[better], j
            best = more
            chosen.append(pick)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(chosen):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return basis, np.maximum(np.linalg.inv(basis) @ demand, 0)


Held = list[tuple[int, int]]  # (length, how many) of one sequence
Classes = list[tuple[Held, int]]  # sequences of one kind, number of sequences


def configured(histogram: dict[int, int], capacity: int, groups: int, large_share: float) -> tuple[Classes, dict[int, int]]:
    """Sequences of large pieces by linear grouping, and the pieces that the integral programme leaves.

    Rounded sizes say which groups meet in a sequence. Actual pieces replace them group by group, the
    longest first; in the last place stands the longest piece of any group that the real room takes."""
    left = {n: c for n, c in histogram.items() if c > 0}
    large = sorted((n for n in left if n > capacity * large_share), reverse=True)
    total = sum(left[n] for n in large)
    if not total:
        return [], left
    k = max(1, min(groups, total))
    members: list[list[int]] = [[] for _ in range(k)]  # lengths of each group, longest first
    demand, done = np.zeros(k), 0
    for n in large:
        first, last = done * k // total, (done + left[n] - 1) * k // total
        for g in range(first, last + 1):
            members[g].append(n)
            demand[g] += min(done + left[n], -(-(g + 1) * total // k)) - max(done, -(-g * total // k))
        done += left[n]
    told = [g for g in range(k) if demand[g] > 0]
    sizes = np.asarray([members[g][0] for g in told])
    distinct, at = np.unique(-sizes, return_inverse=True)  # groups of one size are one size
    need = np.bincount(at, demand[told])
    pools = [sorted({n for j, g in enumerate(told) if at[j] == i for n in members[g]}, reverse=True) for i in range(len(distinct))]
    patterns, x = configuration_programme(-distinct, need, capacity)
    every, classes = sorted(large), []

    def longest(most: int, used: dict[int, int]) -> int | None:
        for i in range(bisect.bisect_right(every, most) - 1, -1, -1):
            if left[every[i]] > used.get(every[i], 0):
                return every[i]
        return None

    for p in np.argsort(-x):
        times = int(x[p] + 1e-6)
        slots = [g for g in range(len(pools)) for _ in range(int(round(patterns[g, p])))]
        while times:
            used: dict[int, int] = {}
            for g in slots[:-1]:
                n = next((n for n in pools[g] if left[n] > used.get(n, 0)), None)
                if n is None:
                    break
                used[n] = used.get(n, 0) + 1
            else:
                n = longest(capacity - sum(n * c for n, c in used.items()), used)
                if n is not None:
                    used[n] = used.get(n, 0) + 1
                some = min([times, *(left[n] // c for n, c in used.items())]) if used else 0
                for n, c in used.items():
                    left[n] -= c * some
                if some:
                    classes.append((list(used.items()), some))
                    times -= some
                    continue
            break
    return classes, {n: c for n, c in left.items() if c}


def best_fit(classes: Classes, left: dict[int, int], capacity: int) -> Classes:
    """Every piece of ``left``, longest first, in the open sequence of least room that takes it."""
    open_at: dict[int, Classes] = defaultdict(list)
    for held, times in classes:
        open_at[capacity - sum(n * c for n, c in held)].append((held, times))
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            room = min((r for r in open_at if r >= n), default=None)
            if room is None:
                room, held, times = capacity, [], -(-count // (capacity // n))
            else:
                held, times = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
            each = room // n
            full = min(times, count // each)
            if full:
                open_at[room - each * n].append(([*held, (n, each)], full))
            count, times = count - full * each, times - full
            if times and count and count < each:
                open_at[room - count * n].append(([*held, (n, count)], 1))
                count, times = 0, times - 1
            if times and held:
                open_at[room].append((held, times))
    return [x for held in open_at.values() for x in held]


def plan_classes(histogram: dict[int, int], capacity: int = 2048, groups: int = 48, large_share: float = 1 / 4, keep: tuple[float, ...] = (1, 0.98, 0.95, 0.9, 0.8, 0.7, 0.5, 0.25, 0)) -> Classes:
    """Sequence classes ([(length, how many)...], number of sequences) that hold the histogram exactly.

    The last patterns meet depleted groups, and what they fill badly costs small pieces. So the plan is
    made with each share in ``keep`` of the configured sequences, in order of their patterns'
    multiplicity; the pieces of the others are best-fit with the rest. The first plan with the fewest
    sequences is taken. Share 0 is best-fit decreasing, so the plan is never worse than that."""
    pieces = {n: c for n, c in histogram.items() if c > 0}
    whole: Classes = [([(capacity, 1)], pieces.pop(capacity))] if capacity in pieces else []
    made, left = configured(pieces, capacity, groups, large_share)
    total, least = sum(t for _, t in made), -(-sum(n * c for n, c in pieces.items()) // capacity)
    best: Classes | None = None
    for share in keep:
        most, rest, stay = int(share * total), dict(left), []
        for held, times in made:
            n = min(times, most)
            most -= n
            if n:
                stay.append((held, n))
            for length, c in held if times > n else ():
                rest[length] = rest.get(length, 0) + c * (times - n)
        plan = best_fit(stay, rest, capacity)
        if best is None or sum(t for _, t in plan) < sum(t for _, t in best):
            best = plan
        if sum(t for _, t in best) == least:
            break
    return whole + (best or [])


def slots_by_length(classes: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of places."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    base = 0
    for held, times in classes:
        offset = 0
        for n, c in held:
            for _ in range(c):
                found[n].append((rank[n], base, offset))
                rank[n], offset = rank[n] + times, offset + n
        base += times
    return {n: tuple(np.asarray(x, np.int64) for x in zip(*v, strict=True)) for n, v in found.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: int = 48) -> DataFrame:
    """Places of all pieces: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(slots_by_length(plan_classes(histogram, capacity, groups)))
    cells = 8 * partitions(spark)
    salts = max(1, -(-max(histogram.values(), default=1) // max(64, sum(histogram.values()) // cells)))
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = W.partitionBy("length", "_salt").orderBy("_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_own") + F.col("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = plan.value
        for b in batches:
            lengths, ranks = (np.asarray(b.column(c)) for c in ("length", "_rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            ends = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, ends) if len(order) else []:
                first, base, at = slots[int(lengths[rows[0]])]
                run = np.searchsorted(first, ranks[rows], "right") - 1
                sequence[rows], offset[rows] = base[run] + ranks[rows] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    key_type = docs.schema[id_col].dataType.simpleString()
    return ranked.select("_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, f"{id_col} {key_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
