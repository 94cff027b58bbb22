"""Shared-folder tables, word rules and hashing used by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: White space of every word rule here: the ASCII blanks, which are also those of ``bytes.split()``.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default only where it is unset in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file:///tmp/hammerline-shared"
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Caches that a worker process keeps between tasks; emptied when a task of another operator begins there.
WORKER_CACHES: list[dict] = []


def released() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def forgotten() -> None:
    """Empties the caches of this process."""
    if any(WORKER_CACHES):
        for cache in WORKER_CACHES:
            cache.clear()
        released()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over Arrow batches, with memory kept low: workers live on from stage to stage, so it begins
    without the caches of other operators and gives freed memory back when the task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forgotten()
        try:
            yield from run(batches)
        finally:
            released()

    return whole


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash. Emptied by ``trim`` so that its size stays bounded."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingPowers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.grow(4096)

    def grow(self, n: int) -> None:
        base, inverse = np.uint64(self.BASE), np.uint64(pow(self.BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse))), dtype=np.uint64)

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Rabin-Karp hash of every ``width`` consecutive values (mixed); empty if there are fewer."""
        n = len(hashes)
        if n < width:
            return np.empty(0, np.uint64)
        return self.spans(hashes, np.arange(n - width + 1), np.arange(width, n + 1))

    def spans(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each span [start, end) of the sequence, independent of where the span stands."""
        n = len(hashes)
        if n >= len(self.up):
            self.grow(2 * n)
        with np.errstate(over="ignore"):
            prefix = np.concatenate(([np.uint64(0)], np.cumsum(hashes * self.up[:n], dtype=np.uint64)))
            return mix64((prefix[ends] - prefix[starts]) * self.down[starts])
