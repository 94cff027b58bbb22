"""WARC archives with a two-level capture index.

Pages are written as one gzip member a record. Rows with equal payloads share one response, the
others are revisits of it; who is the response is settled on digests alone, before any payload
moves. The capture index sorts reversed-host keys into compressed blocks of a fixed number of
entries, with a sparse directory (first key, file, offset, length) of the blocks: a lookup searches
the directory by bisection, reads one block by range, bisects it, and reads the record by range.

Archives are written through ``pyarrow.fs`` into the shared folder under names that no other task
attempt uses; only files that a finished task reports are in the index, so a retried or lost task
leaves nothing that is read.

Edge cases: null html is an empty payload, a null url an empty key; an empty table gives empty
results; repeated rows of the response's id are responses too; rows with a null id are revisits if
another row of their payload has an id, else responses; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, written

FILE_BYTES, BLOCK_ENTRIES, SALTS = 1_000_000_000, 1000, 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, page_id long, record_type string, file string, offset long, length long"
BLOCK = "first_key string, file string, offset long, length long, entries long"


def surt(url: str | None) -> str:
    """Reversed-host sort key: ``com,example,www)/path?query``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record as bytes; a revisit has headers only."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload) if refers_to is None else 0}",
    ]
    if url:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (payload if refers_to is None else b"") + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; raises on a broken length or digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response" and f"sha1:{base32_sha1(block)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest differs in {fields['WARC-Record-ID']}")
    return fields, block


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Files:
    """Append-only output files of one task attempt."""

    def __init__(self, base: str, stem: str, suffix: str) -> None:
        from pyarrow import fs

        self.fs, self.dir = fs.FileSystem.from_uri(base)
        self.base, self.stem, self.suffix, self.out, self.at = base, stem, suffix, None, 0
        self.fs.create_dir(self.dir, recursive=True)

    def append(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name, self.at = f"{self.stem}-{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.dir}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Range reads from the files of a folder; the last file stays open."""

    def __init__(self, base: str) -> None:
        from pyarrow import fs

        self.fs, self.dir = fs.FileSystem.from_uri(base)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.fs.open_input_file(f"{self.dir}/{name}")
        return self.file.read_at(length, offset)


def write_archives(pages: DataFrame, base: str, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record a row into ``base`` and returns the capture entries as a written table."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    groups = written(groups, "payload-groups").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    settled = rows.join(groups, ["digest", "salt"], "left").select("id", "url", "payload", F.when(F.col("id").eqNullSafe(F.col("keeper")), F.lit(None)).otherwise(F.col("keeper")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(base, "pages", ".warc.gz")
        try:
            for b in batches:
                out: list[list] = [[], [], [], [], [], []]
                for i, url, payload, refers in zip(b.column("id").to_pylist(), b.column("url").to_pylist(), b.column("payload"), b.column("refers_to").to_pylist(), strict=True):
                    data = _member(record(i, url, payload.as_py(), refers, date))
                    name, at = files.append(data)
                    for column, x in zip(out, (surt(url), i, "response" if refers is None else "revisit", name, at, len(data)), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "page_id", "record_type", "file", "offset", "length"])
        finally:
            files.close()

    return written(settled.mapInArrow(write, ENTRY), "captures")


def write_index(entries: DataFrame, base: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sorted compressed blocks in ``base``; returns the sparse directory as a written table."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = _Files(base, "index", ".cdx.gz"), []

        def block(rows: list[dict]) -> tuple:
            data = _member("".join(json.dumps(list(r.values())) + "\n" for r in rows).encode())
            name, at = files.append(data)
            return rows[0]["key"], name, at, len(data), len(rows)

        try:
            for b in batches:
                held += b.to_pylist()
                whole = len(held) // block_entries * block_entries
                out = [block(held[i : i + block_entries]) for i in range(0, whole, block_entries)]
                held = held[whole:]
                if out:
                    yield _blocks(out)
            if held:
                yield _blocks([block(held)])
        finally:
            files.close()

    def _blocks(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["first_key", "file", "offset", "length", "entries"])

    n = partitions(entries.sparkSession)
    ordered = entries.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return written(ordered.mapInArrow(blocks, BLOCK), "directory")


def _opened(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data, 31).splitlines()]


class CaptureIndex:
    """Archives and index of one crawl in a shared folder."""

    def __init__(self, spark: SparkSession, base: str, directory: DataFrame) -> None:
        self.spark, self.base, self.directory = spark, base, directory

    @classmethod
    def build(cls, pages: DataFrame, base: str | None = None, **options) -> CaptureIndex:
        spark = pages.sparkSession
        base = base or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        return cls(spark, base, write_index(write_archives(pages, f"{base}/archives", **options), f"{base}/index"))

    def lookup(self, url: str) -> list[dict[str, str]]:
        """Headers and payload of the captures of one url. The sparse directory is a table sorted by key:
        Spark prunes it to the blocks that may hold the key, so the driver gets those of one url."""
        key, found = surt(url), []
        before = self.directory.where(F.col("first_key") < key).agg(F.max("first_key")).first()[0]
        wanted = F.col("first_key").between(before if before is not None else key, key)
        rows = sorted((r["first_key"], r["file"], r["offset"], r["length"]) for r in self.directory.where(wanted).collect())  # blocks of one key
        blocks, archives = _Ranges(f"{self.base}/index"), _Ranges(f"{self.base}/archives")
        for row in rows:
            entries = _opened(blocks.read(*row[1:]))
            keys = [e[0] for e in entries]
            for e in entries[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                fields, block = parsed(zlib.decompress(archives.read(*e[3:]), 31))
                found.append(fields | {"payload": block.decode()})
        return found

    def records(self) -> DataFrame:
        """Every capture, read back through the index by range: page_id, payload_bytes,
        payload_digest, record_type, refers_to, url, payload."""
        index, archives = f"{self.base}/index", f"{self.base}/archives"

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = _Ranges(index)
            for b in batches:
                for name, at, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    rows = _opened(ranges.read(name, at, length))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in ((3, pa.string()), (4, pa.int64()), (5, pa.int64()))], ["file", "offset", "length"])

        def number(urn: str) -> int | None:
            value = urn.removeprefix("<urn:x-page:").removesuffix(">")
            return int(value) if value else None

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ranges = _Ranges(archives)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
            for b in batches:
                out: list[list] = [[] for _ in kinds]
                for name, at, length in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    fields, block = parsed(zlib.decompress(ranges.read(name, at, length), 31))
                    refers = fields.get("WARC-Refers-To")
                    row = (number(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number(refers) if refers else None, fields.get("WARC-Target-URI"), block)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

        n = partitions(self.spark)
        places = self.directory.select("file", "offset", "length").repartition(n).mapInArrow(entries, "file string, offset long, length long")
        places = places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
        return places.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")
