"""WARC archives as seekable Zstandard bundles.

Method: WARC/1.1 records are grouped into frames of about ``FRAME`` bytes, each
an independent Zstandard frame. A bundle ends with two skippable frames: the
record map (for each record: its id, frame, offset in the unpacked frame, size)
and the seek table of the public seekable format (packed and unpacked size of
each frame, then count, flags and magic number), so that any record is read with
one seek and one frame, and a plain Zstandard reader unpacks the whole archive.

Records with equal payloads: the one with the smallest page id is a response, the
others are revisits that refer to it. Payloads are compared by SHA-1 and size;
the smallest id of each digest comes from a pre-aggregated group, so no group of
copies meets in one task with its payloads.

Defined cases: a null html is an empty payload; rows that repeat (same id and
payload) are all responses if theirs is the smallest id; a null id is smallest
only where all ids of the payload are null; records of one page id in a bundle get
identifiers of their own (``:copy:n``); a null url leaves the header out;
payloads under ``min_bytes`` are always responses; an empty table writes nothing
and gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import filesystem, fresh_path, materialize, write_once

FRAME = 256 << 10
BUNDLE = 64 << 20
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, copy: int = 0) -> str:
    """A record's identifier; ``copy`` tells records of one page id in a bundle apart."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}{f':copy:{copy}' if copy else ''}>"


def _page_id(urn: str):
    value = urn[len("<urn:x-page:") : -1].partition(":")[0]
    return None if value == "null" else int(value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, copy: int = 0) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), the HTTP payload and the size its headers state."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    return {"headers": h, "payload": payload, "payload_bytes": size}


class BundleWriter:
    """Collects records into frames; ``finish`` gives the file's parts."""

    def __init__(self, level: int = 3):
        import zstandard

        self._pack = zstandard.ZstdCompressor(level=level).compress
        self.frames, self.sizes, self.map, self._open, self._size = [], [], [], [], 0
        self.stored = 0

    def add(self, key: str, raw: bytes) -> None:
        self.map.append((key, len(self.frames), self._size, len(raw)))
        self._open.append(raw)
        self._size += len(raw)
        if self._size >= FRAME:
            self._close()

    def _close(self) -> None:
        if self._open:
            packed = self._pack(b"".join(self._open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self._size))
            self.stored += len(packed)
            self._open, self._size = [], 0

    def finish(self) -> list[bytes]:
        self._close()
        index = self._pack(json.dumps(self.map).encode())
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return [*self.frames, struct.pack("<II", SKIPPABLE_MAP, len(index)), index, struct.pack("<II", SKIPPABLE_SEEK, len(table)), table]


class Bundle:
    """Random access by the footer; only the footer and the frames asked for are read."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._file = fs.open_input_file(path)
        size = self._file.size()
        count, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        start = size - 9 - 8 * count
        entries = np.frombuffer(self._at(start, 8 * count), "<u4").reshape(-1, 2)
        self._starts = np.concatenate([[0], np.cumsum(entries[:, 0], dtype=np.int64)])
        self._packed = entries[:, 0]
        at = int(self._starts[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        if kind != SKIPPABLE_MAP:
            raise ValueError("no record map")
        self.map = json.loads(self._unpack(self._at(at + 8, length)))
        self._by_key = None

    def _at(self, start: int, n: int) -> bytes:
        self._file.seek(start)
        return self._file.read(n)

    def frame(self, i: int) -> bytes:
        return self._unpack(self._at(int(self._starts[i]), int(self._packed[i])))

    def read(self, key: str) -> bytes:
        if self._by_key is None:
            self._by_key = {k: (f, a, n) for k, f, a, n in self.map}
        f, a, n = self._by_key[key]
        return self.frame(f)[a : a + n]

    def records(self) -> Iterator[bytes]:
        held, data = -1, b""
        for _, f, a, n in self.map:
            if f != held:
                held, data = f, self.frame(f)
            yield data[a : a + n]

    def close(self) -> None:
        self._file.close()


def decisions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, _sha, _n, _first) of distinct rows: the smallest page id with that payload."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.select("page_id", F.sha1(body.cast("binary")).alias("_sha"), F.octet_length(body).alias("_n"))
    keys = materialize(keys, "warc-keys")
    first = keys.filter(F.col("_n") >= min_bytes).groupBy("_sha", "_n").agg(F.min("page_id").alias("_first"))
    return keys.distinct().join(first, ["_sha", "_n"])


def write_bundles(pages: DataFrame, out: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per row; the manifest: path, records (materialised)."""
    d = decisions(pages, min_bytes).select(F.col("page_id").alias("_id"), F.col("_sha").alias("_dsha"), F.col("_first"))
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_sha"))
    rows = rows.join(d, rows["page_id"].eqNullSafe(d["_id"]) & (rows["_sha"] == d["_dsha"]), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False)) & F.col("_id").isNotNull()
    revisit = revisit | (F.col("page_id").isNull() & F.col("_first").isNotNull())
    rows = rows.select("page_id", "url", "html", revisit.alias("_revisit"), "_first").sortWithinPartitions("page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, w, copies = TaskContext.get().partitionId(), 0, BundleWriter(), Counter()

        def flush():
            nonlocal part, w
            copies.clear()
            name = f"{out}/bundle-{task:06d}-{part:04d}.warc.zst"
            write_once(name, w.finish())
            row = pa.record_batch([pa.array([name]), pa.array([len(w.map)], pa.int64())], ["path", "records"])
            part, w = part + 1, BundleWriter()
            return row

        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                for i, url, html, again, first in zip(*[c.to_pylist() for c in batch.slice(s, 200).columns]):
                    w.add(record_id(i, copies[i]), record(i, url, (html or "").encode(), first, again, copies[i]))
                    copies[i] += 1
                    if w.stored >= BUNDLE:
                        yield flush()
        if w.map:
            yield flush()

    return materialize(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """A row per record, from the archives."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                bundle, rows = Bundle(path), []
                for raw in bundle.records():
                    r = parse(raw)
                    h = r["headers"]
                    again = h["warc-type"] == "revisit"
                    if again:
                        told = h["warc-payload-digest"].removeprefix("sha1:")
                    elif len(r["payload"]) != r["payload_bytes"]:
                        raise ValueError("a payload was cut")
                    else:
                        told = digest(r["payload"])
                    rows.append(
                        (
                            _page_id(h["warc-record-id"]),
                            r["payload_bytes"],
                            told,
                            h["warc-type"],
                            _page_id(h["warc-refers-to"]) if again else None,
                        )
                    )
                bundle.close()
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_bundles(write_bundles(pages, fresh_path(spark, "warc")))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS size, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, (1 + i // 8 * 10)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
