"""Best-fit packing of token sequences by best-two-fit.

Method: one bin at a time is filled greedily, always with the largest unpacked
piece that fits; then its smallest piece is taken out again and replaced by two
unpacked pieces if the best such pair fills the widened gap more tightly.

The packing sees only how many pieces there are of each length, at most
``capacity`` numbers, whatever the corpus's size. A filled bin is a pattern that
is repeated while all its lengths last, so there are at most a few patterns per
length and the driver's work and the table sent to executors are bounded. Pieces
take their places by their rank within their length; ranks are counted in buckets
of a hash, so that no length, however common, meets in one task.

Defined cases: a null or empty text is one piece with the end id alone; rows
that repeat are packed each; an empty table gives an empty table; a null id keeps
its row; other columns are not read. Only a document of more than ``capacity``
tokens is cut, into pieces of ``capacity`` with the shorter one first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import arrow_rows, materialize
from tessella.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
BATCH = 2000  # whole texts that go to Python at once


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest length of at most ``most`` that is left; 0 if none."""
    if most <= 0:
        return 0
    at = np.flatnonzero(counts[: most + 1])
    return int(at[-1]) if len(at) else 0


def _best_pair(counts: np.ndarray, gap: int, over: int) -> tuple[int, int] | None:
    """The two lengths left with the largest sum in (over, gap]; the larger first."""
    left = np.flatnonzero(counts[: max(gap, 0) + 1])
    if not len(left):
        return None
    # for each larger length a, the largest b <= min(a, gap - a) that is left besides a
    limit = np.minimum(left, gap - left)
    at = np.searchsorted(left, limit, "right") - 1
    same = (at >= 0) & (left[np.maximum(at, 0)] == left) & (counts[left] < 2)
    at = np.where(same, at - 1, at)
    total = np.where(at >= 0, left + left[np.maximum(at, 0)], 0)
    i = len(total) - 1 - int(np.argmax(total[::-1]))  # of equal sums, the largest single piece
    return (int(left[i]), int(left[at[i]])) if total[i] > over else None


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[( [(length, copies), ...] of one bin, number of such bins ), ...]."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        counts[length] = n
    bins = []
    while top := _largest(counts, capacity):
        used: dict[int, int] = {}
        gap, left = capacity, counts.copy()
        while top:
            k = int(min(left[top], gap // top))
            used[top] = used.get(top, 0) + k
            left[top] -= k
            gap -= k * top
            top = _largest(left, gap)
        if gap and sum(used.values()) > 1:
            small = min(used)
            pair = _best_pair(left, gap + small, small)
            if pair:
                used[small] -= 1
                for x in pair:
                    used[x] = used.get(x, 0) + 1
        used = {x: k for x, k in used.items() if k}
        m = int(min(counts[x] // k for x, k in used.items()))
        for x, k in used.items():
            counts[x] -= m * k
        bins.append((sorted(used.items(), reverse=True), m))
    return bins


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, ids, at in encoder(path).column(batch.column(1), END_ID):
                n = np.diff(at)
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                first = ((n - 1) % capacity + 1)[row]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                raw, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), 4 * (at[row] + start)
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            B.trim()

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _cut(path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def _places(bins: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """One row per pattern and length, sorted by (length, first rank)."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, m in bins:
        at = 0
        for length, copies in pattern:
            rows.append((length, taken.get(length, 0), base, copies, at))
            taken[length] = taken.get(length, 0) + copies * m
            at += copies * length
        base += m
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "base", "copies", "at"))}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Materialised pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset."""
    spark = cut.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    counts = cut.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "packing-counts")
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    p = _places(best_two_fit(histogram, capacity))
    key = (p["length"] << 48) + p["first"]
    here = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_r", F.row_number().over(here) - 1).join(counts.select("length", "_b", "_before"), ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before"))
    keep = [c for c in cut.columns if c != "_b"]
    ranked = ranked.select(*keep, "_rank")
    at_length, at_rank = keep.index("length"), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(at_length).to_numpy(), b.column(at_rank).to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, "right") - 1
            r = rank - p["first"][i]
            seq = p["base"][i] + r // p["copies"][i]
            off = p["at"][i] + r % p["copies"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "_b")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece."""
    with arrow_rows(docs.sparkSession, BATCH):
        cut = materialize(pieces(docs, path or tokenizer_path(), capacity), "packing-pieces")
    return pack(cut, capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
