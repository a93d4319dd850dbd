"""Document fingerprints from statistically improbable byte windows.

Method: every window of 32 bytes has an entropy; a rank table orders entropy
levels by how rare they are in the whole corpus (the rarest first, windows of
almost no entropy last). In each run of 32 neighbouring windows the one with the
best rank, the leftmost of equals, gets a vote; windows with at least 8 votes are
the document's features. A feature's 64-bit hash sets 5 of 2048 bits of a Bloom
filter; after 128 features a new filter is chained. Two digests are compared by
the overlap of set bits, normalised between what chance gives and the most that
is possible: each filter of the digest with fewer filters takes its best match,
weighted by its bits.

A text is padded with zero bytes so that windows that hold its first or last six
bytes exist, so texts shorter than a window have features too.

Defined cases: a null text is empty; an empty text has no feature and an empty
fingerprint, alike to an empty one (1) and to nothing else (0); equal texts have
equal fingerprints whatever stands beside them; documents that share an id follow
each other by text; a null id sorts first; a single document is its own next;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bytesops import MULTIPLIER, mix

WINDOW, RUN, VOTES = 32, 32, 8
PAD = WINDOW - 6
BITS, PER_FILTER, HASHES = 2048, 128, 5
SCALE, SHIFT = 64, 3
LEVELS = (int(WINDOW * np.log2(WINDOW) * SCALE) >> SHIFT) + 2
#: Windows of less than one bit of entropy rank last.
FLAT = int((WINDOW * np.log2(WINDOW) - WINDOW) * SCALE) >> SHIFT

_K = np.arange(1, WINDOW + 1, dtype=float)
_F = np.concatenate([[0.0], _K * np.log2(_K)])
#: What the k-th equal byte of a window adds to the sum of c log2 c, scaled to whole numbers.
_GAIN = np.diff(np.round(_F * SCALE)).astype(np.int32)


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with padding, first window, number of windows of each text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    parts, pad = [b"\0" * (WINDOW - 1)], b"\0" * PAD
    for t in texts:
        if t:
            parts += [pad, t, pad]
    parts.append(b"\0" * (WINDOW + RUN))
    flat = np.frombuffer(b"".join(parts), np.uint8)
    padded = np.where(sizes > 0, sizes + 2 * PAD, 0)
    return flat, WINDOW - 1 + np.cumsum(padded) - padded, np.where(sizes > 0, padded - WINDOW + 1, 0)


def entropy_levels(flat: np.ndarray) -> np.ndarray:
    """The level of the window that starts at each byte: its sum of c log2 c (high: little entropy), quantised.

    A byte adds by its equals among the 31 before it as it enters the window and
    takes away by its equals among the 31 after it as it leaves.
    """
    n = len(flat)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    step = 1 << 17  # stays in the cache
    for a in range(0, n, step):
        lo, b = max(0, a - WINDOW + 1), min(n, a + step)
        x = flat[lo:b]
        for d in range(1, WINDOW):
            s = max(a, d)
            if s >= b:
                break
            eq = (x[s - lo :] == x[s - d - lo : b - d - lo]).view(np.uint8)
            before[s:b] += eq
            after[s - d : b - d] += eq
    enter, leave = np.cumsum(_GAIN[before]), np.cumsum(_GAIN[after])
    total = enter[WINDOW - 1 :].copy()
    total[1:] -= leave[: n - WINDOW]
    return (total >> SHIFT).astype(np.int32)


def _of_texts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions of all texts' windows."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def level_counts(texts: list[bytes]) -> np.ndarray:
    flat, first, count = _layout(texts)
    return np.bincount(entropy_levels(flat)[_of_texts(first, count)], minlength=LEVELS)


def rank_table(counts: np.ndarray) -> np.ndarray:
    """Level -> rank: levels by their frequency, rarest first; flat windows after all others."""
    order = np.lexsort((np.arange(LEVELS), counts, np.arange(LEVELS) > FLAT))
    ranks = np.empty(LEVELS, np.uint64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def digests(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Each text's chained filters, as rows of 64-bit words."""
    flat, first, count = _layout(texts)
    levels = entropy_levels(flat)
    key = np.full(len(levels) + RUN, np.uint64(1 << 62))
    at = _of_texts(first, count)
    key[at] = (ranks[levels[at]] << np.uint64(40)) | at.astype(np.uint64)
    best, span = key, 1
    while span < RUN:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    win = best[best < np.uint64(1 << 62)] & np.uint64((1 << 40) - 1)
    votes = np.bincount(win.astype(np.int64), minlength=len(key))
    chosen = votes >= VOTES
    some = np.flatnonzero(count > 0)
    if len(some):  # a text of few windows keeps at least its best one
        have = np.add.reduceat(chosen[at].astype(np.int64), (np.cumsum(count) - count)[some])
        for i in some[have == 0]:
            chosen[first[i] + int(np.argmax(votes[first[i] : first[i] + count[i]]))] = True
    pos = np.flatnonzero(chosen)
    words = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[pos].copy().view("<u8")
    h = np.zeros(len(pos), np.uint64)
    for i in range(WINDOW // 8):
        h = mix((h ^ words[:, i]) * MULTIPLIER + np.uint64(i))
    doc = np.searchsorted(first + count, pos, "right")
    per_doc = np.bincount(doc, minlength=len(texts))
    nth = np.arange(len(pos)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    filters = -(-per_doc // PER_FILTER)
    base = np.cumsum(filters) - filters
    row = base[doc] + nth // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for i in range(HASHES):
        bits[row, (h >> np.uint64(11 * i)) & np.uint64(BITS - 1)] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view("<u8") if len(bits) else np.zeros((0, BITS // 64), "<u8")
    return [packed[b : b + n] for b, n in zip(base.tolist(), filters.tolist())]


def as_text(digest: np.ndarray) -> str:
    return base64.b64encode(digest.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").reshape(-1, BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(b) < len(a) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    total = 0.0
    for x, n in zip(a, na):
        chance, most = n * nb / BITS, np.minimum(n, nb)
        shared = np.bitwise_count(b & x).sum(1)
        total += n * float(np.max(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)))
    return total / float(na.sum())


def _chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts):
            yield a, i + 1
            a, size = i + 1, 0


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank table from the windows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                texts = [(t or "").encode() for t in batch.column(0).slice(s, 500).to_pylist()]
                for a, b in _chunks(texts):
                    total += level_counts(texts[a:b])
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["level", "n"])

    got = docs.select(text_col).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)  # a row per level at most came here
    for r in got:
        counts[r["level"]] = r["n"]
    return rank_table(counts)


def with_next(docs: DataFrame) -> DataFrame:
    """(_b, _peek, _k, doc_id, text) dealt by ranges of id and sorted; the rows after a range follow it as peeks.

    Bounds of the ranges are ids of the table, as many as there are shuffle
    partitions. The row at a bound also goes to the range before, so that each
    task has the next document of its last one; the first goes to the last range.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.lit(-(2**63)).cast("long")
    rows = docs.select("doc_id", "text").withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), low))
    marks = F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 10 * n)
    found = rows.agg(F.min("_k").alias("first"), marks.alias("marks")).first()
    bounds = sorted({x for x in (found["marks"] or []) if x > found["first"]}) if n > 1 else []
    first = F.lit(found["first"]).cast("long")
    k = F.col("_k")
    if bounds:
        array = F.lit(bounds).cast("array<bigint>")
        half = F.floor((F.col("_k") * 0)).cast("int")  # typed zero
        mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        found_at = F.aggregate(
            F.sequence(F.lit(0), F.lit(len(bounds).bit_length())),
            F.struct(half.alias("lo"), F.lit(len(bounds)).alias("hi")),
            lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
                F.when(F.get(array, mid(s)) <= k, F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
                    F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))
                )
            ),
            lambda s: s["lo"],
        )
    else:
        found_at = F.lit(0)
    rows = rows.withColumn("_at", found_at)
    place = lambda b, peek: F.struct(b.cast("int").alias("b"), F.lit(peek).alias("peek"))
    at = F.col("_at")
    bound = F.get(F.lit(bounds or [0]).cast("array<bigint>"), F.greatest(at - 1, F.lit(0))) == k if bounds else F.lit(False)
    to = F.array(
        place(at, 0),
        F.when((at > 0) & bound, place(at - 1, 1)),
        F.when(k == first, place(F.lit(len(bounds)), 2)),
    )
    rows = rows.select("doc_id", "text", "_k", F.explode(F.filter(to, lambda x: x.isNotNull())).alias("_to"))
    rows = rows.select(F.col("_to.b").alias("_b"), F.col("_to.peek").alias("_peek"), "_k", "doc_id", "text")
    dealt = rows.repartitionById(max(n, len(bounds) + 1), F.col("_b"))
    return dealt.sortWithinPartitions("_b", "_peek", "_k", F.xxhash64("text"), "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows_of(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
        """Rows of neighbouring documents; ``following`` is the one after the last."""
        nexts = [*texts[1:], following]
        edits = [edited(t, x) for t, x in zip(texts, nexts)]
        own = digests([x.encode() for x in [*texts, following]], ranks)
        changed = digests(raw := [x.encode() for x in edits], ranks)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                pa.array([as_text(x) for x in own[:-1]]),
                pa.array([as_text(x) for x in changed]),
                pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                some = batch.slice(s, 500)
                for peek, i, t in zip(some.column(1).to_pylist(), some.column(3).to_pylist(), some.column(4).to_pylist()):
                    if peek:
                        if ids:
                            yield rows_of(ids, texts, t or "")
                        return
                    if size >= 1 << 20:  # this row is the next of the last held one
                        yield rows_of(ids, texts, t or "")
                        ids, texts, size = [], [], 0
                    ids.append(i)
                    texts.append(t or "")
                    size += len(texts[-1])

    return with_next(docs).mapInArrow(run, SCHEMA)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprints(docs, corpus_ranks(docs))
