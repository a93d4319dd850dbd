"""Quality classification by supervised subword embeddings.

Model: each white-space word, each pair of neighbouring words (a word after
itself is one feature, whatever the word: a mark of repetition that hashed pairs
of new words can't carry) and each byte n-gram of 3 to 5 bytes inside a word (its
first byte may be the boundary before it) is hashed to a bucket with a learned
vector. A document is the average of the vectors of all its features,
and a softmax layer gives the class probabilities. Vectors and layer are trained
together by numpy stochastic gradient descent with a falling rate.

Training runs on the driver over a bounded, documented sample: of the labelled
rows outside the held-out fold (crc32(doc_id as text) mod 4 = 2), the ``max_train``
with the smallest xxhash64(doc_id, seed), equal texts once. Scoring is one map
over the whole texts without a shuffle; as the layer is linear, each bucket's
vector is folded with it to one number beforehand.

Only the text is an input of the score. Defined cases: a null or empty text has
no features and gets the score of the bias alone; rows that repeat get equal
scores; a null id is not held out; without labels of both kinds every score is
the share of label 1 (0.5 without labels); other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bytesops as B
from tessella.llm.shared import materialize, unique_names

MAX_TRAIN = 4000
BITS = 18
DIM = 10
THRESHOLD = 0.7
VECTOR_RATE = 20.0


def _slots(data: np.ndarray, o: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each position, which positions count, offsets) per kind of feature."""
    n = len(o) - 1
    shift = np.uint64(64 - BITS)
    s, length = B.words(data, o, B.SPACE)
    h = B.word_hashes(data, s, length)
    first = np.searchsorted(s, o)
    yield (h >> shift).astype(np.int64), np.ones(len(h), bool), first
    # Word pairs; all pairs of a word with itself share one bucket.
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = B.mix(h[:-1] * B.MULTIPLIER + h[1:])
    whole = np.ones(len(h), bool)
    whole[first[:-1][first[:-1] < len(h)]] = False
    yield np.where(again, 1, pair >> shift).astype(np.int64), whole, first
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(o))
    flat = np.full(len(data) + n + 8, 32, np.uint8)
    flat[np.arange(len(data)) + row + 1] = np.where(B.SPACE[data], np.uint8(32), data)
    inside = flat != 32
    m = len(flat) - 5
    at = np.minimum(o + np.arange(n + 1), m)
    at[-1] = m
    g, ok = flat[:m].astype(np.uint64), np.ones(m, bool)
    for i in range(1, 5):
        g |= flat[i : m + i].astype(np.uint64) << np.uint64(8 * i)
        ok &= inside[i : m + i]
        if i >= 2:
            yield (((g ^ np.uint64(i << 56)) * B.MULTIPLIER) >> shift).astype(np.int64), ok, at


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, buckets and counts of each document."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, o in B.chunks(batch.column(0)):
            keys = []
            for slot, ok, at in _slots(data, o):
                p = np.flatnonzero(ok)
                keys.append(B.rows_of(p, at[:-1]) << 32 | slot[p])
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            cut = np.searchsorted(key >> 32, np.arange(b - a + 1))
            f, c = (key & 0xFFFFFFFF).astype(np.int32), count.astype(np.float32)
            yield pa.record_batch(
                [
                    pa.array(label[a:b], pa.int32()),
                    pa.array([f[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                    pa.array([c[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                ],
                ["label", "feats", "counts"],
            )


class EmbeddingModel:
    """Per bucket, the logit of label 1 that its vector gives, and the bias."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit.astype(np.float32), float(bias)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for a, b, data, o in B.chunks(column):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for slot, ok, at in _slots(data, o):
                if not len(slot):
                    continue
                # summed text by text in one order, so that equal texts are equal wherever they stand
                row = np.repeat(np.arange(b - a), np.diff(at))
                total += np.bincount(row, np.where(ok, self.logit[slot], 0)[at[0] : at[-1]], minlength=b - a)
                n += np.bincount(row, ok[at[0] : at[-1]], minlength=b - a)
            out[a:b] = np.where(n > 0, total / np.maximum(n, 1), 0)
        return np.round(1 / (1 + np.exp(-np.clip(np.round(out, 7) + self.bias, -40, 40))), 9)


def fit(rows: list, batch: int = 16, rate: float = 0.1, seed: int = 5) -> EmbeddingModel:
    y = np.array([r["label"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return EmbeddingModel(np.zeros(1 << BITS), np.log(share / (1 - share)))
    epochs = int(np.clip(20_000 // len(y), 5, 50))  # small samples are gone through more often
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    feats = [np.frombuffer(r["feats"], np.int32) for r in rows]
    shares = [np.frombuffer(r["counts"], np.float32) / max(1.0, float(np.frombuffer(r["counts"], np.float32).sum())) for r in rows]
    steps, t = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            at = [k for k in order[i : i + batch] if len(feats[k])]
            if not at:
                continue
            eta = rate * (1 - t / steps)
            t += 1
            f, w = np.concatenate([feats[k] for k in at]), np.concatenate([shares[k] for k in at])
            sizes = np.array([len(feats[k]) for k in at])
            mean = np.add.reduceat(vectors[f] * w[:, None], np.cumsum(sizes) - sizes, axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            back = p @ layer.T
            layer -= eta * (mean.T @ p)
            bias -= eta * p.mean(0)
            by = np.argsort(f, kind="stable")
            u = np.flatnonzero(np.diff(f[by], prepend=-1))
            step = np.repeat(back, sizes, axis=0)[by] * w[by, None]
            # A bucket's vector moves by the sum of its documents' steps, scaled to the bag's size.
            vectors[f[by][u]] -= eta * VECTOR_RATE * np.add.reduceat(step, u, axis=0)
    return EmbeddingModel(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0])


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 3) -> EmbeddingModel:
    pick = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pick = pick.select("doc_id", F.col("quality").cast("int").alias("label")).dropDuplicates()
    pick = pick.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "label").limit(max_train)
    # The broadcast side has at most max_train rows of two numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    sample = materialize(sample.orderBy(F.xxhash64("text"), "text"), "quality-sample")
    return fit(sample.mapInArrow(_bags, "label int, feats binary, counts binary").collect())


def score(docs: DataFrame, model: EmbeddingModel, text_col: str = "text") -> DataFrame:
    """The input's columns, then quality_score double (with an underscore after it where the input has that name)."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(*unique_names(docs.columns, ["quality_score"]), T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column(at)))], schema.names)

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return got.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
