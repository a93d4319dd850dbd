"""Toxicity by cumulative-link ordinal regression on sparse word features.

Model: severity grades 0..2 with P(grade >= k | x) = sigmoid(w.x - theta_k), one
weight vector shared by all thresholds and theta_1 < theta_2 (kept in order by
learning the log of their gap). Features are byte n-grams within words, those
that the labels single out: smoothed log-odds for the toxic label above a bound.
Their values are shares, log(1 + count) over its sum in the text; one more feature
is the log of their number a hundred words. So what the grades below are made from
is among the features, and no feature grows with a text's length (weights shared by
both thresholds can't fit such grades from counts, and then lose toxic rows). The
output is the expected severity, the sum over k of P(grade >= k).

The labels only tell toxic from not. Grades among the toxic training rows are
made from the evidence a word, which does not grow with a text's length: rows with
no more of it than the toxic rows' median are grade 1, the others grade 2.

Training: numpy on the driver over a bounded, documented sample: of the labelled
rows the ``max_train`` with the smallest xxhash64(doc_id, seed), of an id with several
texts the smallest. Scoring: each whole text, in one map over the input, with no shuffle.

Defined cases: a null or empty text has no features and severity from the
thresholds alone; rows that repeat get equal scores; without labelled rows of
both kinds every document gets severity 0; a null id keeps its row; other
columns of the input are returned unread; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm import bytesops as B
from tessella.llm.shared import materialize, unique_names

#: Bounds of the training sample and of the vocabulary, and what counts as evidence.
MAX_TRAIN = 16000
MAX_VOCABULARY = 20000
EVIDENCE_LOG_ODDS = 2.5
MIN_TOXIC_DF = (3, 8)  # 1 % of the toxic rows, within these


def _grams(data: np.ndarray, o: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of every word-internal byte n-gram of 4 to 6 bytes.

    A gram is its bytes and length packed in 64 bits, so it is exact. Its first
    byte may be the boundary before the word; letters are lower-cased, and every
    ASCII character that is no letter or digit is a boundary.
    """
    n = len(o) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(o))
    flat = np.full(len(data) + n + 8, 32, np.uint8)
    low = B.LOWER[data]
    low[B.NOT_ALNUM[low]] = 32
    flat[np.arange(len(data)) + row + 1] = low
    rows = np.zeros(len(flat), np.int32)
    rows[np.arange(len(data)) + row + 1] = row
    inside = flat != 32
    m = len(flat) - 6
    g, ok = flat[:m].astype(np.uint64), np.ones(m, bool)
    for i in range(1, 6):
        g |= flat[i : m + i].astype(np.uint64) << np.uint64(8 * i)
        ok &= inside[i : m + i]
        if i >= 3:
            at = np.flatnonzero(ok)
            # the boundary before a text's first word belongs to that text
            yield rows[at + 1], g[at] | np.uint64((i + 1) << 56)


def _unique(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], gram[at], np.diff(np.append(at, len(gram)))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and gram: documents with it, and toxic ones."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b, data, o in B.chunks(batch.column(0)):
            got = list(_grams(data, o))
            r, g, _ = _unique(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            g, at, df = np.unique(g, return_inverse=True, return_counts=True)
            tox = np.bincount(at, label[a:b][r], minlength=len(g)).astype(np.int64)
            yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(df), pa.array(tox)], ["gram", "df", "tox"])


class Vocabulary:
    """Sorted grams with a bitmap that rules most others out."""

    BITS = 22

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[self._slot(self.grams)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * B.MULTIPLIER) >> np.uint64(64 - self.BITS)

    def bags(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, row, feature, count, words of each row) over whole texts, (row, feature) unique."""
        for a, b, data, o in B.chunks(column):
            rows, feats = [], []
            words = np.bincount(B.rows_of(B.words(data, o, B.SPACE)[0], o), minlength=b - a)
            for r, g in _grams(data, o):
                if not len(self.grams):
                    continue
                near = np.flatnonzero(self.seen[self._slot(g)])
                at = np.minimum(np.searchsorted(self.grams, g[near]), len(self.grams) - 1)
                hit = self.grams[at] == g[near]
                rows.append(r[near][hit])
                feats.append(at[hit])
            if rows:
                key, count = np.unique(np.concatenate(rows).astype(np.int64) << 32 | np.concatenate(feats), return_counts=True)
                yield a, b, key >> 32, key & 0xFFFFFFFF, count, words
            else:
                z = np.zeros(0, np.int64)
                yield a, b, z, z, z, words


def _bags(vocab: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, r, f, c, words in vocab.bags(batch.column(0)):
                cut = np.searchsorted(r, np.arange(b - a + 1))
                yield pa.record_batch(
                    [
                        pa.array(label[a:b], pa.int32()),
                        pa.array([f[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                        pa.array([c[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                        pa.array(words, pa.int32()),
                    ],
                    ["label", "feats", "counts", "words"],
                )

    return run


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int, seed: int = 7) -> DataFrame:
    """(text, label) of the at most ``max_train`` labelled rows with the smallest hashes (a bound on the sample, by design)."""
    order = F.xxhash64("doc_id", F.lit(seed))
    pick = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    pick = pick.dropDuplicates().orderBy(order, "doc_id", "label").limit(max_train)
    # The broadcast side has at most max_train rows of two numbers.
    met = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")


def values(rows: np.ndarray, feats: np.ndarray, counts: np.ndarray, words: np.ndarray | None, n: int, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of n texts: each gram's share and, as feature ``grams``, the evidence a hundred words; without words the grams' log counts alone."""
    x = np.log1p(counts)
    if words is None:
        return rows, feats, x
    dense = np.log1p(100 * np.bincount(rows, counts, minlength=n) / np.maximum(words, 1))
    at = np.flatnonzero(dense)
    share = x / np.bincount(rows, x, minlength=n)[rows]
    return np.concatenate([rows, at]), np.concatenate([feats, np.full(len(at), grams)]), np.concatenate([share, dense[at]])


class OrdinalModel:
    """Vocabulary, weights (grams', then the density's) shared by all thresholds, ordered thresholds."""

    def __init__(self, vocab: Vocabulary, weights: np.ndarray, thresholds: np.ndarray):
        self.vocab, self.weights, self.thresholds = vocab, weights, thresholds

    def linear(self, rows: np.ndarray, feats: np.ndarray, counts: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        if not len(rows):
            return np.zeros(n)
        r, f, x = values(rows, feats, counts, words, n, len(self.vocab.grams))
        return np.bincount(r, self.weights[f] * x, minlength=n)

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column per threshold."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -40, 40)))


def grades(y: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """0 for label 0; 1 or 2 for label 1, by the evidence a word against the toxic rows' median."""
    middle = np.median(evidence[y == 1]) if (y == 1).any() else 0
    return np.where(y == 1, 1 + (evidence > middle), 0)


def fit(rows: list, vocab: Vocabulary, l2: float = 1e-5, steps: int = 600, rate: float = 0.02) -> OrdinalModel:
    """Adam on the cumulative-link loss, full batches over the bounded sample."""
    y = np.array([r["label"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max() or not len(vocab.grams):
        return OrdinalModel(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), np.array([40.0, 41.0]))
    f = [np.frombuffer(r["feats"], np.int32) for r in rows]
    raw = np.concatenate([np.frombuffer(r["counts"], np.int32) for r in rows])
    r = np.repeat(np.arange(len(y)), [len(x) for x in f])
    words = np.array([x["words"] for x in rows]) if "words" in rows[0] else None
    g = grades(y, np.bincount(r, raw, minlength=len(y)) / (1 if words is None else np.maximum(words, 1)))
    r, w, c = values(r, np.concatenate(f), raw, words, len(y), len(vocab.grams))
    n, top = len(vocab.grams) + (words is not None), int(g.max())
    at_least = (g[:, None] >= np.arange(1, top + 1)[None, :]).astype(float)
    p = np.concatenate([np.zeros(n), [1.0], np.zeros(top - 1)])  # weights, theta_1, log gaps
    m, v = np.zeros_like(p), np.zeros_like(p)
    theta_of = lambda p: p[n] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[n + 1 :], -8, 8)))])
    for t in range(1, steps + 1):
        gaps = np.exp(np.clip(p[n + 1 :], -8, 8))
        z = np.bincount(r, p[w] * c, minlength=len(y))
        e = 1 / (1 + np.exp(-np.clip(z[:, None] - theta_of(p), -40, 40))) - at_least
        d = -e.sum(0)
        grad = np.concatenate([np.bincount(w, e.sum(1)[r] * c, minlength=n) + l2 * len(y) * p[:n], [d.sum()], gaps * d[::-1].cumsum()[::-1][1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(vocab, p[:n], theta_of(p))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> OrdinalModel:
    sample = materialize(training_rows(docs, labels, "toxic", max_train), "toxicity-sample")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = sample.mapInArrow(_document_counts, "gram long, df long, tox long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("tox").alias("tox"))
    least = min(max(MIN_TOXIC_DF[0], pos // 100), MIN_TOXIC_DF[1])
    # Grams without a toxic row in the whole sample go here: they are no evidence.
    counts = counts.filter("tox > 0")
    odds = F.log((F.col("tox") + 0.5) / (pos + 1.0)) - F.log((F.col("df") - F.col("tox") + 0.5) / (n - pos + 1.0))
    evidence = counts.filter((F.col("tox") >= least) & (odds > EVIDENCE_LOG_ODDS)).orderBy(F.desc("tox"), "gram").limit(MAX_VOCABULARY)
    vocab = Vocabulary(np.array([x["gram"] for x in evidence.select("gram").collect()], np.int64).view(np.uint64))
    bags = sample.mapInArrow(_bags(vocab), "label int, feats binary, counts binary, words int")
    return fit(bags.collect(), vocab)  # at most max_train rows


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's columns, then tox_severity double, tox_grade int, tox_p double and tox_flag boolean.

    Where the input has a column of one of these names, the new one's name ends with an underscore.
    """
    at = docs.columns.index(text_col)
    names = unique_names(docs.columns, ["tox_severity", "tox_grade", "tox_p", "tox_flag"])
    kinds = [T.DoubleType(), T.IntegerType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in zip(names, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, len(model.thresholds)))
            for a, b, r, f, c, words in model.vocab.bags(batch.column(at)):
                p[a:b] = model.at_least(model.linear(r, f, c, words, b - a))
            more = [
                pa.array(p.sum(1)),
                pa.array((p >= 0.5).sum(1), pa.int32()),
                pa.array(p[:, 0]),
                pa.array(p[:, 0] >= threshold),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)
        B.trim()

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = score(docs, model).select(
        "doc_id",
        F.col("tox_severity").alias("expected_severity"),
        F.col("tox_grade").alias("grade"),
        F.col("tox_p").alias("p_toxic"),
        F.col("tox_flag").alias("toxic"),
    )
    return got
