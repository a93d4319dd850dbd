"""Language-model scores of documents from a subword lattice.

Model. The pieces of an existing subword vocabulary span a lattice over a word:
every way to cut the word (with the mark of a word's start before it) into pieces is
a path, a character outside the vocabulary being its byte pieces. A piece's score is
the logarithm of its smoothed share of the pieces of the distinct training words, as
the vocabulary's own tokenizer cuts them. The forward recursion in log space sums the
paths' probabilities, so S(word) is the marginal over all segmentations. Pieces never
cross a word's start, so a document's marginal is the product over its words and one
end, and each distinct word is recursed over once, whatever its frequency. The words
of the training documents are pieces of the lattice too, each one edge over the
whole word, with the weight that its count has beside V pseudo-counts for spelling:
P(word) = (c + V S(word)) / (N + V). A word never seen is spelled, a frequent one is
nearly its share; probabilities of all words and the end add up to at most 1.
Where documents have a class (a language), counts and piece scores are each class's
own, and the document's probability is the sum over classes of the class's share of
documents times the product; the class of the document scored is not looked at.

Plan. Texts are read once, in chunks of about CHUNK bytes of whole texts. A task
numbers the words it meets in a book (a new one from BOOK words on); a chunk becomes
a row with each document as word numbers and counts, a book a row with its words and
their counts. From then on only books' words are shuffled: summed to the counts of
all words, with which the recursion runs over the table of distinct words, and sent
back to their books. Counts grow with the corpus and are nowhere gathered; only the
pieces' counts (one a piece of the vocabulary and class) and a few totals reach the
driver.

Defined cases: a null or empty text is its end alone; a null id counts as the empty
string; a text of one very long word is spelled like any other; rows that repeat are
counted and scored each; equal texts score alike to the last bit, as sums are taken in
units of 2^-32; classes beyond the most frequent ones, and a null class, are one
class of their own; without training documents the spelling alone scores; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import discard, materialize

CHUNK = 8 << 20  # bytes of text whose words are told apart together
BOOK = 400_000  # words of a task from which it begins a new book
SPELL = 1 << 17  # bytes of words recursed over together
WIDE = 256  # places of a word up to which all words are stepped together
UNIT = 1 << 32  # sums of log10 are taken in this many parts of 1 (each word's to 24 bits in the model)
LAST = (1 << 31) - 1  # the number of no word: a row of documents
DOCUMENT = ("ids", "held", "sizes", "lengths", "slots", "counts")
START = "▁".encode()  # how the vocabulary marks a word's start


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """The pieces as a trie with two roots: 0 inside a word, 1 at its start."""

    def __init__(self, path: str):
        model = _library(path)
        self.size = model.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        self.start_piece, self.starts = -1, []
        child: dict[int, int] = {}
        value = [-1, -1]
        for i in range(self.size):
            piece = model.id_to_piece(i).encode()
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                continue
            if model.is_control(i) or model.is_unknown(i) or START in piece[1:]:
                continue
            node, body = (1, piece[len(START) :]) if piece.startswith(START) else (0, piece)
            if node:
                self.starts.append(i)
            if not body:
                self.start_piece = i
                continue
            for b in body:
                key = node << 8 | b
                if key not in child:
                    child[key] = len(value)
                    value.append(-1)
                node = child[key]
            value[node] = i
        self.keys = np.array(sorted(child), np.int64)
        self.child = np.array([child[k] for k in self.keys.tolist()], np.int64)
        self.value = np.array(value, np.int64)

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte or -1 for a word's start, end byte, piece) of all pieces in words that lie in one buffer."""
        n = len(data)
        end = np.repeat(offsets[1:], np.diff(offsets))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        own = offsets[:-1][np.diff(offsets) > 0]
        at = np.concatenate([lead, own])
        origin = np.concatenate([lead, np.full(len(own), -1)])
        node = np.concatenate([np.zeros(len(lead), np.int64), np.ones(len(own), np.int64)])
        begin = at.copy()
        found = []
        while len(at):
            key = node << 8 | data[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            at, origin, node, begin = at[on] + 1, origin[on], self.child[i[on]], begin[on]
            piece = self.value[node]
            hit = piece >= 0
            found.append((origin[hit], at[hit], piece[hit]))
            more = at < end[begin]
            at, origin, node, begin = at[more], origin[more], node[more], begin[more]
        src, to, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        # Characters that are no piece are spelled by bytes: one edge, its piece numbered after the vocabulary.
        width = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        single = np.zeros(n, bool)
        inner = src >= 0
        single[src[inner][to[inner] - src[inner] == width[src[inner]]]] = True
        bare = lead[~single[lead]]
        src = np.concatenate([src, bare])
        to = np.concatenate([to, np.minimum(bare + width[bare], end[bare])])
        return src, to, np.concatenate([piece, self.size + bare])

    def marginals(self, data: np.ndarray, offsets: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Natural logarithm of the summed probability of all segmentations of each word; ``score`` (piece, class)."""
        n, words, kinds = len(data), len(offsets) - 1, score.shape[1]
        src, to, piece = self.edges(data, offsets)
        spelled = np.concatenate([np.zeros((1, kinds)), np.cumsum(score[self.bytes[data]], 0)])
        inside = piece < self.size
        weight = score[np.minimum(piece, self.size - 1)]
        weight[~inside] = spelled[to[~inside]] - spelled[src[~inside]]
        word = np.searchsorted(offsets, to - 1, "right") - 1
        # Places: a word of m bytes has m + 1; the last place of all stands before every word's start.
        first = offsets[:-1] + np.arange(words)
        alpha = np.full((n + words + 1, kinds), -np.inf)
        alpha[-1] = 0
        alpha[first] = score[self.start_piece]
        level = to - offsets[word]
        target = to + word
        source = np.where(src >= 0, src + word, n + words)
        order = np.lexsort((source, target, level))
        level, target, source, weight = level[order], target[order], source[order], weight[order]
        most = int(level[-1]) if len(level) else 0
        cut = np.searchsorted(level, np.arange(1, min(most, WIDE) + 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if a == b:
                    continue
                v, t = alpha[source[a:b]] + weight[a:b], target[a:b]
                heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                top = np.maximum.reduceat(v, heads)
                size = np.diff(np.append(heads, b - a))
                total = np.add.reduceat(np.exp(v - np.repeat(top, size, 0)), heads)
                alpha[t[heads]] = top + np.log(total)
        if most > WIDE:  # few words are that long: place by place
            one = int(cut[-1])
            for k in range(kinds):
                far = alpha[:, k].tolist()
                for t, s, w in zip(target[one:].tolist(), source[one:].tolist(), weight[one:, k].tolist()):
                    x, y = far[t], far[s] + w
                    far[t] = y if x == -math.inf else max(x, y) + math.log1p(math.exp(-abs(x - y)))
                alpha[:, k] = far
        return alpha[first + np.diff(offsets)]


@functools.cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def _book_rows(kinds: int):
    """Rows of chunks (documents as word numbers of their book, packed) and of books (words with their counts in each class's training documents)."""
    trained = [f"t{k}" for k in range(kinds)]
    schema = "book long, words array<string>, " + "".join(f"{t} array<long>, " for t in trained) + "documents binary"
    names = ["book", "words", *trained, "documents"]
    types = [pa.string(), *[pa.int64()] * kinds]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def row(book: int, words: list[pa.Array] | None = None, documents: bytes | None = None) -> pa.RecordBatch:
        lists = [one(x) for x in words] if words else [pa.nulls(1, pa.list_(t)) for t in types]
        return pa.RecordBatch.from_arrays([pa.array([book], pa.int64()), *lists, pa.array([documents], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        book: dict[bytes, int] = {}
        sums = np.zeros((kinds, 1 << 16), np.int64)

        def chunk() -> pa.RecordBatch:
            nonlocal sums
            ids, out, of = pa.concat_arrays([x[0] for x in parts]), *(np.concatenate([x[i].to_numpy(zero_copy_only=False) for x in parts]) for i in (1, 2))
            length, raw = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
            o = np.append(0, np.cumsum(length))
            raw = B.LOWER[raw]
            start, size = B.words(raw, o, B.SPACE)
            doc = np.searchsorted(o, start, "right") - 1
            body = raw[~B.SPACE[raw]]
            column = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(body)])
            coded = column.dictionary_encode()
            at = np.fromiter((book.setdefault(w, len(book)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            many = max(len(at), 1)
            pair, count = np.unique(doc * many + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            pair_doc, pair_slot = pair // many, pair % many
            if len(book) > sums.shape[1]:
                sums = np.concatenate([sums, np.zeros((kinds, max(sums.shape[1], len(book) - sums.shape[1])), np.int64)], 1)
            for k in range(kinds):
                sums[k, at] += np.bincount(pair_slot, count * (~out & (of == k))[pair_doc], minlength=len(at)).astype(np.int64)
            per = lambda x: np.bincount(x, minlength=len(o) - 1)
            flat = [ids, pa.array(out), pa.array(per(doc).astype(np.int64)), pa.array(per(pair_doc).astype(np.int32)), pa.array(at[pair_slot].astype(np.int32)), pa.array(count.astype(np.int32))]
            return row(number, documents=_packed(pa.RecordBatch.from_arrays(list(map(one, flat)), list(DOCUMENT))))

        def words() -> pa.RecordBatch:
            return row(number, [pa.array(list(book), pa.binary()).cast(pa.string()), *[pa.array(sums[k, : len(book)]) for k in range(kinds)]])

        for batch in batches:
            for a, b, data, o in B.chunks(batch.column(1), CHUNK):
                if parts and size + len(data) > CHUNK:
                    yield chunk()
                    parts, size = [], 0
                    if len(book) >= BOOK:
                        yield words()
                        number, sums = number + 1, np.zeros((kinds, 1 << 16), np.int64)
                        book.clear()
                parts.append((*[batch.column(i).slice(a, b - a) for i in (0, 2, 3)], np.diff(o), data.copy()))
                size += len(data)
        if parts:
            yield chunk()
            yield words()
        B.trim()

    return run, schema


def _piece_counts(path: str, kinds: int):
    """(class, piece, n): how often a piece is in the class's distinct words, as the vocabulary's tokenizer cuts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _library(path)
        total = np.zeros((kinds, model.get_piece_size()), np.int64)
        for batch in batches:
            has = [batch.column(1 + k).to_numpy() > 0 for k in range(kinds)]
            for a, b, _, _ in B.chunks(batch.column(0), SPELL):
                ids = model.encode(batch.column(0).slice(a, b - a).to_pylist(), num_threads=1)
                size = np.fromiter(map(len, ids), np.int64, b - a)
                flat = np.fromiter((x for i in ids for x in i), np.int64, int(size.sum()))
                for k in range(kinds):
                    total[k] += np.bincount(flat[np.repeat(has[k][a:b], size)], minlength=total.shape[1])
        k, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], ["k", "piece", "n"])

    return run


@dataclass(frozen=True)
class Totals:
    """Of all training documents and of each class."""

    n: int  # tokens, ends too
    v: int  # distinct tokens
    ends: np.ndarray  # documents of each class
    tokens: np.ndarray
    types: np.ndarray

    def log10(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 P(word) by class, from counts and the marginals' natural logarithms, both (word, class)."""
        prior = np.maximum(self.types, 1)
        with np.errstate(divide="ignore"):
            p = np.logaddexp(np.log(c), np.log(prior) + spelled) - np.log(self.tokens + prior)
        return (p / math.log(10)).astype("<f4")

    def base(self, c: np.ndarray) -> np.ndarray:
        return _units(np.log10((c + 1) / (self.n + self.v + 1)))


def _units(x: np.ndarray) -> np.ndarray:
    return np.rint(x.astype(float) * UNIT).astype(np.int64)


def _spell(path: str, score: np.ndarray, totals: Totals):
    """Each word's count in all classes and its log10 probability in each, as bytes: a 64-bit and 32-bit numbers."""
    kinds = score.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        for batch in batches:
            c = np.stack([batch.column(1 + k).to_numpy() for k in range(kinds)], 1)
            parts = [own.marginals(data, o, score) for _, _, data, o in B.chunks(batch.column(0), SPELL)]
            logs = totals.log10(c.astype(float), np.concatenate(parts)) if parts else np.zeros((0, kinds), "<f4")
            flat = np.concatenate([c.sum(1).astype("<i8")[:, None].view(np.uint8), logs.view(np.uint8).reshape(len(c), -1)], 1)
            ends = np.arange(len(c) + 1, dtype=np.int32) * (8 + 4 * kinds)
            packed = pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["word", "v"])
        B.trim()

    return run


def _document_scores(totals: Totals, end: np.ndarray):
    """Scores of documents; rows come by book, its words in the order of their numbers and then its chunks of documents.

    ``end`` is the log10 probability of a document's end by class.
    """
    kinds, known_end = len(end), int(totals.ends.sum())
    share = np.log10((totals.ends + 1) / (known_end + kinds))
    last, last_base = _units(end), totals.base(np.array(known_end))

    def chunk(documents: bytes, c: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        ids, held, sizes, lengths, slots, counts = (x.flatten() for x in pa.ipc.open_stream(documents).read_next_batch().columns)
        slots, counts, sizes, lengths = (x.to_numpy() for x in (slots, counts, sizes, lengths))
        at = np.append(0, np.cumsum(lengths))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[at])
        base = (sums(totals.base(c)[slots] * counts) + last_base) / UNIT
        each = np.stack([(sums(p[slots, k] * counts) + last[k]) / UNIT + share[k] for k in range(kinds)], 1)
        top = each.max(1, keepdims=True)
        score = top[:, 0] + np.log10(np.power(10, each - top).sum(1))
        n_known = sums(counts * (c[slots] > 0)) + (known_end > 0)
        found = [ids, held, pa.array(sizes + 1), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(sizes), totals.n, np.int64)), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(found, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, packed, ready = None, [], None
        for batch in batches:
            books, documents = batch.column(0).to_numpy(), batch.column(1).to_numpy() == LAST
            cut = [0, *(np.flatnonzero(books[1:] != books[:-1]) + 1).tolist(), len(books)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if books[a] != book:
                    book, packed, ready = books[a], [], None
                m = b - int(documents[a:b].sum())
                if m > a:
                    data, o = B.buffers(batch.column(2).slice(a, m - a))
                    packed.append(data[o[0] : o[-1]].copy())
                for r in range(m, b):
                    if ready is None:
                        flat = (np.concatenate(packed) if packed else np.zeros(0, np.uint8)).reshape(-1, 8 + 4 * kinds)
                        packed = []
                        ready = np.ascontiguousarray(flat[:, :8]).view("<i8")[:, 0], _units(np.ascontiguousarray(flat[:, 8:]).view("<f4"))
                    yield chunk(batch.column(2)[r].as_py(), *ready)
        B.trim()

    return run


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = None,
    held_out: str = "crc32({id}) % 7 = 2",
    path: str | None = None,
    classes: int = 8,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per input row.

    ``held_out`` is an SQL condition on ``{id}``, the id as text (a null is empty);
    only the other documents are learned from. The ``classes`` most frequent values of
    ``class_col`` in those have counts of their own, all others together. ``path`` is a
    sentencepiece model with byte pieces.
    """
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.expr(held_out.format(id=f"coalesce(cast(`{id_col}` as string), '')"))
    names, of = [], F.lit(0)
    if class_col is not None:
        column = F.col(f"`{class_col}`")
        counts = docs.filter(~held & column.isNotNull()).groupBy(column.alias("k")).count().orderBy(F.desc("count"), "k").limit(classes)
        names = [r["k"] for r in counts.collect()]
        of = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), column).cast("int"), F.lit(0)) if names else F.lit(0)
    kinds = len(names) + 1  # 0 is what is in none of the named ones
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), held.alias("held"), of.alias("k"))
    run, schema = _book_rows(kinds)
    books = materialize(rows.mapInArrow(run, schema), "lm-books")
    ends = {r["k"]: r["n"] for r in rows.filter(~F.col("held")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    ends = np.array([ends.get(k, 0) for k in range(kinds)])
    # Counts of all words by class; words of held-out documents alone have none.
    trained = [f"t{k}" for k in range(kinds)]
    listed = books.filter("words is not null")
    flat = listed.select(F.explode(F.arrays_zip("words", *trained)).alias("w"))
    words = flat.groupBy(F.col("w.words").alias("word")).agg(*[F.sum(f"w.{t}").alias(t) for t in trained])
    words = materialize(words, "lm-words")
    seen = sum((F.col(t) for t in trained), F.lit(0)) > 0
    sums = [x for t in trained for x in (F.coalesce(F.sum(t), F.lit(0)), F.count_if(F.col(t) > 0))]
    got = list(words.agg(F.count_if(seen), *sums).first())
    tokens, types = np.array(got[1::2]) + ends, np.array(got[2::2]) + (ends > 0)
    totals = Totals(int(tokens.sum()), got[0] + int(ends.sum() > 0), ends, tokens, types)
    # Piece scores: one number a piece of the vocabulary and class.
    size = _library(path).get_piece_size()
    found = words.filter(seen).mapInArrow(_piece_counts(path, kinds), "k int, piece int, n long").groupBy("k", "piece").agg(F.sum("n").alias("n"))
    times = np.ones((size + 1, kinds))
    for r in found.collect():
        times[r["piece"], r["k"]] += r["n"]
    times[size] += ends
    scores = np.log(times / times.sum(0))
    end_spelled = np.log(times[size] / (times[lattice(path).starts].sum(0) + times[size]))  # the share of ends where a word may start
    spelled = materialize(words.mapInArrow(_spell(path, scores[:size], totals), "word string, v binary"), "lm-marginals")
    discard(words)
    # Back to the books: a book's words and its chunks of documents in one partition, in order.
    back = listed.select("book", F.posexplode("words").alias("slot", "word")).join(spelled, "word").select("book", "slot", "v")
    documents = books.filter("documents is not null").select("book", F.lit(LAST).alias("slot"), F.col("documents").alias("v"))
    met = back.unionByName(documents)
    met = met.repartition("book").sortWithinPartitions("book", "slot")
    end = totals.log10(ends.astype(float)[None, :], end_spelled[None, :])[0]
    return met.mapInArrow(
        _document_scores(totals, end), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op13_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return score(docs, class_col="lang")
