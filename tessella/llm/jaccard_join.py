"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct k-word shingles. Two documents link when their
Jaccard similarity reaches a threshold t. With all tokens in one global order,
rarest first, linked sets x and y share at least l tokens of their first
n - ceil(t n) + l, for any l. A longer prefix costs more look-ups and asks for
more shared tokens, so each document gets its own l from the estimated number of
candidates in its prefix (the sum of the tokens' document frequencies), and a pair
must share the smaller of both documents' l before it is verified.

Steps
1. Texts are hashed to sets in one map; the sets go to files in the shared folder,
   a row per document with a 128-bit signature of its set to a table. Documents
   with equal sets are one class from here on; copies inside a file are kept once.
2. Document frequencies: each file's distinct tokens go, delta-coded in ranges of
   the hash, to one task a range, which sends back those found at least twice.
   A token, however common, is one entry a file there.
3. Each file's documents get their order and prefixes. A token found once can
   link nothing, so most documents end here without a candidate.
4. Star round: every document of a token's list is compared with the list's first
   class only, so a group of near copies costs as many comparisons as members.
5. Components of these links; then every list is finished exactly: only pairs of
   different components are compared. Short lists make pairs by a join and count
   shared prefix tokens. Long lists are dealt in blocks of bounded size; as most of
   a list is one component, pairs inside its main component are not dealt. In a
   block matrix products count the shared prefix tokens of all pairs, those that
   share as many as the multi-match rule asks for are verified on their whole sets
   in the same way, and only a spanning forest of the links leaves.
6. Components of all links; each takes its smallest document id.

No link is missed and no list, candidate or partner is capped. Sets are compared
by 48-bit token hashes (sizes by 64-bit ones). Where a token, a document, a class
or a component may hold a large share of the rows, it is joined by ``attach``, which
broadcasts keys and numbers but no sets.

Defined cases: a null text is empty; a text without words has no shingle and links
with nothing, itself its component; fewer words than k are one shingle; rows that
repeat are one class and share a component; a null id takes part, and a component
of null ids only has a null id; an empty table gives an empty table; other columns
are not read. Words are runs outside ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.components import attach, components, mark_repeats
from tessella.llm.shared import fresh_path, in_struct, materialize, read_file, write_once

CHUNK = 16 << 20  # bytes of text in one file of sets
COST = 16  # estimated candidates from which prefixes grow
SHORT_LIST = 48  # lists up to this length make pairs by a join
BLOCK = 512  # documents on one side of a block
SLAB = 4096  # tokens in one matrix product


def shingle_sets(data: np.ndarray, o: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size of each text, all sets' sorted 64-bit tokens) of texts given by bytes and offsets."""
    data = B.LOWER[data]
    s, length = B.words(data, o, B.SPACE)
    h = B.word_hashes(data, s, length)
    first = np.searchsorted(s, o)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        # shingles start at each word with k - 1 more of the text after it
        x = h.copy()
        for j in range(1, min(k, len(h))):
            x[: len(h) - j] = B.mix(x[: len(h) - j] * B.MULTIPLIER + h[j:])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - first[:-1][doc]
    whole = at + k <= n[doc]
    for i in np.flatnonzero((n > 0) & (n < k)):
        y = h[first[i] : first[i] + 1]
        for w in range(first[i] + 1, first[i + 1]):
            y = B.mix(y * B.MULTIPLIER + h[w])
        x[first[i]] = B.mix(y + np.uint64(n[i]))[0]
        whole[first[i]] = True
    x, doc = x[whole], doc[whole]
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=len(n)), x[new]


def _six(tokens: np.ndarray) -> bytes:
    """48-bit tokens in 6 bytes each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _write_sets(out: str, k: int):
    names = ["doc_id", "rid", "n", "key", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part = TaskContext.get().partitionId(), 0
        ids, rids, sizes, keys, sums, kept, known, size = [], [], [], [], [], [], {}, 0

        def flush():
            nonlocal part, ids, rids, sizes, keys, sums, kept, known, size
            base = (task << 44) | (part << 24)
            lengths = np.array([len(x) for x in kept], "<u4")
            body = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            write_once(f"{out}/{task << 20 | part}", [np.array([len(kept)], "<u4").tobytes(), lengths.tobytes(), _six(body)])
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids),
                    pa.concat_arrays(rids),
                    pa.array(sizes, pa.int64()),
                    pa.array([None if x < 0 else base | x for x in keys], pa.int64()),
                    pa.array([x[0] for x in sums], pa.int64()),
                    pa.array([x[1] for x in sums], pa.int64()),
                ],
                names,
            )
            part += 1
            ids, rids, sizes, keys, sums, kept, known, size = [], [], [], [], [], [], {}, 0
            return rows

        for batch in batches:
            for a, b, data, o in B.chunks(batch.column(1)):
                n, tokens = shingle_sets(data, o, k)
                cut = np.cumsum(n) - n
                ids.append(batch.column(0).slice(a, b - a))
                rids.append(batch.column(2).slice(a, b - a))
                short = tokens >> np.uint64(16)
                for i, (c, at) in enumerate(zip(n.tolist(), cut.tolist())):
                    t = tokens[at : at + c]
                    sizes.append(c)
                    if not c:
                        keys.append(-1)
                        sums.append((0, 0))
                        continue
                    # sums of mixed tokens: 128 bits of the whole set
                    with np.errstate(over="ignore"):
                        sig = (int(B.mix(t).sum().view(np.int64)), int(B.mix(t ^ B.MULTIPLIER).sum().view(np.int64)))
                    at_known = known.setdefault((sig, c), len(kept))
                    if at_known == len(kept):
                        kept.append(np.unique(short[at : at + c]))
                    keys.append(at_known)
                    sums.append(sig)
                size += len(data)
                if size >= CHUNK or len(kept) >= 1 << 23:
                    yield flush()
        if sizes:
            yield flush()
        B.trim()

    return run


def _load(out: str, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(set sizes, tokens) of a file."""
    raw = read_file(f"{out}/{m}")
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), _from_six(raw[4 + 4 * n :])


# Frequencies are counted on the upper 40 of a token's 48 bits.
_DROP = np.uint64(8)


def _pack40(sorted_tokens: np.ndarray) -> bytes:
    """Differences of sorted 40-bit numbers, 3 bytes each where all fit, else 5."""
    d = np.diff(sorted_tokens, prepend=np.uint64(0))
    first, d = d[:1], d[1:]
    wide = 3 if not len(d) or int(d.max()) < 1 << 24 else 5
    return bytes([wide]) + first.astype("<u8").tobytes() + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    wide = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, wide)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[0] = np.frombuffer(raw, np.uint8, 8, 1)
    d[1:, :wide] = body
    return np.cumsum(d.reshape(-1).view("<u8"))


def _token_blocks(out: str, ranges: int):
    """Per file and hash range: the distinct tokens, and the counts of those found more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column(0).to_pylist():
                _, tokens = _load(out, m)
                t, c = np.unique(tokens >> _DROP, return_counts=True)
                cut = np.searchsorted(t, (np.arange(ranges + 1, dtype=object) * (1 << 40) // ranges).astype(np.uint64))
                for r in np.flatnonzero(np.diff(cut)):
                    x, k = t[cut[r] : cut[r + 1]], c[cut[r] : cut[r + 1]]
                    more = np.flatnonzero(k > 1)
                    yield pa.record_batch(
                        [
                            pa.array([r], pa.int32()),
                            pa.array([m], pa.int64()),
                            pa.array([_pack40(x)], pa.binary()),
                            pa.array([more.astype("<u4").tobytes()], pa.binary()),
                            pa.array([k[more].astype("<u4").tobytes()], pa.binary()),
                        ],
                        ["r", "m", "tokens", "at", "counts"],
                    )

    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file of one hash range: its tokens of frequency 2 or more, with the frequency."""
    held: dict[int, list] = {}
    for batch in batches:
        for r, m, tokens, at, counts in zip(*[c.to_pylist() for c in batch.columns]):
            held.setdefault(r, []).append((m, tokens, at, counts))
    for blocks in held.values():
        parts, weights = [], []
        for _, tokens, at, counts in blocks:
            t = _unpack40(tokens)
            w = np.ones(len(t), np.int64)
            w[np.frombuffer(at, "<u4")] = np.frombuffer(counts, "<u4")
            parts.append(t)
            weights.append(w)
        allt, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(inverse, np.concatenate(weights), minlength=len(allt))
        a = 0
        for (m, *_), t in zip(blocks, parts):
            d = df[inverse[a : a + len(t)]]
            a += len(t)
            keep = d >= 2
            if keep.any():
                yield pa.record_batch(
                    [pa.array([m], pa.int64()), pa.array([_pack40(t[keep])], pa.binary()), pa.array([d[keep].astype("<u4").tobytes()], pa.binary())],
                    ["m", "tokens", "df"],
                )
    B.trim()


def _prefixes(out: str, percent: int):
    """Rows of the documents with a shared token in their prefix: key, n, l, base, prefix, tokens."""

    def of(m: int, shared: np.ndarray, df: np.ndarray) -> pa.RecordBatch | None:
        n, tokens = _load(out, m)
        if not len(shared):
            return None
        order = np.argsort(shared, kind="stable")
        shared, df = shared[order], df[order]
        top = tokens >> _DROP
        at = np.minimum(np.searchsorted(shared, top), len(shared) - 1)
        hit = shared[at] == top
        doc = np.repeat(np.arange(len(n)), n)[hit]
        tok, freq = tokens[hit], df[at[hit]].astype(np.int64)
        order = np.lexsort((tok, freq, doc))
        doc, tok, freq = doc[order], tok[order], freq[order]
        have = np.bincount(doc, minlength=len(n))
        need = -(-percent * n // 100)
        base = np.minimum(n - need + 1 - (n - have), have)  # shared tokens of the plain prefix
        first = np.cumsum(have) - have
        within = np.arange(len(doc)) - first[doc]
        cost = np.bincount(doc, (freq - 1) * (within < base[doc]), minlength=len(n))
        grow = np.where(cost > COST, 1 + 2 * np.floor(np.log2(np.maximum(cost, 1) / COST)).astype(np.int64), 1)
        level = np.maximum(1, np.minimum(need, grow))
        take = np.where(base > 0, np.minimum(have, base + level - 1), 0)
        some = np.flatnonzero(take > 0)
        if not len(some):
            return None
        in_prefix, in_set = within < take[doc], (take > 0)[doc]
        lists = lambda x, size: pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(x.astype(np.int64))
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array((m >> 20 << 44) | ((m & ((1 << 20) - 1)) << 24) | some, pa.int64()),
                pa.array(n[some]),
                pa.array(level[some], pa.int32()),
                pa.array(base[some], pa.int32()),
                lists(tok[in_prefix], take[some]),
                lists(tok[in_set], have[some]),
            ],
            ["key", "n", "l", "base", "prefix", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has whole files, sorted by file
        held, m0 = [], None
        for batch in batches:
            for m, tokens, df in zip(*[c.to_pylist() for c in batch.columns]):
                if m != m0 and held:
                    got = of(m0, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    if got is not None:
                        yield got
                    held = []
                m0 = m
                held.append((_unpack40(tokens), np.frombuffer(df, "<u4")))
        if held:
            got = of(m0, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            if got is not None:
                yield got
        B.trim()

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; ``a`` may be of many pairs.

    Sets meet pairs in shuffles, never by broadcast: a set is as long as its text. The
    pairs of a frequent ``a`` are two numbers each, which adaptive execution splits.
    """
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _fits(na, nb, percent: int):
    return (100 * F.col(na) >= percent * F.col(nb)) & (100 * F.col(nb) >= percent * F.col(na))


def _overlaps(doc: np.ndarray, tok: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens each document of ``left`` shares with each of ``right``."""
    v, tok, count = np.unique(tok, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    doc, tok = doc[count[tok] > 1], new[tok[count[tok] > 1]]
    order = np.argsort(tok, kind="stable")
    doc, tok = doc[order], tok[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, int((count > 1).sum()), SLAB):
        a, b = np.searchsorted(tok, [s, s + SLAB])
        x = np.zeros((n, SLAB), np.float32)
        x[doc[a:b], tok[a:b] - s] = 1
        out += x[left] @ x[right].T
    return out


def _forest(ok: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest document that each of ``n`` documents reaches by links between ``left`` and ``right``."""
    label = np.arange(n)
    while True:
        was = label.copy()
        for rows, columns, links in ((left, right, ok), (right, left, ok.T)):
            best = np.where(links, label[columns][None, :], n).min(1, initial=n)
            label[rows] = np.minimum(label[rows], best)
        label = label[label]
        if (label == was).all():
            return label


def _block_links(percent: int):
    """Pairs (a, b) that join the documents of different components that link inside one block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, n, level, take, comp, side = (table.column(c).to_numpy() for c in ("key", "n", "l", "take", "comp", "side"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        lists = table.column("tokens").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.diff(lists.offsets.to_numpy())
        tok, doc = lists.flatten().to_numpy(), np.repeat(np.arange(len(key)), sizes)
        in_prefix = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < take[doc]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if i != j else np.flatnonzero(side == 0)
        shared = _overlaps(doc[in_prefix], tok[in_prefix], len(key), left, right)
        nl, nr = n[left][:, None], n[right][None, :]
        ok = shared >= np.minimum(level[left][:, None], level[right][None, :])
        ok &= (comp[left][:, None] != comp[right][None, :]) & (100 * nl >= percent * nr) & (100 * nr >= percent * nl)
        # Only rows and columns with a candidate are verified.
        rows, columns = ok.any(1), ok.any(0)
        left, right, ok = left[rows], right[columns], ok[rows][:, columns]
        if ok.any():
            own = np.zeros(len(key), bool)
            own[left] = own[right] = True
            both = _overlaps(doc[own[doc]], tok[own[doc]], len(key), left, right).astype(np.int64)
            ok &= 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        label = _forest(ok, left, right, len(key))
        some = np.flatnonzero(label != np.arange(len(key)))
        a, b = key[label[some]], key[some]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, n, class, comp), a row per input row.

    ``rid`` is xxhash64 of the text, ``class`` numbers equal sets and ``comp`` the
    linked classes; both are null for an empty set.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = fresh_path(spark, "shingles")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.xxhash64(text_col).alias("_rid"))
    rows = rows.mapInArrow(_write_sets(out, k), f"doc_id {kind}, rid long, n long, key long, s1 long, s2 long")
    rows = materialize(rows, "shingle-rows")
    # Classes of equal sets, each with its smallest key.
    members = rows.filter("key is not null").groupBy("s1", "s2", "n").agg(F.min("key").alias("class"))
    members = materialize(members, "shingle-classes")
    # Frequencies and prefixes.
    files = rows.filter("key is not null").select(F.expr("((key >> 44) << 20) | ((key >> 24) & 1048575)").alias("m")).distinct()
    files = materialize(files, "shingle-files").repartition(ranges)
    blocks = files.mapInArrow(_token_blocks(out, ranges), "r int, m long, tokens binary, at binary, counts binary")
    shared = blocks.repartitionById(ranges, F.col("r")).mapInArrow(_shared_tokens, "m long, tokens binary, df binary")
    shared = shared.repartition(ranges, "m").sortWithinPartitions("m")
    sets = shared.mapInArrow(_prefixes(out, percent), "key long, n long, l int, base int, prefix array<bigint>, tokens array<bigint>")
    sets = materialize(sets.join(members.select(F.col("class").alias("key")), "key", "left_semi"), "shingle-prefixes")
    post = sets.select("key", "n", "l", "base", F.posexplode("prefix").alias("at", "token"))
    post = post.select("token", "key", "n", "l", (F.col("at") < F.col("base")).alias("plain"))
    # Star round.
    first = post.groupBy("token").agg(F.min(F.struct("key", "n")).alias("first"), F.count("*").alias("size")).filter("size > 1")
    first = materialize(first.select("token", F.col("first.key").alias("a"), F.col("first.n").alias("na"), "size"), "shingle-lists")
    hot = materialize(first.orderBy(F.desc("size"), "token").limit(ranges).select("token"), "shingle-long-lists")
    star = attach(post, first, ["token"], hot=hot).filter(F.col("key") > F.col("a")).filter(_fits("n", "na", percent))
    star = materialize(star.select("a", F.col("key").alias("b")).distinct(), "shingle-star-pairs")
    links = materialize(_linked(star, sets, percent), "shingle-star-links")
    labels = components(links)
    # Exact finish: lists with more than one component.
    labelled = sets.select("key").join(labels, F.col("key") == F.col("node"), "left").select("key", F.coalesce("comp", "key").alias("comp"))
    long = F.col("size") > SHORT_LIST
    post = post.join(labelled, "key")
    several = post.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("mixed"), F.count("*").alias("size"), F.min_by("comp", "key").alias("main"))
    several = materialize(several.filter("mixed").select("token", "size", "main"), "shingle-several")
    hot = several.orderBy(F.desc("size"), "token").limit(ranges).select("token")
    post = materialize(attach(post, several, ["token"], hot=hot), "shingle-mixed-lists")
    in_long = materialize(post.groupBy("key").agg(F.sum(long.cast("int")).alias("g")), "shingle-long-counts")
    side = post.filter(~long).join(in_long, "key").select("token", "key", "n", "l", "comp", "g")
    right = side.select("token", *[F.col(c).alias("r_" + c) for c in ("key", "n", "l", "comp", "g")])
    pairs = side.join(right, "token").filter((F.col("key") < F.col("r_key")) & (F.col("comp") != F.col("r_comp")) & _fits("n", "r_n", percent))
    pairs = pairs.groupBy(F.col("key").alias("a"), F.col("r_key").alias("b")).agg(
        F.count("*").alias("shared"), F.min(F.least("l", "r_l") - F.least("g", "r_g")).alias("need")
    )
    # Long lists: blocks (token, i, j) of two parts of about BLOCK documents each: parts of the
    # main component come first and meet only those of the others, which meet all.
    dealt = post.filter(long & F.col("plain")).withColumn("own", F.col("comp") == F.col("main"))
    counts = dealt.groupBy("token").agg(F.count_if("own").alias("of_main"), F.count_if(~F.col("own")).alias("of_others"))
    counts = counts.select("token", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(c) for c in ("of_main", "of_others")])
    counts = materialize(counts, "shingle-parts")
    dealt = attach(dealt, counts, ["token"], hot=hot).filter("of_others > 0")
    part = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    dealt = dealt.withColumn("p", F.when(F.col("own"), part("of_main")).otherwise(F.col("of_main") + part("of_others")))
    meets = F.sequence(F.when(F.col("own"), F.col("of_main")).otherwise(0), F.col("of_main") + F.col("of_others") - 1)
    dealt = dealt.select("token", "key", "comp", "p", meets.alias("meets")).join(sets.select("key", "n", "l", F.size("prefix").alias("take"), "tokens"), "key")
    dealt = dealt.select("token", "key", "n", "l", "take", "comp", "tokens", "p", F.explode("meets").alias("other"))
    low, high = F.least("p", "other").alias("i"), F.greatest("p", "other").alias("j")
    dealt = dealt.select("token", "key", "n", "l", "take", "comp", "tokens", low, high, (F.col("p") > F.col("other")).cast("int").alias("side"))
    blocks = dealt.groupBy("token", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    more = _linked(materialize(pairs.filter("shared >= need").select("a", "b"), "shingle-pairs"), sets, percent)
    links = materialize(links.union(more).union(blocks), "shingle-links")
    labels = components(links)
    # Back to the rows; a class may be of many rows.
    joined = members.join(labels, F.col("class") == F.col("node"), "left")
    joined = joined.select("s1", "s2", "n", "class", F.coalesce("comp", "class").alias("comp"))
    some = attach(rows.filter("key is not null"), joined, ["s1", "s2", "n"])
    bare = rows.filter("key is null").withColumns({"class": F.lit(None).cast("long"), "comp": F.lit(None).cast("long")})
    return some.unionByName(bare).select("doc_id", "rid", "n", "class", "comp")


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, component_id), a row per input row; see the module's text."""
    placed = materialize(classes(docs, k, percent, id_col, text_col), "shingle-classes-of-rows")
    some = placed.filter("comp is not null")
    some = attach(some, some.groupBy("comp").agg(F.min("doc_id").alias("component_id")), ["comp"])
    bare = placed.filter("comp is null").withColumn("component_id", F.col("doc_id"))
    return some.unionByName(bare).select("doc_id", F.col("n").alias("n_shingles"), "class", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each component, and all without a word.

    Of a component, the row with the smallest doc_id (null last), then text hash; of
    rows that repeat both, one.
    """
    placed = materialize(classes(docs, k, percent), "shingle-classes-of-rows")
    first = placed.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "rid")).alias("f"))
    stay = first.select(F.coalesce("f.doc_id", F.lit(0)).alias("i"), F.col("f.no").alias("no"), "f.rid", F.lit(True).alias("one"))
    bare = placed.filter("comp is null").select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.isnull("doc_id").alias("no"), "rid")
    stay = stay.union(bare.distinct().withColumn("one", F.lit(False)))
    rows = docs.select(in_struct(docs))
    rows = rows.select("row", F.coalesce("row.doc_id", F.lit(0)).alias("i"), F.isnull("row.doc_id").alias("no"), F.xxhash64("row.text").alias("rid"))
    keys = ["i", "no", "rid"]
    met = rows.join(stay, keys)
    counts = placed.groupBy(F.coalesce("doc_id", F.lit(0)).alias("i"), F.isnull("doc_id").alias("no"), "rid").agg(F.count("*").alias("times"))
    counts = counts.join(stay.filter("one"), keys, "left_semi")
    return mark_repeats(met, keys, counts).filter("not one or not again").select("row.*")


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM words WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * both_ >= 85 * (a.n + b.n - both_)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT r.x AS doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r.y) AS component_id
FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.x GROUP BY r.x
"""


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return similarity_components(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")
