"""Operators held against plain re-statements of their methods that share no code with them."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from test_llm_operators import DOCS, fresh_library, library_ids

import corpus_pipeline
from tessella.llm import fingerprint, mixing, packing, quality, toxicity
from tessella.llm.shared import ship

MASK = (1 << 64) - 1


def scrambled(h):
    """The 64-bit finaliser with the published constants."""
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def windows(text: bytes):
    """All windows of 32 bytes of a text with 26 zero bytes on both sides, with their quantised entropy level."""
    if not text:
        return []
    padded = b"\0" * 26 + text + b"\0" * 26
    out = []
    for i in range(len(padded) - 31):
        w = padded[i : i + 32]
        # k log2 k over the counts, each step rounded to 1/64, then levels of 8/64
        total = sum(sum(round_half(f(k) * 64) - round_half(f(k - 1) * 64) for k in range(1, c + 1)) for c in collections.Counter(w).values())
        out.append((w, total >> 3))
    return out


def f(k):
    return k * math.log2(k) if k > 0 else 0.0


def round_half(x):
    return int(np.round(x))


def plain_fingerprints(texts: list[bytes]):
    """Ranks, features and chained filters by loops over windows."""
    count = collections.Counter(level for t in texts for _, level in windows(t))
    flat = int((32 * 5 - 32) * 64) >> 3
    top = (int(32 * 5 * 64) >> 3) + 2
    order = sorted(range(top), key=lambda v: (v > flat, count[v], v))
    rank = {v: i for i, v in enumerate(order)}
    out = []
    for t in texts:
        w = windows(t)
        votes = collections.Counter()
        # every run of 32 neighbouring windows that has one of the text's windows votes once
        for start in range(-31, len(w)) if w else ():
            run = range(max(0, start), min(len(w), start + 32))
            votes[min(run, key=lambda i: (rank[w[i][1]], i))] += 1
        chosen = sorted(i for i, n in votes.items() if n >= 8)
        if w and not chosen:
            most = max(votes.values())
            chosen = [min(i for i in votes if votes[i] == most)]
        filters = []
        for k, i in enumerate(chosen):
            if k % 128 == 0:
                filters.append(set())
            h = 0
            for j in range(4):
                word = int.from_bytes(w[i][0][8 * j : 8 * j + 8], "little")
                h = scrambled(((h ^ word) * 0x9E3779B97F4A7C15 + j) & MASK)
            filters[-1] |= {h >> 11 * j & 2047 for j in range(5)}
        out.append(filters)
    return out


def bits_of(text: str):
    raw = base64.b64decode(text)
    return [{8 * i + b for i, x in enumerate(raw[a : a + 256]) for b in range(8) if x >> b & 1} for a in range(0, len(raw), 256)]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    one = lambda x, ys: max(
        min(1.0, max(0.0, (len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9))) for y in ys
    )
    both = lambda x, y: sum(len(p) * one(p, y) for p in x) / sum(map(len, x))
    return {both(a, b)} if len(a) < len(b) else {both(b, a)} if len(b) < len(a) else {both(a, b), both(b, a)}


def test_fingerprints_against_loops(spark):
    ship(spark)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(40)] + ["Häuser", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789", "été"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 200, 900]))) for _ in range(24)]
    texts += [texts[3], texts[3] + " more", "", "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ranks = fingerprint.corpus_ranks(df)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, ranks).collect()}
    want = plain_fingerprints([(t or "").encode() for t in texts])
    assert any(len(x) > 1 for x in want)  # chained filters
    for i, filters in enumerate(want):
        assert bits_of(got[i]["fingerprint"]) == filters
        n = want[(i + 1) % len(want)]
        expect = plain_likeness(filters, n)
        near = got[i]["near_next"]
        assert any(near == pytest.approx(x, abs=1e-9) for x in (expect if isinstance(expect, set) else {expect}))
        follow = (texts[(i + 1) % len(texts)] or "")[: len(texts[i] or "") // 2]
        own = texts[i] or ""
        changed = own[: len(own) - len(own) // 2] + follow
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        edit = bits_of(got[i]["edited_fingerprint"])
        expect = plain_likeness(filters, edit)
        assert any(got[i]["near_edited"] == pytest.approx(x, abs=1e-9) for x in (expect if isinstance(expect, set) else {expect}))


def ordinal_loss(rows, grades, weights, thresholds, l2):
    """Mean-free cumulative-link loss by its definition."""
    out = l2 * len(rows) * float(weights @ weights) / 2
    for r, g in zip(rows, grades):
        feats, counts = np.frombuffer(r["feats"], np.int32), np.frombuffer(r["counts"], np.int32)
        z = float((weights[feats] * np.log1p(counts)).sum())
        for k, t in enumerate(thresholds, 1):
            p = 1 / (1 + math.exp(-(z - t)))
            out -= math.log(p if g >= k else 1 - p)
    return out


def test_ordinal_fit_reaches_a_minimum():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        y = int(i % 3 == 0)
        feats = np.sort(rng.choice(6, rng.integers(1, 5), replace=False)).astype(np.int32)
        feats = feats if not y or rng.random() < 0.2 else np.unique(np.append(feats, 5)).astype(np.int32)
        rows.append({"label": y, "feats": feats.tobytes(), "counts": rng.integers(1, 6, len(feats)).astype(np.int32).tobytes()})
    vocab = toxicity.Vocabulary(np.arange(6, dtype=np.uint64))
    l2 = 1e-3
    m = toxicity.fit(rows, vocab, l2=l2, steps=6000, rate=0.02)
    hits = np.array([np.frombuffer(r["counts"], np.int32).sum() for r in rows])
    y = np.array([r["label"] for r in rows])
    grades = np.where(y == 1, 1 + (hits > np.median(hits[y == 1])), 0)
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    best, step = ordinal_loss(rows, grades, m.weights, m.thresholds, l2), 1e-3
    # the slope by differences is flat in each weight and threshold
    for i in range(6):
        w = m.weights.copy()
        w[i] += step
        up = ordinal_loss(rows, grades, w, m.thresholds, l2)
        w[i] -= 2 * step
        down = ordinal_loss(rows, grades, w, m.thresholds, l2)
        assert abs(up - down) / (2 * step) < 0.5 and min(up, down) > best - 1e-3
    for i in range(2):
        t = m.thresholds.copy()
        t[i] += step
        up = ordinal_loss(rows, grades, m.weights, t, l2)
        t[i] -= 2 * step
        assert abs(up - ordinal_loss(rows, grades, m.weights, t, l2)) / (2 * step) < 0.5
    # expected severity is the sum of the probabilities of reaching each grade
    z = np.array([0.3, -1.0])
    p = m.at_least(z)
    for row, v in zip(p, z):
        assert row.sum() == pytest.approx(sum(1 / (1 + math.exp(-(v - t))) for t in m.thresholds))


def word_features(text: str):
    """Words, pairs, and n-grams of 3 to 5 bytes inside words with the boundary before them, as plain values."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    out = [("w", w) for w in words]
    out += [("p", ("again",) if a == b else (a, b)) for a, b in zip(words, words[1:])]
    for w in words:
        for n in (3, 4, 5):
            # the first byte may be the boundary, the others are inside the word
            out += [("g", n, x) for x in [(b" " + w)[i : i + n] for i in range(len(w) + 2 - n)]]
    return out


def test_quality_bags_are_the_features_of_each_text():
    import pyarrow as pa

    texts = ["the cat  sat\non the the mat", "", "x", "Häuser und und Höfe, lange Wörter", "a b a b", None]
    batch = pa.record_batch([pa.array(texts), pa.array([1] * len(texts), pa.int32())], ["text", "label"])
    bags = [(np.frombuffer(f, np.int32), np.frombuffer(c, np.float32)) for b in quality._bags(iter([batch])) for f, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    slot_of, feature_of = {}, collections.defaultdict(set)
    for t, (slots, counts) in zip(texts, bags):
        feats = collections.Counter(word_features(t or ""))
        assert counts.sum() == sum(feats.values())
        # bucket counts are the features' counts, but for collisions, which are rare in 2^18
        assert sorted(map(int, counts)) == sorted(feats.values()) or len(slots) < len(feats)
        for s in slots.tolist():
            feature_of[s].add(t)
        slot_of[t] = set(slots.tolist())
    assert slot_of["a b a b"] & slot_of["x"] == set()
    # a score is the logistic of the mean of its features' logits and the bias
    model = quality.EmbeddingModel(np.random.default_rng(1).normal(size=1 << quality.BITS), 0.3)
    got = model.score(pa.array(texts))
    for (slots, counts), s in zip(bags, got):
        mean = float((model.logit[slots].astype(float) * counts).sum() / counts.sum()) if len(slots) else 0.0
        assert s == pytest.approx(1 / (1 + math.exp(-(mean + 0.3))), abs=1e-6)


def test_quality_scores_do_not_depend_on_neighbours():
    import pyarrow as pa

    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta", "gämma"]) for _ in range(500))
    others = [" ".join(rng.choice(["delta", "eta", "x"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    model = quality.EmbeddingModel(np.random.default_rng(3).normal(size=1 << quality.BITS), 0.0)
    alone = model.score(pa.array([text]))[0]
    assert all(model.score(pa.array([*others[:k], text, *others[k:]]))[k] == alone for k in range(0, 40, 7))


@pytest.fixture(scope="module")
def corpus(spark):
    ship(spark)
    rng = random.Random(9)
    rows = [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(rng.choice([5, 40, 300, 3000]))), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src5", "src6", None]), 0, "x") for i in range(160)]
    rows += [(200, None, "en", "src0", 0, "x"), (None, "no id", "en", "src0", 0, "x"), (201, rows[0][1], "en", "src0", 0, "x"), (201, rows[0][1], "en", "src0", 0, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache(), rows


def water(caps, weights, total):
    """Fill children by weight; what a full child can't take goes to its siblings."""
    got, open_, left = {}, set(caps), total
    while open_:
        share = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if caps[k] <= share * weights[k]]
        if not full:
            return got | {k: share * weights[k] for k in open_}
        for k in full:
            got[k] = caps[k]
            left -= caps[k]
            open_.discard(k)
    return got


def test_mixing_stage_in_full(spark, corpus):
    """Budgets down the tree and the prefix of each leaf, by loops."""
    df, rows = corpus
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaf_of = lambda r: (f"d{int(re.search('[0-9]+$', r[3] or '0')[0]) % 4}", r[2] or "(none)", r[3] or "(none)")
    leaves = collections.defaultdict(list)
    for r in rows:
        leaves[leaf_of(r)].append(r)
    tokens = {k: sum(count(r[1]) for r in v) for k, v in leaves.items()}
    weight = lambda level, v: mixing.WEIGHTS[level].get(v, mixing.DEFAULT_WEIGHT[level])
    budget = {(): float(math.floor(sum(tokens.values()) * 0.75))}
    for depth, level in enumerate(("domain", "lang", "source")):
        nxt = {}
        for node, b in budget.items():
            children = {k[depth] for k in tokens if k[:depth] == node}
            caps = {c: sum(n for k, n in tokens.items() if k[: depth + 1] == (*node, c)) for c in children}
            for c, x in water(caps, {c: weight(level, c) for c in children}, b).items():
                nxt[(*node, c)] = x
        budget = nxt
    want = collections.Counter()
    for leaf, members in leaves.items():
        b, total = math.floor(budget[leaf] + 1e-9), tokens[leaf]
        whole = b // total if total else 0
        if whole:
            want.update(members)
            continue
        key = lambda r: hashlib.md5(f"17|0|{'null' if r[0] is None else r[0]}".encode()).hexdigest()
        groups, run = collections.defaultdict(list), 0
        for r in members:
            groups[key(r)].append(r)
        for k in sorted(groups):
            run += sum(count(r[1]) for r in groups[k])
            if run > b:
                break
            want.update(groups[k])
    got = collections.Counter(tuple(r) for r in corpus_pipeline.source_mixing_stage(spark, df, "").collect())
    assert got == want and 0 < sum(got.values()) < len(rows)


def test_packing_stage_in_full(spark, corpus):
    """Every piece with its ids once, places gapless, and no two sequences that would fit in one."""
    df, rows = corpus
    got = corpus_pipeline.best_fit_packing_stage(spark, df, "").collect()
    fresh, want = fresh_library(), collections.Counter()
    for r in rows:
        ids = library_ids(fresh, r[1]) + (0).to_bytes(4, "little")
        n, start, k = len(ids) // 4, 0, 0
        while start < n:
            size = (n - 1) % 2048 + 1 if k == 0 else 2048
            want[(r[0], k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))] += 1
            start, k = start + size, k + 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    fill = []
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
        fill.append(at)
    fill.sort()
    assert len(fill) < 2 or fill[0] + fill[1] > 2048
    # no more sequences than first-fit decreasing makes
    room = []
    for n in sorted((r["length"] for r in got), reverse=True):
        i = next((i for i, x in enumerate(room) if x >= n), None)
        if i is None:
            room.append(2048 - n)
        else:
            room[i] -= n
    assert len(fill) <= len(room)


def test_best_two_fit_against_a_plain_packer():
    """Bin by bin: largest first, then the smallest piece against the best pair, one bin at a time."""

    def plain(lengths, capacity):
        left, out = sorted(lengths, reverse=True), []
        while left:
            bin_, gap = [], capacity
            for x in list(left):
                if x <= gap:
                    bin_.append(x)
                    left.remove(x)
                    gap -= x
            if gap and len(bin_) > 1:
                small = bin_[-1]
                pairs = [(a + b, max(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
                if pairs:
                    total, a = max(pairs)
                    bin_.remove(small)
                    left.remove(a)
                    left.remove(total - a)
                    bin_ += [a, total - a]
                    left = sorted([*left, small], reverse=True)
            out.append(tuple(sorted(bin_)))
        return sorted(out)

    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 60))]
        got = [tuple(sorted(x for x, k in pattern for _ in range(k))) for pattern, m in packing.best_two_fit(dict(collections.Counter(lengths)), 40) for _ in range(m)]
        assert sorted(got) == plain(lengths, 40)
