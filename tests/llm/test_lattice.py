"""op13 against plain dictionaries and enumerated segmentations."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessella.llm import lattice
from tessella.llm.shared import ship

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=lattice.vocabulary_path())


@pytest.fixture(scope="module")
def pieces(library):
    n = library.get_piece_size()
    known = {library.id_to_piece(i): i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    return {p: i for p, i in known.items() if "▁" not in p[1:]}, [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def all_cuts(word, share, pieces, path=1.0, at=0):
    """Probabilities of all segmentations of the word with its mark; by enumeration."""
    known, by_byte = pieces
    text = "▁" + word
    if at == len(text):
        yield path
        return
    for e in range(at + 1, min(len(text), at + 16) + 1):
        p = text[at:e]
        if p in known and (at == 0 or p[0] != "▁"):
            yield from all_cuts(word, share, pieces, path * share[known[p]], e)
    c = text[at]
    if at and (c not in known or c == "▁"):
        yield from all_cuts(word, share, pieces, path * math.prod(share[by_byte[b]] for b in c.encode()), at + 1)


def summed(word, share, pieces):
    """The same sum place by place."""
    known, by_byte = pieces
    text, a = "▁" + word, [0.0] * (len(word) + 2)
    a[0] = 1.0
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 16), e):
            p = text[s:e]
            if p in known and (s == 0 or p[0] != "▁"):
                a[e] += a[s] * share[known[p]]
        c = text[e - 1]
        if e > 1 and (c not in known or c == "▁"):
            a[e] += a[e - 1] * math.prod(share[by_byte[b]] for b in c.encode())
    return a[-1]


def test_marginal_is_the_sum_over_all_segmentations(library, pieces):
    rng = np.random.default_rng(3)
    share = rng.dirichlet(np.ones(library.get_piece_size()))
    words = ["a", "the", "international", "ofthoulyha.", "naïve", "日本語", "x▁y", "𝄞𝄞", "▁", "ñasjaque!!", "\x00\x01", "é"]
    raw = [w.encode() for w in words]
    o = np.append(0, np.cumsum([len(x) for x in raw]))
    got = lattice.lattice(lattice.vocabulary_path()).marginals(np.frombuffer(b"".join(raw), np.uint8), o, np.log(share)[:, None])[:, 0]
    for w, g in zip(words, got.tolist()):
        assert g == pytest.approx(math.log(sum(all_cuts(w, share, pieces))), rel=1e-9) and g == pytest.approx(math.log(summed(w, share, pieces)), rel=1e-9)


def test_long_words_and_no_words(library):
    score = np.full((library.get_piece_size(), 2), -9.0)
    own = lattice.lattice(lattice.vocabulary_path())
    assert own.marginals(np.zeros(0, np.uint8), np.zeros(1, np.int64), score).shape == (0, 2)
    rng = random.Random(5)
    short = "".join(rng.choice("aebqé日") for _ in range(lattice.WIDE // 3))
    one = own.marginals(np.frombuffer(short.encode(), np.uint8), np.array([0, len(short.encode())]), score)
    joined = (short + "\x01" * 200 + short).encode()  # bytes cut the word in two
    two = own.marginals(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), score)
    tail = own.marginals(np.frombuffer(short.encode() * 1, np.uint8), np.array([0, len(short.encode())]), score)
    assert len(joined) > lattice.WIDE and two[0, 0] < one[0, 0] + tail[0, 1] and np.isfinite(two).all()
    text = ("ab" * 600).encode()
    known, wide = lattice.WIDE, own.marginals(np.frombuffer(text, np.uint8), np.array([0, len(text)]), score)
    lattice.WIDE = 1 << 20
    try:
        assert own.marginals(np.frombuffer(text, np.uint8), np.array([0, len(text)]), score) == pytest.approx(wide)
    finally:
        lattice.WIDE = known


def plain(rows, library, pieces, classes=8):
    rows = [(*r, None)[:3] for r in rows]
    held = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 == 2 for r in rows]
    texts = [WORD.findall((r[1] or "").translate(LOW)) for r in rows]
    langs = collections.Counter(r[2] for h, r in zip(held, rows) if not h and r[2] is not None)
    names = sorted(langs, key=lambda k: (-langs[k], k))[:classes]
    of = [1 + names.index(r[2]) if r[2] in names else 0 for r in rows]
    count = collections.Counter(w for h, t in zip(held, texts) if not h for w in t)
    end = held.count(False)
    n, v = sum(count.values()) + end, len(count) + (end > 0)
    size = library.get_piece_size()
    models = []
    for k in range(len(names) + 1):
        own = collections.Counter(w for h, t, x in zip(held, texts, of) if not h and x == k for w in t)
        docs = sum(not h and x == k for h, x in zip(held, of))
        times = np.ones(size + 1)
        for w in own:
            for i in library.encode(w):
                times[i] += 1
        times[size] += docs
        share = (times / times.sum()).tolist()
        starts = sum(times[i] for p, i in pieces[0].items() if p[0] == "▁")
        tokens, types = sum(own.values()) + docs, len(own) + (docs > 0)
        models.append((own, docs, share, times[size] / (starts + times[size]), tokens, max(types, 1), {}))
    out = []
    for (i, *_), h, t in zip(rows, held, texts):
        base = math.log10((end + 1) / (n + v + 1)) + sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        each = []
        for own, docs, share, stop, tokens, prior, memo in models:
            p = math.log10((docs + 1) / (end + len(models))) + math.log10((docs + prior * stop) / (tokens + prior))
            for w in t:
                if w not in memo:
                    memo[w] = summed(w, share, pieces)
                p += math.log10((own[w] + prior * memo[w]) / (tokens + prior))
            each.append(p)
        p = max(each) + math.log10(sum(10 ** (x - max(each)) for x in each))
        out.append((i, h, len(t) + 1, sum(count[w] > 0 for w in t) + (end > 0), n, pytest.approx(base, rel=1e-8), pytest.approx(p, rel=3e-7)))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))


def test_whole_query_equals_plain_dictionaries(spark, library, pieces):
    ship(spark)
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in lattice.op13_lattice_score(spark, SF).collect()]
    assert in_order(got) == in_order(plain(docs, library, pieces))


def test_edge_cases(spark, library, pieces, monkeypatch):
    ship(spark)
    rows = [(None, "null id"), (None, None), (0, None), (1, ""), (2, " \t\n"), (3, "One one ONE É"), (3, "One one ONE É"), (4, "x" * 40), (7, "▁ <unk> </s> <0x41>")]
    rows += [(10 + i, f"word{i % 5} the\x0bthe other {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("of") for c in ("id", "HELD", "word", "chunk", "score")})
    got = [tuple(r) for r in lattice.score(df.repartition(3)).collect()]
    assert in_order(got) == in_order(plain(rows, library, pieces))
    assert len({r[-1] for r in got if r[0] == 3}) == 1
    monkeypatch.setattr(lattice, "CHUNK", 60)
    monkeypatch.setattr(lattice, "BOOK", 9)  # local workers read the constants from this process's functions
    langs = [(i, t, ["a", None, "b", "c", "b"][j % 5]) for j, (i, t) in enumerate(rows)]
    got = lattice.score(spark.createDataFrame(langs, "doc_id long, text string, lang string").repartition(2), class_col="lang", classes=2).collect()
    assert in_order([tuple(r) for r in got]) == in_order(plain(langs, library, pieces, classes=2))
    assert lattice.score(df.limit(0)).count() == 0
    none = lattice.score(spark.createDataFrame([(5, "only held out")], "doc_id long, text string"), held_out="{id} = '5'").first()
    assert (none.held_out, none.n_tokens, none.n_known, none.train_tokens, none.base_score) == (True, 4, 0, 0, 0.0) and none.score < -1
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(300_000))
    got = lattice.score(spark.createDataFrame([(1, long + " " + long), (2, "a " * 1_000_000)], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [3, 1_000_001] and all(math.isfinite(r.score) for r in got)


def test_equal_texts_score_alike_and_held_out_text_beats_spelling_alone(spark):
    ship(spark)
    got = lattice.op13_lattice_score(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    alike = got.groupBy("text").agg(F.count_distinct("score").alias("n"), F.count("*").alias("rows"))
    assert alike.filter("n > 1").count() == 0 and alike.filter("rows > 1").count() > 0
