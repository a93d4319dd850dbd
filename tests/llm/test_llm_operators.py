"""Small fixtures with nulls, empty and long texts, ties, repeated rows, clashing names; brute force beside each."""

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
from pyspark.sql import functions as F

from tessella.llm import fingerprint, jaccard_join, line_dedup, mixing, packing, quality, search, tokens, toxicity, warc, wavelet
from tessella.llm.components import components
from tessella.llm.shared import fresh_path, ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Häuser", "the", "The", "été", "x,", "y."]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = [line(12) for _ in range(3)]
    out = []
    for i in range(60):
        parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(common))
        out.append((i, "\n".join(parts)))
    base = line(200)
    for i in range(60, 75):  # near copies
        w = base.split(" ")
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"n{i}"
        out.append((i, " ".join(w)))
    out += [(75 + i, out[0][1]) for i in range(12)]  # exact copies
    out += [(100, None), (101, ""), (102, "   \n\t\n  "), (103, "one"), (104, "one two three"), (105, line(6000))]
    out += [(106, "a\n\nb"), (106, "a\n\nb"), (107, "tie one text"), (107, "tie other text"), (None, "no id here at all"), (None, None)]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "web", None]), len(t or ""), "e") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], DOCS)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_lines(rows, min_docs, keep):
    """Brute force: kept text and dropped count of each row, in row order; each row is a document."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    found = collections.defaultdict(set)
    first = {}
    for n, (i, t, *_) in enumerate(rows):
        for p, x in enumerate((t or "").split("\n")):
            if key(x):
                found[key(x)].add(n)
                at = (i is not None, i or 0, n, p)
                first[key(x)] = min(first.get(key(x), at), at)
    out = []
    for n, (i, t, *_) in enumerate(rows):
        kept = [
            x
            for p, x in enumerate((t or "").split("\n"))
            if len(found.get(key(x), ())) < min_docs or (keep == "first" and first[key(x)] == (i is not None, i or 0, n, p))
        ]
        out.append(("\n".join(kept), len((t or "").split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup(docs, rows, keep):
    again = [r for r in rows if r[0] in (0, 3, 6, 75, 102, None)]
    d = docs.union(docs.filter("doc_id in (0, 3, 6, 75, 102) or doc_id is null")).repartition(5)
    got = line_dedup.apply_drops(d, line_dedup.dropped_lines(d, min_docs=5, keep=keep), keep=keep).collect()
    want = collections.Counter((r[0], k, n) for r, (k, n) in zip(rows + again, keep_lines(rows + again, 5, keep)))
    assert collections.Counter((r["row"]["doc_id"], r["kept"], r["n_dropped"]) for r in got) == want
    assert sum(r["n_dropped"] for r in got) > 12 and got[0]["row"]["extra"] == "e"


def test_line_dedup_empty(empty):
    assert line_dedup.apply_drops(empty, line_dedup.dropped_lines(empty)).count() == 0


def budgets(caps, weights, total):
    """Water-filling by brute force."""
    got, left, open_ = {}, total, dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = [k for k in open_ if caps[k] <= level * open_[k]]
        if not full:
            return got | {k: level * w for k, w in open_.items()}
        for k in full:
            got[k] = caps[k]
            left -= caps[k]
            del open_[k]
    return got


def test_leaf_budgets(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "a", 5), ("d1", "en", "c", 400), ("d1", "fr", "c", 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").selectExpr("*", "300L as t")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(df, df["t"], 1).collect()}
    top = budgets({"d0": 115, "d1": 400}, {"d0": 0.25, "d1": 0.25}, 300)
    assert top == {"d0": 115, "d1": 185}
    assert got == {("d0", "en", "a"): 100, ("d0", "en", "b"): 10, ("d0", "de", "a"): 5, ("d1", "en", "c"): 185, ("d1", "fr", "c"): 0}


@pytest.mark.parametrize("fraction, epochs", [(0.4, 1), (0.9, 1), (1.5, 3)])
def test_mixture_prefixes(spark, docs, rows, fraction, epochs):
    got = mixing.mixture(docs.withColumn("domain", mixing.domain_of(docs["source"])), fraction, epochs, seed=5).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaves = collections.defaultdict(list)
    for i, t, lang, source, *_ in rows:
        number = re.search(r"([0-9]{1,9})$", source or "")
        leaves[(f"d{int(number[1]) % 4 if number else 0}", lang or "(none)", source or "(none)")].append((i, count(t)))
    chosen = collections.Counter((r["domain"], r["lang"], r["source"], r["_id"], r["epoch"]) for r in got)
    budget = {(r["domain"], r["lang"], r["source"]): r["leaf_budget"] for r in got}
    assert sum(budget.values()) <= math.floor(sum(count(r[1]) for r in rows) * fraction)
    for leaf, b in budget.items():
        total = sum(n for _, n in leaves[leaf])
        whole = b // total if total else 0
        key = lambda i: hashlib.md5(f"5|{whole}|{'null' if i is None else i}".encode()).hexdigest()  # noqa: B023, E731
        want, run = collections.Counter(), 0
        for e in range(whole):
            want.update((*leaf, i, e) for i, _ in leaves[leaf])
        by = collections.defaultdict(list)
        for i, n in leaves[leaf]:
            by[key(i)].append((i, n))
        for k in sorted(by):
            run += sum(n for _, n in by[k])
            if run > b - whole * total:
                break
            want.update((*leaf, i, whole) for i, _ in by[k])
        if b > whole * total:
            assert collections.Counter({k: v for k, v in chosen.items() if k[:3] == leaf}) == want


def test_mixture_empty(empty):
    assert mixing.mixture(empty.withColumn("domain", empty["source"]), 0.5, 1).count() == 0


def fresh_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def library_ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_library():
    e, fresh = tokens.Encoder(tokens.tokenizer_path()), fresh_library()
    assert e.by_pieces
    rng = random.Random(1)
    texts = ["", None, " ", "  ", "a  b", "a\n\nb", "\n", "x<|endoftext|>y", "it's we'll 12 34,5.", "don 't\n's é ü　 z", "a" * 4000 + " b"]
    odd = "ab 1,.'\n\té\u00a0\u3000\u2028\u0085\u1680\u2009\u00d7\u00f7\u0394\u6f22\x1c—’\u180e\u200b"
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    any_char = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x600), rng.randrange(0x600, 0xD800), rng.randrange(0xE000, 0x20000), 32, 10]))
    texts += ["".join(any_char() for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    want = [library_ids(fresh, t) for t in texts]
    assert e.encode(texts) == want and e.encode(texts) == want
    assert e.encode([]) == [] and e.encode(["", None]) == [b"", b""]


def test_encoder_forgets_and_stays_exact(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "CHUNK", 400)
    e, fresh, rng = tokens.Encoder(tokens.tokenizer_path()), fresh_library(), random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    assert e.encode(texts) == [library_ids(fresh, t) for t in texts]
    assert len(e.memo) < 200


def test_encoder_keeps_what_recurs_and_learns_in_steps(monkeypatch):
    """A full memo asks the library for no piece again that the chunk at hand shares with it, and tokens are made for few pieces at once."""
    monkeypatch.setattr(tokens, "MEMO", 300)
    monkeypatch.setattr(tokens, "STEP", 16, raising=False)
    monkeypatch.setattr(tokens, "CHUNK", 2000)
    e, fresh, asked, steps = tokens.Encoder(tokens.tokenizer_path()), fresh_library(), collections.Counter(), []
    learn, letters = e._learn, e._in_letters
    monkeypatch.setattr(e, "_learn", lambda column, pieces: (asked.update(pieces), learn(column, pieces)))
    monkeypatch.setattr(e, "_in_letters", lambda data, cut: (steps.append(len(cut) - 1), letters(data, cut))[1])
    texts = [" ".join(["same", *(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in ("so", "many", "new")), "words"]) for i in range(600)]
    assert e.encode(texts) == [library_ids(fresh, t) for t in texts]
    assert asked[b"same"] == asked[b" words"] == 1 and len(asked) > 4 * 300 and max(steps) <= 16


def test_packing_hands_python_few_rows_at_once(spark, monkeypatch):
    import pyarrow as pa

    def sizes(path, capacity):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x] * n, t) for x, t in ((0, pa.int32()), (0, pa.int64()), (1, pa.int64()), (n, pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return run

    monkeypatch.setattr(packing, "_cut", sizes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(9000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    got = packing.packed_documents(docs).agg(F.count("*"), F.max("ids_crc32")).first()
    assert got[0] == 9000 and got[1] <= 2000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_encoder_of_a_very_long_text():
    e, rng = tokens.Encoder(tokens.tokenizer_path()), random.Random(3)
    text = " ".join(rng.choice(["word", "other,", "Häuser.", "x  y", "12"]) for _ in range(900_000))
    assert len(text) > 5_000_000 and e.encode(["a", text, "b"])[1] == library_ids(fresh_library(), text)


def test_encoder_of_another_form_uses_the_library():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    e, fresh = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["One two, THREE", None, "a  b\n\nc"]
    assert not e.by_pieces and e.encode(texts) == [library_ids(fresh, t) for t in texts]


def test_encoder_equals_a_fresh_library():
    fresh, e = fresh_library(), tokens.Encoder(tokens.tokenizer_path())
    rng = random.Random(6)
    mark = "<|endoftext|>"
    texts = ["", None, mark, "x<|endoftext|>y", "a b " + mark, mark + " a b", f"a {mark} b\nc {mark}{mark}", "<|endoftext|", "<| endoftext|>", "a b"]
    texts += [" ".join(rng.choice(["a", "b.", "1,", mark, "x" + mark, "\n", ""]) for _ in range(rng.randint(1, 8))) for _ in range(500)]
    want = [library_ids(fresh, t) for t in texts]
    assert e.encode(texts) == want and e.encode(texts) == want
    assert any(50256 in np.frombuffer(x, "<u4") for x in want)


def ids_of(rows, end):
    library = fresh_library()
    return [np.frombuffer(library_ids(library, t), "<u4").tolist() + [end] for _, t, *_ in rows]


def test_packing(docs, rows):
    got = packing.packed_documents(docs).collect()
    want = collections.Counter()
    for (i, *_), ids in zip(rows, ids_of(rows, 0)):
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_best_two_fit_replaces_the_smallest():
    # greedy: 6 + 3 leaves a gap of 1 that nothing fits; 2 + 2 in place of 3 fills it
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([(6, 1), (2, 2)], 1)
    rng = random.Random(2)
    for _ in range(30):
        h = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(12)}
        bins = packing.best_two_fit(h, 50)
        placed = collections.Counter()
        for pattern, m in bins:
            assert sum(n * k for n, k in pattern) <= 50
            placed.update({n: k * m for n, k in pattern})
        assert placed == h
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_packing_empty(empty):
    assert packing.packed_documents(empty).count() == 0


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (9000, 300), (5000, 70000)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype("<u4")
    wm, names, lengths = wavelet.load(b"".join(wavelet.dump(ids, [3, None], np.array([n, 0]))))
    assert (wm.to_array() == ids).all() and names == [3, None] and lengths.tolist() == [n, 0]
    for i in rng.integers(0, max(1, n), 20).tolist() if n else []:
        s = int(ids[i])
        at = np.flatnonzero(ids == s)
        assert wm.access(i) == s and wm.rank(s, i) == int((ids[:i] == s).sum()) and wm.count(s) == len(at)
        k = int(np.searchsorted(at, i))
        assert wm.select(s, k) == i and wm.select(s, len(at)) == -1
    assert wm.count(1 << 20) == 0


def test_wavelet_queries_read_few_blocks():
    import io

    ids = np.random.default_rng(1).integers(0, 60000, 1_500_000).astype("<u4")
    shard = wavelet.Shard(io.BytesIO(b"".join(wavelet.dump(ids, [1], np.array([len(ids)])))))
    blocks = len(shard._offsets) - 1
    assert shard.matrix.access(1_234_567) == int(ids[1_234_567]) and 0 < shard.blocks_read <= 16 < blocks
    at = np.flatnonzero(ids == ids[77])
    assert shard.matrix.count(int(ids[77])) == len(at) and shard.matrix.select(int(ids[77]), len(at) - 1) == at[-1]
    assert shard.blocks_read < blocks / 2 and (shard.matrix.to_array() == ids).all()


def test_wavelet_shards(spark, docs, rows):
    got = wavelet.read_shards(wavelet.write_shards(docs, fresh_path(spark, "t"), shard_tokens=2000)).orderBy("start").collect()
    by = collections.defaultdict(list)
    for (i, *_), ids in zip(rows, ids_of(rows, 2)):
        by[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen, at = collections.defaultdict(list), 0
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen[r["doc_id"]].append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in by.items()}


def test_wavelet_empty(spark, empty):
    assert wavelet.read_shards(wavelet.write_shards(empty, fresh_path(spark, "t"))).count() == 0


def test_toxicity(spark, empty):
    ship(spark)
    rng = random.Random(4)
    bad = ["stupid", "clown", "moron"]
    make = lambda n, w: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", *w]) for _ in range(n))
    train = [(i, make(30, bad if i % 3 == 0 else []), int(i % 3 == 0)) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    assert (np.diff(model.thresholds) > 0).all()
    test = [(1, "what a Stupid, stupid CLOWN", 1), (2, make(40, []), 0), (3, None, 0), (4, "", 0), (4, "", 0), (None, "moron " * 3000, 1)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in test], "doc_id long, text string, toxic string")
    got = toxicity.score(df, model).collect()
    assert sorted((str(r["doc_id"]), int(r["tox_flag"])) for r in got) == sorted((str(i), y) for i, _, y in test)
    sev = {r["doc_id"]: r["tox_severity"] for r in got}
    assert sev[None] > sev[1] > sev[2] and sev[3] == sev[4] and got[0]["toxic"] == "x"
    none = toxicity.train(d, labels.filter("toxic = 0"))
    assert not any(r["tox_flag"] for r in toxicity.score(df, none).collect())
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(empty.select("doc_id", "text"), labels)
    assert not any(r["tox_flag"] for r in toxicity.score(df, nothing).collect())


def test_toxicity_counts_do_not_depend_on_chunks():
    import pyarrow as pa

    texts, labels = ["clown stupid", "clown nice", "nice words", "clown"], [1, 0, 0, 1]

    def counts(parts):
        batches = [pa.record_batch([pa.array(texts[a:b]), pa.array(labels[a:b], pa.int32())], ["text", "label"]) for a, b in parts]
        out = collections.Counter()
        for x in toxicity._document_counts(iter(batches)):
            for g, df, tox in zip(*[c.to_pylist() for c in x.columns]):
                out[g, "df"] += df
                out[g, "tox"] += tox
        return out

    whole = counts([(0, 4)])
    assert counts([(i, i + 1) for i in range(4)]) == whole == counts([(0, 1), (1, 3), (3, 4)])
    assert max(v for (_, k), v in whole.items() if k == "df") == 3 and max(v for (_, k), v in whole.items() if k == "tox") == 2


def test_cumulative_link_probabilities_fall():
    m = toxicity.OrdinalModel(toxicity.Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), np.array([0.5, 1.5]))
    p = m.at_least(np.array([-3.0, 0.0, 3.0]))
    assert (p[:, 0] > p[:, 1]).all() and (np.diff(p[:, 0]) > 0).all()


def test_quality(spark, empty):
    ship(spark)
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) for _ in range(40))
    junk = lambda: " ".join(rng.choice(["L0R!!", "$$$x", "%%%", "IPS&&&"]) for _ in range(40))
    train = [(i, good() if i % 2 else junk(), i % 2) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in train] + [(1000, None), (1001, ""), (None, good()), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, quality int")
    got = quality.score(d, quality.train(d, labels)).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    score = {r["doc_id"]: r["quality_score"] for r in got}
    held = [i for i, _, _ in train if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {r["doc_id"] for r in got if r["held"]} == set(held) | {i for i in (1000, 1001) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all((score[i] >= 0.7) == bool(i % 2) for i in held)
    assert score[1000] == score[1001] and len(got) == 404 and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.score(empty, quality.fit([])).count() == 0 and quality.fit([{"label": 1, "feats": b"", "counts": b""}]).bias > 0


def test_quality_ignores_held_out_labels(spark):
    ship(spark)
    d = spark.createDataFrame([(i, f"word{i} text") for i in range(200)], "doc_id long, text string")
    flip = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - i % 2 if flip(i) else i % 2) for i in range(200)], "doc_id long, quality int")
    assert (quality.train(d, a).logit == quality.train(d, b).logit).all()


PAGES = "page_id long, url string, html string, record_type string"


def test_warc(spark):
    ship(spark)
    big = "<p>" + "ä" * 300_000
    pages = [(5, "http://a/ b\n", "x", "r"), (3, None, "x", "r"), (9, "u", None, "r"), (8, "u", "", "r"), (7, "u", big, "r"), (1, "u", big, "r")]
    pages += [(2, "u", "x", "r"), (2, "u", "x", "r"), (None, "u", "x", "r"), (None, "u", "alone", "r"), (4, "u", "\r\n\r\nHTTP", "r")]
    df = spark.createDataFrame(pages, PAGES)
    manifest = warc.write_bundles(df, fresh_path(spark, "w"))
    got = collections.Counter(tuple(r) for r in warc.read_bundles(manifest).collect())
    first = {}
    for i, _, h, _ in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = collections.Counter()
    for i, _, h, _ in pages:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None)] += 1
    assert got == want
    # random access and a plain reader
    import zstandard

    for (path,) in manifest.select("path").collect():
        b = warc.Bundle(path)
        assert len({key for key, *_ in b.map}) == len(b.map)
        for key, *_ in b.map:
            assert warc.parse(b.read(key))["headers"]["warc-record-id"] == key
        fs, at = warc.filesystem(path)
        with fs.open_input_stream(at, compression=None) as f:
            plain = zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
        assert plain.count(b"WARC/1.1\r\n") == len(b.map)


def test_warc_empty(spark):
    ship(spark)
    assert warc.read_bundles(warc.write_bundles(spark.createDataFrame([], PAGES), fresh_path(spark, "w"))).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k, percent, short", [(4, 85, 48), (5, 80, 0), (2, 50, 2)])
def test_jaccard_join(docs, rows, monkeypatch, k, percent, short):
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    sets = [shingles(t, k) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    want = collections.Counter((i, len(s), least.get(find(n)) if s else i) for n, ((i, *_), s) in enumerate(zip(rows, sets)))
    got = jaccard_join.similarity_components(docs, k, percent)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_shingle_sets_of_one_short_document(k):
    for n in range(k + 2):
        text = " ".join(f"w{i}" for i in range(n)).encode()
        size, x = jaccard_join.shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), k)
        assert size.tolist() == [len(shingles(text.decode(), k))] and len(x) == size[0]
        # the same set as beside another document
        both = text + b"a longer text of many words"
        sizes, y = jaccard_join.shingle_sets(np.frombuffer(both, np.uint8), np.array([0, len(text), len(both)]), k)
        assert sizes[0] == size[0] and (y[: size[0]] == x).all()


def test_jaccard_join_of_one_short_document(spark):
    ship(spark)
    one = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard_join.similarity_components(one, 4, 85).select("doc_id", "n_shingles", "component_id").collect()] == [(1, 1, 1)]


def test_one_of_each(docs, rows):
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs, 5, 80).collect()]
    bare = [(i, t) for i, t, *_ in rows if not shingles(t, 5)]
    comps = jaccard_join.classes(docs, 5, 80).filter("comp is not null").select("comp").distinct().count()
    assert sorted(map(str, [x for x in kept if x in bare])) == sorted(map(str, bare))
    others = [x for x in kept if x not in bare]
    assert len(others) == comps


def test_jaccard_join_empty(empty):
    assert jaccard_join.similarity_components(empty).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_fingerprint(spark, docs, rows):
    ranks = fingerprint.corpus_ranks(docs)
    got = fingerprint.fingerprints(docs, ranks).collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    by = collections.defaultdict(set)
    for i, t, *_ in rows:
        by[i].add(t or "")
    text = {}
    for r in got:
        text.setdefault(r["fingerprint"], []).append(r)
        assert r["n_chars"] in {len(t) for t in by[r["doc_id"]]} and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert sorted(ids, key=str) == sorted([r[0] for r in rows], key=str)
    # documents with single neighbours, against brute force
    order = sorted({i for i in by if i is not None})
    one = {r["doc_id"]: r for r in got}
    for a, b in [(i, j) for i, j in zip(order, order[1:]) if len(by[i]) == len(by[j]) == 1 and i != 106 and j != 106]:
        (x,), (y,) = by[a], by[b]
        e = fingerprint.edited(x, y)
        assert one[a]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert one[a]["fingerprint"] == fingerprint.as_text(fingerprint.digests([x.encode()], ranks)[0])
        assert one[a]["edited_fingerprint"] == fingerprint.as_text(fingerprint.digests([e.encode()], ranks)[0])
    assert one[100]["fingerprint"] == one[101]["fingerprint"] == "" and one[100]["near_next"] == 1.0
    assert one[70]["near_next"] > 0.5 > one[10]["near_next"]


def test_entropy_levels_by_counting():
    data = np.frombuffer("Häuser und the aaaa bbbb of the of the".encode() * 3, np.uint8)
    got = fingerprint.entropy_levels(np.concatenate([data, np.zeros(40, np.uint8)]))
    for i in range(len(data) - 32):
        c = np.bincount(data[i : i + 32])
        s = sum(int(round(k * math.log2(k) * fingerprint.SCALE)) for k in c[c > 0])
        assert got[i] == s >> fingerprint.SHIFT


def test_fingerprint_single_and_empty(spark, empty):
    assert fingerprint.fingerprints(empty, fingerprint.corpus_ranks(empty)).count() == 0
    one = spark.createDataFrame([(7, "only document in the whole table")], "doc_id long, text string")
    r = fingerprint.fingerprints(one, fingerprint.corpus_ranks(one)).collect()[0]
    assert r["near_next"] == 1.0


def bm25(rows, query, k):
    """Every score in full; equal bags of words are summed in one order."""
    tf = [collections.Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").translate(LOWER).encode())) for _, t, *_ in rows]
    df = collections.Counter(x for c in tf for x in c)
    n, mean = len(rows), sum(map(lambda c: sum(c.values()), tf)) / len(rows)
    q = collections.Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (query or "").translate(LOWER).encode()))
    out = []
    for (i, *_), c in zip(rows, tf):
        s = math.fsum(
            w * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            for x, w in q.items()
            if x in c
        )
        if s > 0:
            out.append((-s, i is None, i or 0))
    return sorted(out)[:k]


def same_ranking(got, want):
    """Equal scores to 12 digits, and equal documents but among scores that close."""
    assert len(got) == len(want) and [r for r, *_ in got] == list(range(1, len(got) + 1))
    for (_, score, no, doc), (s, n, i) in zip(got, want):
        assert score == pytest.approx(-s, rel=1e-12) and (no, doc) == (n, i)


def ranked(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["rank"], r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("block, seeds, pivots", [(128, 8, 128), (2, 1, 1), (1, 2, 3)])
def test_search(docs, rows, monkeypatch, block, seeds, pivots):
    for name, value in (("BLOCK", block), ("SEED_BLOCKS", seeds), ("PIVOTS", pivots), ("QUERIES", 3)):
        monkeypatch.setattr(search, name, value)
    by = ranked(search.top_k(docs, docs.filter("doc_id % 20 = 0 or doc_id is null"), k=5).collect())
    for i, t, *_ in rows:
        if i is not None and i % 20 == 0:
            same_ranking(by.get(i, []), bm25(rows, t, 5))
    assert None not in by and not by.get(100)


def test_search_results_do_not_depend_on_shards(spark, tmp_path, monkeypatch):
    """One term in every document and lengths that differ by a word: scores are near ties."""
    ship(spark)
    rows = [(i, "common " + " ".join(f"u{i}x{j}" for j in range(2000 + (i * 7919) % 3000))) for i in range(600)] + [(9000 + i, "common tie") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    ask = spark.createDataFrame([(1, "common"), (2, "common tie tie"), (3, "nowhere")], "doc_id long, text string")
    monkeypatch.setattr(search, "BLOCK", 4)
    want = [bm25(rows, t, 10) for t in ("common", "common tie tie")]
    first = None
    for parts in (1, 2, 7):
        by = ranked(search.top_k(spark.read.parquet(f"{tmp_path}/d").repartition(parts), ask).collect())
        same_ranking(by[1], want[0])
        same_ranking(by[2], want[1])
        assert set(by) == {1, 2} and (first is None or by == first)
        first = by


def test_search_skips_blocks(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)
    rng = np.random.default_rng(4)
    n = 4000
    doc = np.concatenate([np.arange(n), np.sort(rng.choice(n, 40, replace=False))])
    tf = np.concatenate([np.ones(n, int), np.full(40, 9)])
    files = [np.arange(n), np.full(n, 50, "<u4"), np.array([3, 8], "<u8"), np.array([0, n, n + 40]), doc.astype("<u4"), tf.astype("<u4")]
    monkeypatch.setattr(search, "_get", lambda path, kinds, only=None: files)
    shard = search.Shard("", 50.0)
    assert shard.lists(np.array([3, 5, 8, 9], np.uint64)).tolist() == [0, -1, 1, -1]
    ids, scores = shard.search(np.array([0, -1, 1]), np.array([0.01, 1.0, 5.0]), 10)
    assert sorted(ids) == sorted(doc[n:])[:10] and shard.opened < shard.met


def test_search_empty(docs, empty):
    assert search.top_k(empty, docs.filter("doc_id = 0")).count() == 0
    assert search.top_k(docs, empty).count() == 0


def plain_components(links):
    comp = {}
    for a, b in links:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for a, b in links:
        x, y = comp[a], comp[b]
        if x != y:
            comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    return comp


def test_components_of_a_peaked_path_take_few_rounds(spark, monkeypatch):
    from tessella.llm import components as module

    rounds = []
    kept = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: (rounds.append(label), kept(df, label))[1])
    n = 1600  # numbers rise to a peak and fall again
    order = list(range(0, n, 2)) + list(range(n - 1, 0, -2))
    links = list(zip(order, order[1:]))
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(n), 0)
    assert rounds.count("link-points") <= 25


def test_components_of_any_form(spark):
    rng = random.Random(12)
    links = [(0, i) for i in range(1, 200)] + [(500 + i, 900) for i in range(100)] + [(i, i) for i in range(2000, 2005)]
    links += [(a, a + rng.randint(1, 9)) for a in rng.sample(range(3000, 4000), 260)] + [(7, 8), (8, 7), (7, 8)]
    rng.shuffle(links)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in plain_components([x for x in links if x[0] != x[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_severity_grades_do_not_grow_with_length(spark):
    rng = random.Random(2)
    clean = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = [rng.choice(clean) for _ in range(20 if i % 8 else 400)]
        bad = ["vilest", "loathsome", "wretched"]
        n = 0 if not toxic else (10 if i % 8 else 12)  # short texts are densely bad, long ones thinly
        rows.append((i, " ".join(words + [rng.choice(bad) for _ in range(n)]), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].tox_flag == bool(t) for i, _, t in rows)
    more = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz "), "text")))
    assert toxicity.training_rows(more, labels, "toxic", 50).count() == 50  # one text an id
