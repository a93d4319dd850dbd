"""Clashing column names, texts of several MB and large groups, for every operator."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm_operators import fresh_library, library_ids, shingles

import corpus_pipeline
from tessella.llm import fingerprint, jaccard_join, line_dedup, mixing, packing, quality, search, toxicity, warc, wavelet
from tessella.llm.components import attach, frequent, mark_repeats
from tessella.llm.shared import fresh_path, ship, unique_names

#: Names that operators give to their outputs and helpers.
CLASHING = """row n_lines n_dropped kept drop frequent spared again task nth times _id _rid _text _i _no _drop_id _drop_rid one i no rid key n comp
class component_id n_shingles tox_severity TOX_GRADE tox_p tox_flag quality_score label _got _doc domain epoch tokens n_tokens piece start length
ids_crc32 sequence_id offset _b _peek _k _to fingerprint score rank query_id block path g title words token size a b""".split()


@pytest.fixture(scope="module")
def clashing(spark):
    ship(spark)
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice([f"v{i}" for i in range(50)]) for _ in range(n))
    common, rows = line(8), []
    for i in range(40):
        rows.append((i, line(30) + "\n" + common + (" stupid moron" * (i % 4 == 0))))
    rows += [(41, rows[1][1]), (42, rows[1][1] + " more"), (42, rows[1][1] + " more"), (None, None), (43, "")]
    df = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"of {c}") for c in CLASHING}).repartition(3).cache()


def untouched(df, names=CLASHING):
    rows = df.collect()
    assert rows and all(r[c] == f"of {c}" for r in rows for c in names)
    return rows


def test_clashing_names_of_filters_and_scores(spark, clashing):
    n = clashing.count()
    for keep in ("none", "first"):
        out = line_dedup.apply_drops(clashing, line_dedup.dropped_lines(clashing, min_docs=5, keep=keep), keep=keep)
        assert out.agg(F.sum("n_dropped")).first()[0] > 0 and len(untouched(out.select("row.*"))) == n
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 2)) for i in range(40)], "doc_id long, toxic int, quality int")
    scored = toxicity.score(clashing, toxicity.train(clashing, labels))
    assert scored.columns[-4:] == ["tox_severity_", "tox_grade_", "tox_p_", "tox_flag_"] and len(untouched(scored)) == n
    scored = quality.score(clashing, quality.train(clashing, labels))
    assert scored.columns[-1] == "quality_score_" and len(untouched(scored)) == n
    kept = untouched(jaccard_join.one_of_each(clashing, 5, 80))
    assert sorted(str(r["doc_id"]) for r in kept if r["doc_id"] in (1, 41, 42, 43, None)) == ["1", "43", "None"]


def test_clashing_names_of_other_operators(spark, clashing):
    n = clashing.count()
    assert packing.packed_documents(clashing).count() == n
    assert wavelet.read_shards(wavelet.write_shards(clashing, fresh_path(spark, "t"))).count() == n
    assert fingerprint.fingerprints(clashing, fingerprint.corpus_ranks(clashing)).count() == n
    assert jaccard_join.similarity_components(clashing, 4, 85).count() == n
    assert search.top_k(clashing, clashing.filter("doc_id < 3"), 2).count() == 6
    assert mixing.mixture(clashing, 1.0, 1).select("_id").distinct().count() <= n
    pages = clashing.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})
    pages = pages.withColumns({"_sha": F.lit("x"), "_first": F.lit("x"), "_revisit": F.lit("x"), "records": F.lit("x")})
    assert warc.read_bundles(warc.write_bundles(pages, fresh_path(spark, "w"))).count() == n


def test_clashing_names_in_the_pipeline(spark, clashing, tmp_path):
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == clashing.columns, name
        untouched(docs)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_unique_names():
    assert unique_names(["A", "b_", "b"], ["a", "b", "c", "c"]) == ["a_", "b__", "c", "c_"]


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    words = [f"word{i}" for i in range(3000)] + ["naïve", "x,", "y."]
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 400]))) for _ in range(3500))


def test_texts_of_several_mb(spark, long_text):
    ship(spark)
    assert len(long_text) > 3_000_000
    texts = [(1, "short one here"), (2, long_text), (3, long_text + " tail"), (4, "x" * 2_000_000), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "src1", "u") for i, t in texts], "doc_id long, text string, lang string, source string, url string")
    fresh = fresh_library()
    sizes = {i: len(library_ids(fresh, t)) // 4 + 1 for i, t in texts if i != 4}
    got = {r["doc_id"]: r["n"] for r in packing.packed_documents(df.filter("doc_id <> 4")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == sizes
    got = {r["doc_id"]: r["n_tokens"] for r in wavelet.read_shards(wavelet.write_shards(df.filter("doc_id <> 4"), fresh_path(spark, "t"))).collect()}
    assert got == sizes
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_components(df, 5, 80).collect()}
    assert got == {i: (len(shingles(t, 5)), 2 if i == 3 else i) for i, t in texts}
    out = {r["row"]["doc_id"]: r for r in line_dedup.apply_drops(df, line_dedup.dropped_lines(df, min_docs=2)).collect()}
    assert out[2]["n_lines"] == 3500 and out[2]["n_dropped"] == out[3]["n_dropped"] == 3499 and out[4]["kept"] == "x" * 2_000_000
    found = search.top_k(df, df.filter("doc_id in (2, 4)"), 3).collect()
    assert [r["doc_id"] for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])) if r["query_id"] == 4] == [4]
    assert {r["doc_id"] for r in found if r["query_id"] == 2} == {2, 3}
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(df, fingerprint.corpus_ranks(df)).collect()}
    assert prints[2]["n_chars"] == len(long_text) and prints[2]["near_next"] > 0.9 and prints[4]["near_next"] < 0.2
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, toxic int, quality int")
    assert toxicity.score(df, toxicity.train(df, labels)).count() == 5 and quality.score(df, quality.train(df, labels)).count() == 5
    count = len(re.findall(r"[^\x20\x09-\x0D]+", long_text))
    took = {r["_id"]: r["n_tokens"] for r in mixing.mixture(df.withColumn("domain", F.lit("d0")), 1.0, 1).collect()}
    assert took[2] == count
    pages = df.select(F.col("doc_id").alias("page_id"), "url", F.col("text").alias("html"))
    back = {r["page_id"]: r["payload_bytes"] for r in warc.read_bundles(warc.write_bundles(pages, fresh_path(spark, "w"))).collect()}
    assert back == {i: len((t or "").encode()) for i, t in texts}


def test_a_mixed_list_of_thousands(spark, monkeypatch):
    """A token in the prefix of every document, all in components of their own but for the planted links."""
    ship(spark)
    monkeypatch.setattr(jaccard_join, "BLOCK", 700)
    rows = [(i, f"common p{i} q{i}") for i in range(3000)]
    linked = [(5000 + i, f"common p{i} other{i}") for i in range(0, 3000, 100)]
    df = spark.createDataFrame(rows + linked, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similarity_components(df, 1, 50).collect()}
    assert got == {**{i: i for i, _ in rows}, **{i: i - 5000 for i, _ in linked}}


def test_attach_and_mark_repeats(spark):
    rows = spark.createDataFrame([(0, i) for i in range(500)] + [(i, i) for i in range(1, 60)], "k long, v long").repartition(5)
    table = spark.createDataFrame([(i, f"t{i}") for i in range(0, 40)], "k long, t string")
    want = collections.Counter((r["k"], r["v"], f"t{r['k']}" if r["k"] < 40 else None) for r in rows.collect())
    assert collections.Counter(map(tuple, attach(rows, table, ["k"], "left").select("k", "v", "t").collect())) == want
    inner = collections.Counter({x: n for x, n in want.items() if x[2]})
    assert collections.Counter(map(tuple, attach(rows, table, ["k"]).select("k", "v", "t").collect())) == inner
    assert frequent(rows, ["k"]).filter("k = 0").count() == 1
    marked = mark_repeats(rows, ["k"]).collect()
    assert len(marked) == 559 and collections.Counter(r["k"] for r in marked if not r["again"]) == collections.Counter(range(60))


def test_edited_text_is_of_code_points():
    assert fingerprint.edited("abcd", "ÄÖÜ") == "abÄÖ" and fingerprint.edited("abc", "") == "ab" and fingerprint.edited("", "x") == ""
    assert hashlib.sha256(fingerprint.edited("äöü", "xyz").encode()).hexdigest() == hashlib.sha256("äöx".encode()).hexdigest()
