"""op12 against a plain tokenizer by regular expression."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import infill
from tessella.llm.shared import ship

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_whole_query_equals_plain_form(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in infill.op12_infill(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n, form, pre, mid, out = plain(d.doc_id, d.text)
        r = got[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pre, mid)
        assert (r.output_sha256, r.restored_sha256) == (sha(out), sha(d.text or ""))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\ra<P>é€𝄞 ", max_size=30), max_size=8), st.integers(0, 1 << 30))
def test_runs_cut_where_tokens_end(texts, seed):
    raw = [t.encode() for t in texts]
    o = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    r = infill.runs(np.frombuffer(b"".join(raw), np.uint8), o)
    tokens = [[x.encode() for x in TOKEN.findall(t)] for t in texts]
    assert r.count.tolist() == [len(x) for x in tokens]
    at = np.array([seed % (len(x) + 1) for x in tokens], np.int64)
    assert r.cut(at).tolist() == [int(s) + sum(map(len, x[:k])) for s, x, k in zip(o, tokens, at.tolist())]


def test_edge_cases(spark):
    ship(spark)
    rows = [(i, t) for i, t in enumerate([None, "", " ", "a", "a ", " a", "<P> x y", "x <M>", "é 𝄞 ü\n", "< P> <S", "b" * 3_000_000, "w é " * 600_000])]
    rows += [(None, "null id text here"), (3, "a"), (3, "a b"), (200, "x y < S"), (201, "tail <"), (202, " \n "), (203, "<" * 50 + " <" * 50)]
    rows += [(300 + i, f"one two {i} three\tfour ") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("of") for c in ("form", "N", "output", "text_", "H1")})
    out = infill.rewrite(df.repartition(2))
    assert out.columns == [*df.columns, "form_", "n_", "prefix_chars", "middle_chars", "output_"]
    got = out.withColumn("back", infill.restored(F.col("output_"), F.col("form_"))).collect()
    assert len(got) == len(rows) and all(r.form == r.N == r.output == "of" for r in got)
    key = lambda x: tuple((v is not None, v) for v in x)
    mine = sorted([(r.doc_id, r.text, r.n_, r.form_, r.prefix_chars, r.middle_chars, r.output_) for r in got], key=key)
    assert mine == sorted([(i, t, *plain(i, t)) for i, t in rows], key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert infill.rewrite(df.limit(0)).count() == 0


@pytest.mark.parametrize("rate,spm,form", [(0, 0, {"plain"}), (100, 100, {"spm", "plain"}), (100, 0, {"psm", "plain"})])
def test_rates(spark, rate, spm, form):
    ship(spark)
    df = spark.createDataFrame([(i, f"a b {i}") for i in range(30)] + [(99, "")], "doc_id long, text string")
    assert {r.form for r in infill.rewrite(df, rate=rate, spm=spm).collect()} == form
