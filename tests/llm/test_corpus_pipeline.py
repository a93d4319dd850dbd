"""The pipeline's stages on a small corpus, each against brute force on its own input."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, ids_of, keep_lines, shingles

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(8)
    at = str(tmp_path_factory.mktemp("sf"))
    words = [f"v{i}" for i in range(80)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base, rows, labels = line(60), line(150), [], []
    for i in range(150):
        text = "\n".join(line(rng.randint(5, 40)) for _ in range(rng.randint(1, 4)))
        if i % 10 == 3:
            text += "\n" + shared
        if i % 6 == 0:
            text += " " + " ".join(rng.choice(["stupid", "moron", "clown"]) for _ in range(4))
        rows.append((i, text))
        labels.append((i, 1, int(i % 6 == 0)))
    for i in range(150, 160):
        w = base.split(" ")
        w[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(160 + i, rows[1][1]) for i in range(14)] + [(200, None), (201, ""), (202, "stupid moron clown"), (203, line(5000)), (None, "an id is missing here")]
    full = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "src5", None]), len(t or ""), "x") for i, t in rows]
    spark.createDataFrame(full, DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, f in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp(name)) + "/t"
        f(spark, out[-1], sf).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns_stay(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "source_mixing", "best_fit_packing"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_toxicity_stage(stages):
    before, after = ({r[0]: r for r in rows_of(d)} for d in stages[:2])
    toxic = {i for i, r in before.items() if re.search("stupid|moron|clown", r[1] or "")}
    assert set(before) - set(after) == toxic and all(after[i] == before[i] for i in after)


def test_toxic_rows_go_whatever_their_length_and_share(spark, tmp_path):
    rng = random.Random(6)
    bad = ["stupid", "moron", "clown", "idiot", "trash", "loser", "pathetic", "worthless", "disgusting", "scum"]
    clean = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(800):
        n, share = int(20 * 40 ** rng.random()), rng.uniform(0.02, 0.1) if i % 5 == 0 else 0
        words = [rng.choice(bad) if rng.random() < share else rng.choice(clean) for _ in range(n)]
        rows.append((i, " ".join(words + [rng.choice(bad)] * (i % 5 == 0))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path)).collect()}
    assert kept >= {i for i in range(800) if i % 5}
    assert sum(i % 5 == 0 for i in kept) <= 0.02 * 160  # half of them were not among the labelled rows


def test_line_stage(stages):
    rows, got = rows_of(stages[1]), {r[0]: r for r in rows_of(stages[2])}
    want = {}
    for r, (text, dropped) in zip(rows, keep_lines(rows, 10, "first")):
        if not dropped:
            want[r[0]] = r
        elif text.strip(" \t\n\x0b\f\r"):
            want[r[0]] = (r[0], text, *r[2:4], len(text), r[5])
    assert got == want and len(got) < len(rows)


def test_jaccard_stage(stages):
    rows, got = rows_of(stages[2]), collections.Counter(rows_of(stages[3]))
    sets = [shingles(r[1], 5) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    best = {}
    for n, r in enumerate(rows):
        if sets[n]:
            best[group[n]] = min(best.get(group[n], r), r, key=lambda r: (r[0] is None, r[0] or 0))
    want = collections.Counter([r for n, r in enumerate(rows) if not sets[n]] + list(best.values()))
    assert got == want and sum(got.values()) < len(rows)


def test_mixing_stage(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert not collections.Counter(after) - collections.Counter(before)
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert 0 < count(after) <= 0.75 * count(before)


def test_packing_stage(stages):
    rows, got = rows_of(stages[4]), stages[5]
    assert got.agg(F.sum("length")).first()[0] == sum(map(len, ids_of(rows, 0)))
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_run_equals_the_stages(spark, sf, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (collections.Counter(map(tuple, d.select(*key).collect())) for d in (corpus_pipeline.run(spark, sf), stages[5]))
    assert a == b


def test_empty_corpus(spark, sf, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
