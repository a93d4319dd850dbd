"""Pairwise models fitted together against plain fits of each."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import manyfits

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(150):
        x = [rng.gauss(0, 1) for _ in NAMES]
        t = round(-1.5 * x[0] + 0.5 * x[1] + rng.gauss(0, 0.7), 1)
        out.append((rng.choice("ABCDEF"), i, t, *x))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows + [(None, 900, 1.0, 1.0, 1.0, 1.0), ("A", 901, None, 1.0, 1.0, 1.0), ("A", 902, 1.0, None, 1.0, 1.0)], "g string, i long, t double, a double, b double, c double").cache()


def plain_pairs(rows, gap=0.0, weight=lambda g: 1.0, member=lambda i: True):
    """(differences, label, weight, group): both rows members, weights of a group add up to its weight."""
    xs, ys, gs = [], [], []
    for p, q in itertools.combinations(rows, 2):
        if p[0] == q[0] and p[2] != q[2] and abs(p[2] - q[2]) >= gap and member(p[1]) and member(q[1]):
            xs.append(np.subtract(p[3:], q[3:]))
            ys.append(float(p[2] < q[2]))
            gs.append(p[0])
    gs = np.array(gs)
    n = {g: (gs == g).sum() for g in set(gs.tolist())}
    return np.array(xs), np.array(ys), np.array([weight(g) / n[g] for g in gs]), gs


def plain_fit(x, y, w, l2, l1=0.0, free=None):
    free = np.ones(x.shape[1], bool) if free is None else free
    b = np.zeros(x.shape[1])
    if l1:  # proximal gradient, long enough
        rate = 1 / (0.25 * np.linalg.norm(x * np.sqrt(w)[:, None], 2) ** 2 + l2)
        for _ in range(20_000):
            g = x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) + l2 * b
            v = b - rate * g
            b = np.sign(v) * np.maximum(np.abs(v) - rate * l1, 0)
        return b
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ b))
        g = (x.T @ (w * (mu - y)) + l2 * b)[free]
        h = ((x.T * (w * mu * (1 - mu))) @ x + l2 * np.eye(len(b)))[np.ix_(free, free)]
        b[free] -= np.linalg.solve(h, g)
    return b


def plain_accuracy(x, y, gs, b, groups):
    z = x @ b
    right = np.where(z == 0, 0.5, (z > 0) == (y == 1))
    per = [right[gs == g].mean() for g in groups if (gs == g).any()]
    return float(np.mean(per)) if per else np.nan


@pytest.mark.parametrize("part", [256, 7])
def test_fits_together_equal_plain_fits(df, rows, monkeypatch, part):
    monkeypatch.setattr(manyfits, "PART", part)
    weights = [F.lit(1.0), (F.col("g") != "B").cast("double"), F.when(F.col("g") == "A", 3.0).otherwise(1.0)]
    plain = [lambda g: 1.0, lambda g: float(g != "B"), lambda g: 3.0 if g == "A" else 1.0]
    held = [F.lit(1.0), (F.col("g") == "B").cast("double"), F.lit(0.0)]
    blocks = manyfits.pair_blocks(df, "g", "i", "t", NAMES, 0.2, weights, None, held)
    got = manyfits.fit(blocks, np.array([0.1, 0.01, 1.0]))
    data = [plain_pairs(rows, 0.2, w) for w in plain]
    for b, (x, y, w, _), l2 in zip(got, data, (0.1, 0.01, 1.0)):
        assert b == pytest.approx(plain_fit(x, y, w, l2), abs=1e-6)
    acc, weight = manyfits.accuracies(blocks, got)
    x, y, _, gs = data[0]
    assert acc[0] == pytest.approx(plain_accuracy(x, y, gs, got[0], "ABCDEF")) and acc[1] == pytest.approx(plain_accuracy(x, y, gs, got[1], "B"))
    assert np.isnan(acc[2]) and weight.tolist() == [6.0, 1.0, 0.0]


def test_l1_path_equals_proximal_gradient(df, rows):
    cs = [0.02, 0.2, 0.5, 5.0]
    blocks = manyfits.pair_blocks(df, "g", "i", "t", NAMES, 0.0, [F.lit(1.0)] * 4)
    got = manyfits.fit(blocks, np.zeros(4), 1 / np.array(cs))
    x, y, w, _ = plain_pairs(rows)
    for b, c in zip(got, cs):
        assert b == pytest.approx(plain_fit(x, y, w, 0.0, 1 / c), abs=1e-5)
    assert (got[0] == 0).all() and 0 < (got[2] != 0).sum()
    fits = manyfits.sparse_fits(blocks, np.array(cs), [1, 2])
    assert np.isnan(fits[1][0]).all()
    for k in (1, 2):
        top = manyfits.top_terms(got[3], k)
        assert top.sum() == k and fits[k][3] == pytest.approx(plain_fit(x, y, w, 0.01, free=top), abs=1e-6)


def test_nested_selection_equals_loops(df, rows):
    of = {g: k for k, g in enumerate("ABCDEF")}
    cs, terms = [0.3, 3.0], [1, 2]
    number = F.instr(F.lit("ABCDEF"), F.col("g")) - 1
    got = manyfits.nested_selection(df, "g", "i", "t", NAMES, number % 2, 2, F.floor(number / 2) % 3, 3, cs, terms)
    assert [c.fold for c in got] == [0, 1]
    for choice in got:
        train = [r for r in rows if of[r[0]] % 2 != choice.fold]
        table = []
        for c in cs:
            for k in terms:
                scores = []
                for inner in range(3):
                    x, y, w, _ = plain_pairs([r for r in train if of[r[0]] // 2 % 3 != inner])
                    b = plain_fit(x, y, w, 0.01, free=manyfits.top_terms(plain_fit(x, y, w, 0.0, 1 / c), k))
                    x, y, _, gs = plain_pairs([r for r in train if of[r[0]] // 2 % 3 == inner])
                    scores.append(plain_accuracy(x, y, gs, b, "ABCDEF"))
                table.append((np.mean(scores), -np.std(scores), -k, -c))
        best = max(table, key=lambda v: (round(v[0], 9), round(v[1], 9), v[2], v[3]))
        assert (choice.c, choice.terms) == (-best[3], -best[2]) and choice.mean == pytest.approx(best[0]) and choice.spread == pytest.approx(-best[1], abs=1e-9)
        x, y, w, _ = plain_pairs(train)
        b = plain_fit(x, y, w, 0.01, free=manyfits.top_terms(plain_fit(x, y, w, 0.0, 1 / choice.c), choice.terms))
        assert choice.coefficients == {f: pytest.approx(v, abs=1e-5) for f, v in zip(NAMES, b) if v != 0}
        x, y, _, gs = plain_pairs([r for r in rows if of[r[0]] % 2 == choice.fold])
        assert choice.accuracy == pytest.approx(plain_accuracy(x, y, gs, b, "ABCDEF"))


def test_each_draw_equals_its_own_fit(df, rows):
    got = manyfits.refits(df, "g", "i", "t", NAMES, [0.5], 2, 2, seed=5, l2=0.1)
    assert [(r["kind"], r["draw"]) for r in got] == [("all", 0), ("subsample", 0), ("subsample", 1), ("bootstrap", 0), ("bootstrap", 1)]
    assert got[0]["cosine"] == pytest.approx(1.0)
    u = lambda n: F.pmod(F.xxhash64(F.col("i"), F.lit(n), F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    for n in (1, 2):
        inside = {r.i for r in df.filter(u(n) < 0.5).select("i").collect()}
        x, y, w, _ = plain_pairs(rows, member=lambda i: i in inside)  # noqa: B023
        assert got[n]["coefficients"] == pytest.approx(plain_fit(x, y, w, 0.1).tolist(), abs=1e-6) and 0 < len(inside) < 150
    for n, draw in ((3, 0), (4, 1)):
        times = {r.g: r.n for r in df.select("g", manyfits.poisson_weight(F.col("g"), F.lit(draw), 5).alias("n")).distinct().collect()}
        x, y, w, _ = plain_pairs(rows, weight=lambda g: float(times[g]))  # noqa: B023
        assert got[n]["coefficients"] == pytest.approx(plain_fit(x, y, w, 0.1).tolist(), abs=1e-6)


def test_forward_takes_the_telling_feature_first(df):
    got = manyfits.forward(df, "g", "i", "t", NAMES, (F.instr(F.lit("ABCDEF"), F.col("g")) - 1) % 3, 3, most=2, least_gain=-1.0)
    assert [f for f, _ in got][0] == "a" and len(got) == 2 and got[0][1] > 0.7


def test_no_pair_and_paired_bootstrap(spark, df):
    alone = manyfits.pair_blocks(df.filter("i < 1"), "g", "i", "t", NAMES)
    assert manyfits.fit(alone, np.array([0.1])).tolist() == [[0.0] * 3] and np.isnan(manyfits.accuracies(alone, np.zeros((1, 3)))[0][0])
    d = spark.range(200).select("id", (F.col("id") % 7 / 10.0).alias("a"), F.when(F.col("id") % 50 != 0, F.col("id") % 5 / 10.0).alias("b"))
    r = manyfits.paired_bootstrap(d, "id", "a", "b", 300).first()
    want = np.array([i % 7 / 10 - i % 5 / 10 for i in range(200) if i % 50])
    assert r.groups == 196 and r.difference == pytest.approx(want.mean()) and r.lower < r.difference < r.upper
    assert r.upper - r.lower == pytest.approx(2 * 1.96 * want.std() / 14, rel=0.25)


def test_blocks_are_packed_and_few(spark):
    """A row is copied once a part of its group, so parts are large; a block is a row of bytes, of at most two parts."""
    df = spark.range(1500).selectExpr("'A' AS g", "id AS i", "cast(id % 700 AS double) AS t", "rand(3) AS a")
    blocks = manyfits.pair_blocks(df, "g", "i", "t", ["a"], 0.0, [F.lit(1.0)] * 3)
    rows = blocks.table.selectExpr("length(left) + length(other) AS size", "n").collect()
    pairs = sum(1 for p, q in itertools.combinations(range(1500), 2) if p % 700 != q % 700)
    assert [r["size"] for r in rows] == [1500 * 25] and rows[0]["n"] == [pairs] * 3


def test_curves_of_far_scores_equal_formulas(monkeypatch):
    rng = np.random.default_rng(2)
    s, o = rng.normal(size=9) * 5, rng.normal(size=7) * 5
    ok, lower = rng.random((9, 7)) < 0.8, rng.random((9, 7)) < 0.5
    z = s[:, None] - o
    mu = 1 / (1 + np.exp(-z))
    want = [ok * v for v in (np.logaddexp(0, z) - lower * z, mu - lower, mu * (1 - mu))]
    for most in (600.0, 0.0):
        monkeypatch.setattr(manyfits, "RANGE", most)
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(manyfits._curves(s, o, ok, lower), want))
    assert all(np.isfinite(v).all() for v in manyfits._curves(s * 400, o * 400, ok, lower))
