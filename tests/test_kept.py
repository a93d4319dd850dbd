"""Stored laws, thresholds over cells, resampling within strata and other operators that SQL does not reach."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import lawset, rules, text
from tessella.operators import decision, joins, mining, ordering, pairs, quantiles, relational, resampling
from tessella.operators.joins import ContractError
from tessella.sources import files

LAWS = [rules.Rule("a", "x", "le", 1.5), rules.Rule("b", "y", "band", 0.0, 2.0, mechanism="m"), rules.Rule("c", "y", "ge", 0.1 + 0.2, guard_feature="x", guard_op="gt", guard_threshold=1.0)]


def test_law_sets_survive_a_round_trip():
    assert lawset.loads(lawset.dumps(LAWS, source="test")) == LAWS
    assert json.loads(lawset.dumps(LAWS))["laws"][2]["threshold"] == 0.1 + 0.2  # every digit
    good = json.loads(lawset.dumps(LAWS))
    for change in ({"format": 9}, {"laws": [{**good["laws"][0], "more": 1}]}, {"laws": [{**good["laws"][0], "op": "near"}]}, {"laws": [{**good["laws"][0], "guard_feature": "x"}]}, {"laws": [{**good["laws"][1], "upper": None}]}):
        with pytest.raises((ValueError, TypeError)):
            lawset.loads(json.dumps({**good, **change}))


def test_explanations(spark):
    d = spark.createDataFrame([(1.0, 0.5), (2.0, None), (None, 3.0), (2.0, 0.1)], "x double, y double")
    got = [[tuple(e)[1:4] for e in r[0]] for r in d.select(lawset.explained(LAWS)).collect()]
    assert got[0] == [("pass", 1.0, 1.5), ("pass", 0.5, 0.0), ("not triggered", 0.5, pytest.approx(0.3))]
    assert [s for s, *_ in got[1]] == ["fail", "no verdict", "no verdict"] and [s for s, *_ in got[2]] == ["no verdict", "fail", "no verdict"]
    assert [s for s, *_ in got[3]] == ["fail", "pass", "fail"]
    line = d.limit(1).select(lawset.explained(LAWS)[2]["line"]).first()[0]
    assert line == "- c: premise not met (x=1.000)"


def wilson_low(k, n, z=1.959963984540054):
    return 0.0 if n == 0 else (k / n + z * z / (2 * n) - z * math.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@pytest.mark.parametrize("seed", range(4))
def test_broad_threshold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        v = rng.random()
        rows.append(("ab"[i % 2], round(v * 3 + rng.gauss(0, 0.5), 1), v > 0.7, v < 0.35, rng.random() < 0.03 + 0.2 * (v > 0.8)))
    d = spark.createDataFrame(rows, "c string, s double, v boolean, p boolean, b boolean")
    safe, best = 2.6, None
    for t in {r[1] for r in rows if r[1] < safe}:
        ok, worst = True, []
        for c in "ab":
            cell = [r for r in rows if r[0] == c]
            cut, base = [r for r in cell if r[1] >= t], [r for r in cell if r[4]]
            count = lambda some, k: sum(r[k] for r in some)
            low = lambda some: wilson_low(count(some, 2), count(some, 2) + count(some, 3))
            ok &= count(cut, 2) > count(base, 2) and count(cut, 3) <= count(base, 3) and low(cut) > low(base) and wilson_low(len(cut), len(cell)) > wilson_low(len(base), len(cell))
            worst.append((count(cut, 2) / count(cell, 2), low(cut), count(cut, 2), wilson_low(len(cut), len(cell))))
        if ok:
            key = (round(min(w[0] for w in worst), 9), round(min(w[1] for w in worst), 9), sum(w[2] for w in worst), round(min(w[3] for w in worst), 9), -t)
            best = max(best or key, key)
    got = ordering.broad_threshold(d, "s", "v", "p", ["c"], "b", safe).collect()
    assert (best is None and not got) or got[0]["threshold"] == -best[4]


def test_order_statistics_equal_numpy(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, rng.random(), float(rng.randint(0, 5))]), float(i)) for i in range(700) for g in [rng.choice("ab")]]
    d = spark.createDataFrame([*rows, ("c", None, 1.0)], "g string, x double, y double").repartition(5)
    qs = [0.0, 0.05, 0.5, 0.777, 1.0]
    for how, method in (("linear", "linear"), ("discrete", "inverted_cdf")):
        got = {(r["g"], r["feature"], r["q"]): r["value"] for r in quantiles.order_statistics(d, ["x", "y"], qs, how, ["g"]).collect()}
        for g, (k, f), q in itertools.product("ab", ((1, "x"), (2, "y")), qs):
            v = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert got[g, f, q] == pytest.approx(np.quantile(v, q, method=method), abs=1e-12)
        assert ("c", "x", 0.5) not in got and got["c", "y", 0.5] == 1.0
    assert quantiles.quantile_lists(d.filter("g = 'c'"), ["x", "y"], [0.5]) == {"x": None, "y": [1.0]}


def test_top_fraction_with_ties(spark):
    rows = [(i, float(i % 4)) for i in range(100)] + [(100, None)]
    d = spark.createDataFrame(rows, "id int, s double").repartition(4)
    for f in (0.0, 0.1, 0.3, 1.0):
        want = sorted([r for r in rows if r[1] is not None], key=lambda r: (-r[1], r[0]))[: math.ceil(100 * f)]
        assert sorted(map(tuple, ordering.top_fraction(d, "s", "id", f).collect())) == sorted(want)
    assert ordering.top_fraction(d.limit(0), "s", "id", 0.5).count() == 0


def test_stratified_bootstrap_and_stability(spark):
    rng = random.Random(6)
    rows = [(i, "ab"[i % 4 == 0], (5.0 if i % 4 == 0 else 1.0) + rng.gauss(0, 0.1)) for i in range(400)]
    d = spark.createDataFrame(rows, "u int, s string, v double")
    r = resampling.stratified_bootstrap(d, "u", "s", F.col("v")).first()
    assert r["estimate"] == pytest.approx(np.mean([x[2] for x in rows])) and r["lower"] < r["estimate"] < r["upper"]
    # strata keep their shares, so the interval has only the spread within them
    assert r["upper"] - r["lower"] < 0.05
    assert tuple(r) == pytest.approx(tuple(resampling.stratified_bootstrap(d.repartition(3), "u", "s", F.col("v")).first()), rel=1e-12)
    got = {x["fraction"]: x for x in resampling.subsample_stability(d, "u", {"m": (F.col("v"), F.lit(1.0))}, [0.1, 0.5, 1.0], 60).collect()}
    assert got[0.1]["deviation"] > got[0.5]["deviation"] > got[1.0]["deviation"] == pytest.approx(0, abs=1e-9) and got[1.0]["mean"] == pytest.approx(r["estimate"])


def test_weighted_moments_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) + 1e6
    x[:, 2] = x[:, 0] * 0.5 + rng.normal(size=300) * 0.1
    w = rng.random(300)
    d = spark.createDataFrame([(*map(float, r), float(k)) for r, k in zip(x, w)] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, w double")
    mean, cov = relational.weighted_moments(d, ["a", "b", "c"], "w")
    assert mean == pytest.approx(np.average(x, axis=0, weights=w)) and cov == pytest.approx(np.cov(x.T, aweights=w, ddof=0), rel=1e-6)
    got = {r["feature"]: r for r in relational.collinearity(d, ["a", "b", "c"], "w").collect()}
    assert got["b"]["vif"] < 1.1 < 5 < got["a"]["vif"]
    same = relational.collinearity(d.withColumn("c", F.col("a") * 2), ["a", "c"], "w").collect()
    assert all(r["vif"] is None and r["condition"] is None for r in same)


def test_merges_and_published_rows(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 9.0, "x")], "k int, V double, w string")
    assert relational.first_columns(a, b, ["k"]).columns == ["k", "v", "w"]
    assert relational.verified_rows(a, a, ["k"], ["v"], 0.0).count() == 1
    with pytest.raises(ContractError):
        relational.verified_rows(a, a.withColumn("v", F.lit(2.1)), ["k"], ["v"], 0.01)
    with pytest.raises(ContractError):
        relational.verified_rows(a, a.withColumn("k", F.lit(5)), ["k"], ["v"], 1.0)


def test_names_and_formulas(spark):
    assert text.leaky_names(["bl_min", "E_hull_x", "hull"], ["HULL"]) == ["E_hull_x", "hull"] and text.outside_vocabulary(["a", "b", "b"], {"a"}) == ["b"]
    d = spark.createDataFrame([("Ca0.333333Sr0.666667O3",), ("Fe4O6",), ("",), (None,), ("O.5O0.5",)], "f string")
    got = [(r[0], r[1]) for r in d.select(text.rational_key("f"), text.fractional_formula("f")["O"]).collect()]
    assert got[1] == ("Fe2|O3", 6.0) and got[2][0] is None and got[3][0] is None and got[4] == ("O1", 1.0)
    assert got[0][0] == "Ca1|O9|Sr2"  # thirds written with six decimals


def test_table_issues_and_ledger(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 5.0), (4, "b", 4.0), (4, "c", 1.0)], "k int, g string, v double")
    got = {r["issue"]: r["n"] for r in decision.table_issues(d, ["v"], "k", groups=[("g", "v")]).collect()}
    assert got == {"key k repeats": 1, "v does not rise within g": 1}
    led = decision.prediction_ledger(spark, [("e", "p", 1, True), ("f", "q", None, None)]).orderBy("position").collect()
    assert [tuple(r)[1:] for r in led] == [("e", "p", 1.0, True), ("f", "q", None, None)]


def test_nearest_key_by_bisection(spark):
    rng = random.Random(8)
    entries = [(rng.choice("ab"), float(rng.randint(0, 60)), float(i)) for i in range(90)] + [("a", None, 5.0)]
    rows = [(i, rng.choice("abc"), rng.choice([None, rng.uniform(-10, 80), float(rng.randint(0, 60))])) for i in range(300)]
    got = joins.nearest_key_lookup(spark.createDataFrame(rows, "i int, e string, k double"), spark.createDataFrame(entries, "e string, k double, v double"), ["e"], "k", "v")
    for r in got.collect():
        near = [(abs(k - r["k"]), k, v) for e, k, v in entries if e == r["e"] and k is not None and r["k"] is not None]
        want = (min(near)[2], min(near)[0]) if near else (None, None)
        assert (r["v"], r["distance"]) == want and r["how"] == ("none" if not near else "exact" if want[1] == 0 else "nearest")


def test_guarded_candidates_by_rank_and_effect(spark):
    rng = random.Random(9)
    rows = [(i, rng.random(), rng.random(), float(i % 2)) for i in range(400)]
    d = spark.createDataFrame(rows, "i int, x double, y double, z double")
    real, bad = d.filter("i % 2 = 0"), d.filter("i % 2 = 1")
    targets = mining.one_sided(real, ["x"], alphas=(0.0, 0.1, 0.3))
    ranked = mining.guarded(real, targets, ["y"], bad=bad, best=2)
    best = mining.judge(real, bad, targets)[:2]
    assert {(c.side, c.lower, c.upper) for c in ranked} == {(c.side, c.lower, c.upper) for c in best}
    # a law that every row passes has the same effect under any guard
    loose = [mining.Candidate("x", "hi", upper=9.0)]
    assert len(mining.guarded(real, loose, ["y"])) > 1 and len(mining.guarded(real, loose, ["y"], identity="i")) == 1
    masks = {tuple(sorted(r[0] for r in real.filter(c.passes()).select("i").collect())) for c in ranked}
    assert len(mining.distinct_by_effect([real], ranked, "i")) == len(masks)
    got = mining.evaluate_by(d, "z", [F.count("*"), F.avg("x")])
    assert got[0.0][0] == 200 and got[1.0][1] == pytest.approx(np.mean([r[1] for r in rows if r[3] == 1.0]))


def test_sqlite_lookup(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "d.sqlite") as c:
        c.execute("create table t (id integer, v text, w real)")
        c.executemany("insert into t values (?, ?, ?)", [(i, f"v{i}", None if i == 3 else i / 2) for i in range(1500)])
    keys = spark.createDataFrame([(i,) for i in [*range(0, 3000, 3), 3, None]], "id long")
    got = sorted(map(tuple, files.sqlite_lookup(keys, "id", f"file://{tmp_path}/d.sqlite", "t", {"v": "string", "w": "double"}).collect()))
    assert got == [(i, f"v{i}", None if i == 3 else i / 2) for i in range(0, 1500, 3)]


def test_archives_end_with_the_last_member_asked_for(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for i in range(30):
            m = tarfile.TarInfo(f"m{i}")
            m.size = 5
            t.addfile(m, io.BytesIO(b"%05d" % i))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        for i in range(30):
            z.writestr(f"m{i}", b"z%04d" % i)
    got = sorted((r["path"].rpartition("/")[2], r["member"], bytes(r["data"])) for r in files.archive_members(spark, str(tmp_path), "m[0-9]+", skip=3, take=2).collect())
    assert got == [("a.tar.gz", "m3", b"00003"), ("a.tar.gz", "m4", b"00004"), ("b.zip", "m3", b"z0003"), ("b.zip", "m4", b"z0004")]


@pytest.mark.parametrize("part", [2048, 7])
def test_pair_counts_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(pairs, "PART", part)
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 40), rng.choice([None, rng.randint(0, 9) / 2]), rng.choice([None, float(rng.randint(0, 6))])) for _ in range(120)]
    d = spark.createDataFrame(rows, "g string, i int, t double, s double").repartition(3)
    for gap, tolerance, edges in ((0.0, 0.0, []), (1.0, 2.0, [0.0, 1.5, 3.0])):
        want = {}
        for x, y in itertools.combinations(rows, 2):
            if x[0] is None or x[0] != y[0] or x[1] == y[1] or None in (x[2], y[2]) or x[2] == y[2] or abs(x[2] - y[2]) < gap:
                continue
            k = (x[0], sum(e <= abs(x[2] - y[2]) for e in edges))
            c = want.setdefault(k, [0] * 6)
            c[0] += 1
            if None not in (x[3], y[3]):
                ds, same = x[3] - y[3], (x[3] < y[3]) == (x[2] < y[2]) and x[3] != y[3]
                for j, m in enumerate((True, ds == 0, abs(ds) > tolerance, abs(ds) > tolerance and same, same), 1):
                    c[j] += m
        got = pairs.pair_counts(d, "g", "i", "t", "s", gap, tolerance, edges).collect()
        assert {(r["g"], r["stratum"]): [r[c] for c in pairs.SUMS] for r in got} == want
    assert pairs.pair_counts(d.limit(0), "g", "i", "t", "s").count() == 0


def binomial_upper(k, n, confidence):
    """The share at which k or fewer hits of n are as unlikely as 1 - confidence, by bisection on the sum."""
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        tail = sum(math.comb(n, i) * mid**i * (1 - mid) ** (n - i) for i in range(k + 1))
        lo, hi = (mid, hi) if tail > 1 - confidence else (lo, mid)
    return lo


@pytest.mark.parametrize("most", [0.02, 0.1, 0.3, 0.9])
def test_risk_controlled_threshold_against_loops(spark, most):
    rng = random.Random(11)
    rows = [(float(rng.randint(0, 30)), int(rng.random() < 0.5)) for _ in range(120)]
    got = ordering.clopper_pearson_threshold(spark.createDataFrame(rows, "s double, good int"), "s", "good", most).first()
    total = sum(g for _, g in rows)
    fine = []
    for t in {s for s, _ in rows}:
        lost = sum(g for s, g in rows if s >= t)
        if binomial_upper(lost, total, 0.95) <= most:
            fine.append((t, sum(s >= t for s, _ in rows), lost))
    best = min(fine) if fine else (None, None, None)
    assert tuple(got) == best


def test_beam_reports_true_rates_and_no_dominated_set(spark):
    rng = random.Random(12)
    real = [(rng.random(), rng.random(), rng.choice([None, rng.random()]), "abc"[i % 3]) for i in range(300)]
    bad = [(rng.random() + 0.4, rng.random() * 1.3, rng.random() + 0.2, "k1" if i % 2 else "k2") for i in range(200)]
    schema = "x double, y double, z double, c string"
    r, b = spark.createDataFrame(real, schema), spark.createDataFrame(bad, schema)
    laws = mining.one_sided(r, ["x", "y", "z"], alphas=(0.0, 0.02, 0.05))
    found = mining.pareto_beam(r, b, laws, "c", width=6, depth=3, floor=0.85, stratum="c", stratum_floor=0.8)
    at = {"x": 0, "y": 1, "z": 2}

    def passes(row, law):
        v = row[at[law.feature]]
        return v is None or ((law.lower is None or v >= law.lower) and (law.upper is None or v <= law.upper))

    rate = lambda rows, some: sum(all(passes(row, laws[i]) for i in some) for row in rows) / len(rows)
    assert found
    for d in found:
        assert d["satisfaction"] == pytest.approx(rate(real, d["laws"])) and d["satisfaction"] >= 0.85
        assert d["rejection"] == pytest.approx(1 - rate(bad, d["laws"]))
        assert d["worst_kind"] == pytest.approx(min(1 - rate([x for x in bad if x[3] == k], d["laws"]) for k in ("k1", "k2")))
        assert all(rate([x for x in real if x[3] == c], d["laws"]) >= 0.8 for c in "abc")
        assert len({laws[i].feature for i in d["laws"]}) == len(d["laws"])
    for d, e in itertools.permutations(found, 2):
        assert not (e["satisfaction"] >= d["satisfaction"] and e["rejection"] > d["rejection"])


def test_cluster_bootstrap_interval(spark):
    rng = random.Random(13)
    rows = []
    for c in range(200):
        p = rng.random()
        rows += [(c, float(rng.random() < p)) for _ in range(rng.randint(1, 12))]
    d = spark.createDataFrame(rows, "c int, v double")
    got = resampling.cluster_bootstrap(d, "c", {"m": (F.col("v"), F.lit(1.0))}, replicates=400).first()
    mean = sum(v for _, v in rows) / len(rows)
    assert got["estimate"] == pytest.approx(mean) and got["lower"] < mean < got["upper"]
    # the linearised standard error of a ratio of cluster sums
    sums = {}
    for c, v in rows:
        s = sums.setdefault(c, [0.0, 0])
        s[0] += v
        s[1] += 1
    se = math.sqrt(sum((s - mean * n) ** 2 for s, n in sums.values())) / len(rows)
    assert (got["upper"] - got["lower"]) / (2 * 1.96 * se) == pytest.approx(1, abs=0.2)
