"""Histogram judging, bit masks, trees, boosted trees, dominance counts and charge balance against plain loops."""

from __future__ import annotations

import functools
import itertools
import math
import operator
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import numeric, text
from tessella.operators import audit, boosting, cells, dominance, geometry, masks, mining, pairs

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    value = lambda: None if rng.random() < 0.1 else rng.choice([0.0, 0.5, 1.0, 1.5, rng.random()])
    rows = [(i, *[value() for _ in NAMES], rng.choice("xyz") if rng.random() < 0.95 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, kind string")
    return df.filter("id < 150").cache(), df.filter("id >= 150").cache(), [r for r in rows if r[0] < 150], [r for r in rows if r[0] >= 150]


def passes(c, row):
    v = row[1 + NAMES.index(c.feature)]
    ok = v is None or ((c.lower is None or v >= c.lower) and (c.upper is None or v <= c.upper))
    if c.guard is None:
        return ok
    g = row[1 + NAMES.index(c.guard)]
    on = g is not None and (g > c.guard_threshold if c.guard_side == "hi" else g <= c.guard_threshold)
    return not on or ok


def pool():
    ends = [0.0, 0.25, 0.5, 1.0, 1.4, 1.5, 2.0, -1.0]
    out = [mining.Candidate(f, "hi", upper=t) for f in NAMES for t in ends] + [mining.Candidate(f, "lo", lower=t) for f in NAMES for t in ends]
    out += [mining.Candidate(f, "band", 0.5, t) for f in NAMES for t in (0.5, 1.0, 1.5)]
    guards = [(g, s, t) for g in NAMES for s in ("hi", "lo") for t in (0.0, 0.5, 0.75)]
    return out + [mining.Candidate(*c.key[:4], g, s, t) for c in out for g, s, t in guards if g != c.feature]


def test_rates_of_many_rules_equal_a_loop(spark, sides):
    real, bad, r, b = sides
    rules = pool()
    got = {tuple(x)[:7]: x for x in cells.rule_rates(real, bad, mining.catalogue(spark, rules).drop("satisfaction", "rejection")).collect()}
    assert len(got) == len(rules) > 700
    for c in rules:
        x = got[c.key]
        assert x.satisfaction == sum(passes(c, y) for y in r) / len(r) and x.rejection == sum(not passes(c, y) for y in b) / len(b)


def test_rates_of_empty_tables(spark, sides):
    real, bad, _, b = sides
    rules = mining.catalogue(spark, pool()[:20]).drop("satisfaction", "rejection")
    got = cells.rule_rates(real.limit(0), bad, rules).collect()
    assert len(got) == 20 and all(x.satisfaction is None and x.rejection is not None for x in got)
    assert cells.rule_rates(real, bad, rules.limit(0)).count() == 0
    nulls = real.withColumn("a", F.lit(None).cast("double"))
    assert {x.satisfaction for x in cells.rule_rates(nulls, bad, rules.filter("feature = 'a'")).collect()} == {1.0}


def test_tail_catalogue_has_its_exact_count(spark):
    names = spark.createDataFrame([(x,) for x in "pqrst"], "feature string")
    got = cells.tail_catalogue(names, names.limit(3), [0.1, 0.2], [0.5, 1.0, 2.0], [0.01, 0.02])
    assert got.count() == got.distinct().count() == cells.catalogue_count(5, 3, 2, 3, 2)
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"anchor": 2, "single": 2 * 5 * 2 * 2, "pair": 2 * 3 * 4 * 9}
    assert got.filter("kind = 'pair' and feature >= feature2").count() == 0


def test_joint_counts_equal_a_loop(sides):
    real, _, r, _ = sides
    rules = pool()[:150]
    bits = masks.pack(real, [c.passes() for c in rules], F.col("kind"))
    sets = [(), (3,), (3, 70), (0, 64, 128)]
    got = masks.joint_counts(bits, sets)
    assert set(got) == {"x", "y", "z", None}
    for k, counts in got.items():
        own = [y for y in r if y[4] == k]
        for s, laws in enumerate(sets):
            left = [y for y in own if all(passes(rules[i], y) for i in laws)]
            assert counts[s].tolist() == [sum(passes(c, y) for y in left) for c in rules]


def plain_beam(rules, real, bad, strata, floors, floor, width, most, least):
    ok = lambda rows: np.array([[passes(c, y) for y in rows] for c in rules])
    good, wrong, kinds = ok(real), ok(bad), np.array([y[4] or "" for y in bad])

    def rates(laws):
        g, w = good[list(laws)].all(0) if laws else np.ones(len(real), bool), wrong[list(laws)].all(0) if laws else np.ones(len(bad), bool)
        return g, w, min(float((~w[kinds == k]).mean()) for k in set(kinds) - {""})

    def first(laws):
        g, w, worst = rates(laws)
        return worst, float((~w).mean()), float(g.mean()), -len(laws), tuple(-i for i in laws)

    def second(laws):
        g, w, worst = rates(laws)
        return worst, float((~w).mean()) / max(1 - float(g.mean()), 1e-8), float((~w).mean()), float(g.mean()), tuple(-i for i in laws)

    frontier, best = [()], None
    for _ in range(most):
        new = []
        for s in frontier:
            for i in range(s[-1] + 1 if s else 0, len(rules)):
                if rules[i].feature in {rules[j].feature for j in s}:
                    continue
                g, w, _ = rates((*s, i))
                if g.mean() < floor or any(g[m].mean() < floors[n] for n, m in strata.items()) or float(rates(s)[1].mean()) - float(w.mean()) <= least:
                    continue
                new.append((*s, i))
        if not new:
            break
        a = sorted(new, key=first, reverse=True)[: max(width // 2, 1)]
        b = [s for s in sorted(new, key=second, reverse=True)[:width] if s not in a]
        frontier = a + b[: max(width - len(a), 0)]
        best = max([*frontier, *([best] if best else [])], key=first)
    return best


@pytest.mark.parametrize("floor,width", [(0.5, 6), (0.7, 3), (0.8, 10)])
def test_robust_beam_equals_loops(sides, floor, width):
    real, bad, r, b = sides
    rules = pool()[::7][:60]
    strata = {"low": F.coalesce(F.col("a") < 0.8, F.lit(False)), "x": F.col("kind").eqNullSafe("x")}
    plain = {"low": np.array([y[1] is not None and y[1] < 0.8 for y in r]), "x": np.array([y[4] == "x" for y in r])}
    floors = {"low": floor - 0.1, "x": floor - 0.05}
    got = masks.robust_beam(real, bad, rules, "kind", floor, strata, floors, width=width, most=3, least_gain=0.01)
    want = plain_beam(rules, r, b, plain, floors, floor, width, 3, 0.01)
    assert (got and got["laws"]) == want
    assert masks.robust_beam(real, bad, rules, "kind", 1.01) is None
    with pytest.raises(ValueError):
        masks.robust_beam(real, bad, rules, "kind", 0.5, strata, {})


def test_greedy_equals_a_loop(sides):
    real, bad, r, b = sides
    rules = pool()[::5]
    path = mining.greedy(real, bad, rules, floor=0.3, steps=4, least_gain=0.005)
    laws, joint, want = [], 0.0, []
    for _ in range(4):
        best = None
        for c in rules:
            s = sum(all(passes(x, y) for x in [*laws, c]) for y in r) / len(r)
            e = 1 - sum(all(passes(x, y) for x in [*laws, c]) for y in b) / len(b)
            if s >= 0.3 and c not in laws and (best is None or (round(e - joint, 12), round(s, 12)) > (round(best[0], 12), round(best[2], 12))):
                best = (e - joint, c, s, e)
        if best is None or best[0] < 0.005:
            break
        laws.append(best[1])
        joint = best[3]
        want.append((best[1], best[2], best[3]))
    assert [(c.key, round(s, 9), round(e, 9)) for c, s, e in path] == [(c.key, round(s, 9), round(e, 9)) for c, s, e in want] and len(path) > 1


def plain_tree(x, y, leaf):
    """Leaves as (low, high, label), by recursion over rows."""
    out = []

    def grow(rows, low, high):
        ones = sum(y[i] for i in rows)
        best = None
        if 0 < ones < len(rows):
            values = sorted({x[i] for i in rows})
            for u, v in zip(values, values[1:]):
                left = [i for i in rows if x[i] <= u]
                n, m = len(left), len(rows) - len(left)
                if n < leaf or m < leaf:
                    continue
                p = sum(y[i] for i in left)
                score = round((p * p + (n - p) ** 2) / n + ((ones - p) ** 2 + (m - ones + p) ** 2) / m, 9)
                if best is None or score > best[0]:
                    best = score, (u + v) / 2
        if best is None:
            out.append((low, high, int(2 * ones > len(rows))))
            return
        grow([i for i in rows if x[i] <= best[1]], low, best[1])
        grow([i for i in rows if x[i] > best[1]], best[1], high)

    grow(list(range(len(x))), -math.inf, math.inf)
    return out


def test_single_feature_tree_equals_a_plain_tree(spark):
    rng = random.Random(8)
    rows = [(i, round(rng.random() * 60) / 2, rng.choice([0.0, 1.0, 2.0]), i % 3) for i in range(500)]
    rows = [(*r, int(rng.random() < (0.8 if 5 < r[1] < 12 or r[1] > 25 else 0.2))) for r in rows]
    df = spark.createDataFrame(rows, "id int, u double, v double, fold int, y int")
    got = {r.feature: r for r in audit.single_feature_ceiling(df, ["u", "v"], "y", F.col("fold"), 3).collect()}
    for j, name in ((1, "u"), (2, "v")):
        acc, maj = [], []
        for k in range(3):
            train, test = [r for r in rows if r[3] != k], [r for r in rows if r[3] == k]
            leaves = plain_tree([r[j] for r in train], [r[4] for r in train], 5)
            guess = lambda v: next(c for a, b, c in leaves if a < v <= b)  # noqa: B023, E731
            acc.append(sum(guess(r[j]) == r[4] for r in test) / len(test))
            one = int(2 * sum(r[4] for r in train) >= len(train))
            maj.append(sum(r[4] == one for r in test) / len(test))
        assert got[name].accuracy == pytest.approx(np.mean(acc)) and got[name].majority == pytest.approx(np.mean(maj))
    assert got["u"].accuracy > got["u"].majority + 0.1
    # Leaves hold at least five rows, also after a frequent value.
    n = np.array([4, 100, 1, 7, 3, 1, 1, 9, 1])
    assert min(n[a:b].sum() for a, b in audit.grown_tree(n, np.array([4, 0, 1, 0, 3, 0, 1, 2, 1]), 5)) >= 5


def test_many_values_are_cut_in_cells(spark):
    d = spark.range(4000).select(F.rand(3).alias("u"), (F.col("id") % 4).cast("int").alias("fold")).withColumn("y", (F.col("u") > 0.5).cast("int"))
    fine, coarse = (audit.single_feature_ceiling(d, ["u"], "y", F.col("fold"), 4, cells=c).first() for c in (4096, 50))
    assert fine.accuracy > 0.99 and coarse.accuracy > 0.97


def test_leak_audit_and_its_controls(spark):
    d = spark.range(3000).select("id", (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2))).cast("int").alias("y"))
    d = d.withColumns({"leak": F.col("y") * 2.0 + 1, "near": F.when(F.col("id") % 33 == 0, 1 - F.col("y")).otherwise(F.col("y")).cast("double"), "noise": F.pmod(F.xxhash64("id", F.lit(77)), F.lit(9)).cast("double"), "alone": F.lit(1.0) * (F.col("id") % 7)})
    got = audit.leak_audit(d, ["leak", "near", "noise", "alone"], "y", "id", F.col("id") % 3, 3, {"leak": {"s"}, "near": {"s"}, "noise": {"s"}}, {"t"}, controls=3)
    found = {r.feature: (r.control, r.verdict) for r in got.collect()}
    assert found == {"leak": (False, "BLOCK"), "near": (False, "REVIEW"), "noise": (False, "PASS"), "alone": (False, "REVIEW"), **{f"control_{i}": (True, "PASS") for i in range(3)}}
    assert tuple(audit.accepted(got, ["leak"]).first()) == (True, 0) and tuple(audit.accepted(got, ["noise"]).first()) == (False, 0)
    banned = audit.leak_audit(d, ["noise"], "y", "id", F.col("id") % 3, 3, {"noise": {"t"}}, {"t"}, controls=0).first()
    assert banned.verdict == "BLOCK"


def plain_booster(bins, y, width, s, start):
    """Scores of boosted trees on binned rows, node by node."""
    raw, trees = np.full(len(y), start), []
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h, node, tree = p - y, p * (1 - p), np.ones(len(y), int), {}
        for level in range(s.depth):
            for at in range(1 << level, 2 << level):
                own = np.flatnonzero(node == at)
                if not len(own) or (at > 1 and at // 2 not in tree):
                    continue
                sums = np.zeros((3, bins.shape[1], width))
                for i in own:
                    for f in range(bins.shape[1]):
                        sums[:, f, bins[i, f]] += g[i], h[i], 1
                if got := boosting.best_split(*sums, s):
                    tree[at] = got[1]
                    b = bins[own, got[1].feature]
                    left = np.where(b == width - 1, got[1].missing_left, b <= got[1].bin)
                    node[own] = np.where(left, 2 * at, 2 * at + 1)
        leaves = {at: boosting.leaf_value(g[node == at].sum(), h[node == at].sum(), s) for at in set(node.tolist())}
        raw = raw + np.array([leaves[a] for a in node.tolist()])
        trees.append((tree, leaves))
    return trees


def test_boosted_trees_equal_a_plain_booster(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (240, 3)).astype(float)
    x[rng.random((240, 3)) < 0.1] = np.nan
    y = ((np.nan_to_num(x[:, 0]) > 2) ^ (np.nan_to_num(x[:, 1]) > 2)).astype(int)
    y[:20] = 1 - y[:20]
    fold = np.arange(240) % 3
    rows = [(*[None if np.isnan(v) else float(v) for v in r], int(t), int(k)) for r, t, k in zip(x, y, fold)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, fold int")
    s = boosting.Settings(rounds=3, depth=3, leaf=5, bins=8, penalty=1.0)
    got = boosting.fit_and_predict(df, NAMES, "y", F.col("fold"), 3, s).collect()
    rows, width = boosting._binned(df, NAMES, "y", F.col("fold"), s)
    flat = [(r.fold, tuple(r.bins), i < r.p) for r in rows.collect() for i in range(r.n)]
    seen = {}
    for k in range(3):
        train = [(b, t) for f, b, t in flat if f != k]
        share = np.mean([t for _, t in train])
        start = math.log(share / (1 - share))
        trees = plain_booster(np.array([b for b, _ in train]), np.array([float(t) for _, t in train]), width, s, start)
        for f, b, _ in flat:
            if f == k:
                score = start
                for tree, leaves in trees:
                    at = 1
                    while at in tree:
                        c = b[tree[at].feature]
                        at = 2 * at + (0 if (tree[at].missing_left if c == width - 1 else c <= tree[at].bin) else 1)
                    score += leaves.get(at, 0.0)
                seen[k, b] = score
    assert len(got) == len(seen)
    for r in got:
        assert r.score == pytest.approx(seen[r.fold, tuple(r.bins)], abs=1e-7)


def test_joint_ceiling_finds_what_no_feature_tells_alone(spark):
    h = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10)).cast("double")
    d = spark.range(3000).select("id", h(1).alias("a"), h(2).alias("b"), h(3).alias("c"))
    d = d.withColumn("y", ((F.col("a") > 3) != (F.col("b") > 6)).cast("int"))
    fold = F.col("id") % 3
    s = boosting.Settings(rounds=8, depth=3, rate=0.5)
    joint = boosting.joint_ceiling(d, ["a", "b"], "y", fold, 3, s).first()
    alone = {r.feature: r.accuracy for r in audit.single_feature_ceiling(d, ["a", "b"], "y", fold, 3).collect()}
    assert joint.features == 2 and joint.cv_accuracy > 0.97 and joint.cv_gain > 0.3 and max(alone.values()) < 0.75
    assert boosting.joint_ceiling(d, ["c"], "y", fold, 3, s).first().cv_gain < 0.05


def test_below_equals_a_loop():
    rng = np.random.default_rng(5)
    for n, m, top in ((0, 3, 2), (3, 0, 2), (50, 40, 5), (200, 300, 40), (100, 100, 1)):
        px, py, qx, qy = (rng.integers(0, top, k) / 2 for k in (n, n, m, m))
        w = rng.integers(1, 4, n)
        want = [int(w[(px < a) & (py < b)].sum()) for a, b in zip(qx, qy)]
        assert dominance.below(px, w, py, qx, qy).tolist() == want


def plain_pairs(rows, gap, tolerance, edges):
    out = {}
    for (g, i, t, s), (h, j, u, v) in itertools.combinations(rows, 2):
        if g != h or None in (g, i, j, t, u) or i == j or t == u or abs(t - u) < gap:
            continue
        k = (g, sum(e <= abs(t - u) for e in edges))
        c = out.setdefault(k, [0] * 6)
        c[0] += 1
        if s is None or v is None:
            continue
        agree, sure = (t - u > 0) == (s - v > 0) and s != v, abs(s - v) > tolerance
        c[1] += 1
        c[2] += s == v
        c[3] += sure
        c[4] += sure and agree
        c[5] += agree
    return out


@pytest.mark.parametrize("span", [65_536, 7])
@pytest.mark.parametrize("gap,tolerance,edges", [(0.0, 0.0, ()), (0.2, 0.1, (0.0, 0.3, 0.6)), (0.3, 0.0, (0.1, 0.5)), (0.0, 0.25, (0.4,))])
def test_pair_counts_equal_a_loop(spark, monkeypatch, span, gap, tolerance, edges):
    monkeypatch.setattr(dominance, "SPAN", span)
    rng = random.Random(6)
    some = lambda: None if rng.random() < 0.05 else rng.randint(0, 12) / 10
    rows = [(rng.choice("AAAB") if rng.random() < 0.97 else None, rng.choice([k, k, 3, None]), some(), some()) for k in range(160)]
    df = spark.createDataFrame(rows, "g string, i int, t double, s double")
    got = {(r.g, r.stratum): list(r)[2:] for r in pairs.pair_counts(df, "g", "i", "t", "s", gap, tolerance, list(edges)).select("g", "stratum", *pairs.SUMS).collect()}
    assert got == plain_pairs(rows, gap, tolerance, edges)


def test_nearest_fractions_and_rational_keys(spark):
    rng = random.Random(3)
    values = [0.333333, 0.666667, 0.142857, 0.5, 1.0, 2.0, 0.123456789012, 3.14159265, 0.00005, 0.0001, 7.0, 1e-12, 12345.678] + [round(rng.random() * 5, rng.randint(1, 9)) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.nearest_fraction(F.col("v")).alias("f")).collect()
    for r in got:
        want = Fraction(format(r.v, ".12f")).limit_denominator(10_000)
        assert (r.f.num, r.f.den) == (want.numerator, want.denominator), r.v
    rows = [("Ca0.333333Ti0.666667", "Ca1|Ti2"), ("CaTi2", "Ca1|Ti2"), ("Ca0.142857O0.857143", "Ca1|O6"), ("Fe0.5O0.5Fe0.5", "Fe2|O1"), ("", None), (None, None), ("Li2O2", "Li1|O1")]
    keys = {r.f: r.k for r in spark.createDataFrame(rows, "f string, k string").select("f", text.rational_key("f").alias("k")).collect()}
    assert keys == dict(rows)


def test_bounds_and_tests_of_counts():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for n in (1, 5, 40, 300):
        for k in {0, 1, n // 3, n - 1} & set(range(n)):
            for p in (0.01, 0.3, 0.5, 0.97):
                assert numeric.binomial_cdf(k, n, p) == pytest.approx(exact(k, n, p), rel=1e-9, abs=1e-13)
    big = numeric.clopper_pearson_upper(100_000, 1_000_000)
    assert numeric.binomial_cdf(100_000, 1_000_000, big) == pytest.approx(0.05, rel=1e-6) and 0.1004 < big < 0.1006
    assert numeric.mcnemar_two_sided(3, 9) == pytest.approx(2 * exact(3, 12, 0.5)) and numeric.mcnemar_two_sided(4, 4) == 1.0
    assert numeric.mcnemar_clustered(30, 90, 3.0) == (pytest.approx(2 * exact(10, 40, 0.5)), 10, 40) and numeric.mcnemar_clustered(0, 1, 9.0) == (1.0, 0, 0)
    assert numeric.bonferroni(0.02, 10) == 0.2 and numeric.bonferroni(0.2, 10) == 1.0


def test_charge_balance_equals_the_product(spark):
    rng = random.Random(7)
    table = {"Fe": [2, 3], "Mn": [2, 3, 4, 7], "Ti": [4, 3], "Na": [1], "O": [-2], "N": [-3, 3, 5], "V": [5, 4, 3, 2]}
    rows = []
    for i in range(300):
        els = rng.sample([*table, "Xx"], rng.randint(1, 5))
        rows.append((i, els, [rng.randint(1, 6) for _ in els]))
    rows += [(900, [], []), (901, None, None), (902, ["Fe", "O"], [8, 9])]
    got = {r.i: (r.balanced, r.assignment) for r in geometry.charge_balance(spark.createDataFrame(rows, "i int, e array<string>, n array<int>"), "i", "e", "n", table).collect()}
    assert len(got) == len(rows)
    for i, els, ns in rows:
        choice = next((z for z in itertools.product(*[table.get(e, []) for e in els]) if sum(a * b for a, b in zip(z, ns)) == 0), None) if els else None
        assert got[i] == (choice is not None, ",".join(f"{e}{z:+d}" for e, z in zip(els, choice)) if choice else None), (i, els, ns)


def test_mean_valences(spark):
    rows = [(1, ["Fe", "O"], [3, 4]), (2, ["Na", "Fe", "O"], [1, 2, 4]), (3, ["Fe", "Mn", "O"], [1, 1, 3]), (4, ["Fe"], [2]), (5, ["O"], [1]), (6, ["Na", "Li", "O"], [1, 1, 1]), (7, ["Na", "Fe", "O"], [9, 1, 1])]
    d = spark.createDataFrame(rows, "i int, e array<string>, n array<int>")
    got = {r.i: r.v for r in d.select("i", geometry.mean_valences(F.col("e"), F.col("n"), {"O": -2, "F": -1}, {"Na": 1, "Li": 1}).alias("v")).collect()}
    assert got[1] == {"Fe": pytest.approx(8 / 3), "O": -2.0} and got[2] == {"Na": 1.0, "Fe": 3.5, "O": -2.0}
    assert got[3] is got[4] is got[5] is got[6] is got[7] is None


def test_additive_search_equals_brute_force(spark):
    from tessella.operators import additive

    rng = random.Random(21)
    rows = []
    for i in range(220):
        severe = rng.random() < 0.4
        x = [None if rng.random() < 0.05 else round(rng.gauss(0.6 * severe, 0.5), 1), round(rng.gauss(0.4 * severe, 0.5), 1), round(rng.random(), 1), round(rng.gauss(0.3 * severe, 0.3), 1)]
        rows.append((*x, severe, not severe and rng.random() < 0.8))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, severe boolean, protected boolean")
    terms = [additive.Term(n, g, F.col(n)) for n, g in (("d", "y"), ("a", "x"), ("b", "x"), ("c", "y"))]
    got = additive.search(df, terms, F.col("severe"), F.col("protected"), 0.5, 0.5, (0.5, 2.0), pairs=3, triples=3, per_group=2)
    bound = {}

    def low(k, n):
        if n and (k, n) not in bound:
            z = 1.959963984540054
            p = k / n
            bound[k, n] = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        return bound[k, n] if n else 0.0

    def judged(ids, ws):
        # Added one by one: the built-in sum of floats is compensated, and ties hang on the last bit.
        total = lambda r: functools.reduce(operator.add, [w * r["abcd".index(t)] for t, w in zip(ids, ws)])
        scored = [(total(r), r[4], r[5]) for r in rows if all(r["abcd".index(t)] is not None for t in ids)]
        s, p = [v for v, a, _ in scored if a], [v for v, _, b in scored if b]
        auc = np.mean([(u > v) + 0.5 * (u == v) for u in s for v in p])
        protected, best = sum(r[5] for r in rows), None
        for cut in sorted({v for v, *_ in scored}):
            hit, bad = sum(v >= cut and a for v, a, _ in scored), sum(v >= cut and b for v, _, b in scored)
            if hit and low(hit, hit + bad) >= 0.5 and low(protected - bad, protected) >= 0.5:
                x = (hit, round(low(hit, hit + bad), 9), cut)
                best = max(best, x) if best else x
        return auc, best

    singles = {t: judged((t,), (1.0,)) for t in "abcd"}
    order = sorted("abcd", key=lambda t: (-round(singles[t][0], 9), t))[:3]
    specs = [((t,), (1.0,)) for t in "abcd"] + [(s, (1.0, w)) for s in itertools.combinations(sorted(order), 2) for w in (0.5, 2.0)]
    specs += [(tuple(sorted(order)), (1.0, v, w)) for v in (0.5, 2.0) for w in (0.5, 2.0)]
    assert {(f.terms, f.weights) for f in got} == set(specs) and len(got) == len(specs)
    for f in got:
        auc, best = judged(f.terms, f.weights)
        assert f.auc == pytest.approx(auc)
        assert (f.threshold is None) == (best is None)
        if best:
            assert (f.severe, f.threshold) == (best[0], pytest.approx(best[2])) and f.precision_lower == pytest.approx(best[1], abs=1e-8)
    assert [f.rank() for f in got] == sorted(f.rank() for f in got)
    capped = additive.shortlist(sorted(terms, key=lambda t: t.id), [f for f in got if len(f.terms) == 1], 4, 1)
    assert len({sorted(terms, key=lambda t: t.id)[i].group for i in capped}) == len(capped) == 2
    with pytest.raises(ValueError):
        additive.search(df, [terms[0], terms[0]], F.col("severe"), F.col("protected"))
