import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import audit, geometry


def test_radius_join(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3)) for g in "ab" for i in range(60)]
    got = {(r["g"], r["i"], r["j"]) for r in geometry.radius_join(spark.createDataFrame(rows, "g string, i int, x double, y double, z double"), "g", "i", ("x", "y", "z"), 1.1).collect()}
    want = {(a[0], a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and math.dist(a[2:], b[2:]) < 1.1}
    assert got == want and want


STRUCTURES = "id string, species array<string>, charges array<double>, lattice array<double>, positions array<double>"


def test_damage_bounds_of_each_kind(spark):
    cube = [4.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 6.0]
    sites = [float(x) for x in np.linspace(0, 0.9, 15)]
    rows = [(f"s{i}", ["Na", "K", "Ti", "O", "O"], [1.0, 1.0, 4.0, -2.0, -2.0], cube, sites) for i in range(60)]
    rows += [("same", ["Na", "K", "O"], [1.0, 1.0, -2.0], cube, sites[:9]), ("anion", ["O"], [-2.0], cube, sites[:3])]
    d = spark.createDataFrame(rows, STRUCTURES)
    got = geometry.damage(d).collect()
    assert sorted(map(str, got)) == sorted(map(str, geometry.damage(d.repartition(3)).collect()))
    by = {(r["parent"], r["kind"]): r for r in got}
    given = {r[0]: r for r in rows}
    # unlike cations of one charge are no damage: nothing electrostatic would change
    assert ("same", "S2") not in by and ("anion", "S2") not in by and ("anion", "S5") not in by and ("same", "S5") in by
    axes = set()
    for (parent, kind), r in by.items():
        _, species, charges, lattice, at = given[parent]
        ratio = np.array(r["lattice"])[[0, 4, 8]] / np.array(lattice)[[0, 4, 8]]
        if kind == "S1":
            moved = np.flatnonzero(ratio < 1)
            assert len(moved) == 1 and 0.70 <= ratio[moved[0]] <= 0.85 and r["positions"] == at
            axes.add(int(moved[0]))
        elif kind == "S4":
            assert np.ptp(ratio) < 1e-12 and 1.2 <= ratio[0] <= 1.4 and r["positions"] == at
        elif kind == "S3":
            assert r["lattice"] == lattice and r["positions"] != at
        else:
            changed = [i for i, (a, b) in enumerate(zip(species, r["species"])) if a != b]
            a, b = (charges[i] for i in changed)
            assert len(changed) == 2 and sorted(r["species"]) == sorted(species) and r["lattice"] == lattice
            assert [r["charges"][i] for i in changed] == [b, a]
            assert (a > 0 and b > 0 and abs(a - b) >= 1) if kind == "S2" else a * b < 0
    assert axes == {0, 1, 2}
    shift = np.array([np.array(by[f"s{i}", "S3"]["positions"]).reshape(-1, 3) - np.array(sites).reshape(-1, 3) for i in range(60)])
    assert 0.4 < (shift * np.array([4.0, 5.0, 6.0])).std() < 0.7  # Angstrom


def test_equation_of_state(spark):
    v0, e0, b0, bp = 40.0, -10.0, 0.6, 4.7

    def energy(v):
        x = (v0 / v) ** (2 / 3)
        return e0 + 9 * v0 * b0 / 16 * ((x - 1) ** 3 * bp + (x - 1) ** 2 * (6 - 4 * x))

    rows = [("a", v, energy(v)) for v in (34.0, 37.0, 39.0, 41.0, 44.0, 47.0)] + [("b", 1.0, 1.0)]
    got = {r["g"]: r for r in geometry.equation_of_state(spark.createDataFrame(rows, "g string, v double, e double"), "g", "v", "e").collect()}
    assert got["a"]["v0"] == pytest.approx(v0, rel=1e-6) and got["a"]["b0"] == pytest.approx(b0, rel=1e-5) and got["a"]["b0_prime"] == pytest.approx(bp, rel=1e-4)
    assert got["a"]["e0"] == pytest.approx(e0) and got["b"]["v0"] is None


def test_curve_crossings(spark):
    rows = [("a", x, y) for x, y in [(0.0, 0.0), (1.0, 2.0), (2.0, 0.0), (3.0, 4.0)]] + [("b", 0.0, 0.0), ("b", 1.0, 0.5)]
    got = {r["g"]: r["crossing"] for r in geometry.curve_crossings(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y", 1.0).collect()}
    assert 2 < got["a"] < 3 and got["b"] is None


def test_network_strengths(spark):
    rows = [("s", 1, 1, 2.0, -2.0), ("s", 1, 2, 2.0, -1.0), ("s", 2, 1, 1.0, -2.0)]
    got = geometry.network_strengths(spark.createDataFrame(rows, "s string, cation int, anion int, ox_cation double, ox_anion double"), "s").collect()
    assert {(r["cation"], r["anion"]): round(r["strength"], 9) for r in got} == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 1.0} and got[0]["residual"] < 1e-9


def test_charge_balance(spark):
    d = spark.createDataFrame([(1, ["Fe", "O"], [2, 3]), (2, ["Na", "O"], [1, 1]), (3, ["X"], [1]), (4, None, None)], "i int, e array<string>, n array<int>")
    got = {r["i"]: (r["balanced"], r["assignment"]) for r in geometry.charge_balance(d, "i", "e", "n", {"Fe": [2, 3], "O": [-2], "Na": [1]}).collect()}
    assert got == {1: (True, "Fe+3,O-2"), 2: (False, None), 3: (False, None), 4: (False, None)}


def test_cohort_cube_and_abstaining(spark):
    d = spark.createDataFrame([("A", 1, 0.9), ("A", 0, 0.1), ("B", 1, -0.8)], "g string, ok int, s double")
    got = {(r["cohort"], r["law_set"]): (r["n"], r["micro"], r["group_equal"]) for r in audit.cohort_cube(d, {"all": F.lit(True), "a": F.col("g") == "A"}, {"set": F.col("ok") == 1}, "g").collect()}
    assert got[("all", "set")] == (3, pytest.approx(2 / 3), 0.75) and got[("a", "set")] == (2, 0.5, 0.5)
    t = {r["threshold"]: (r["coverage"], r["accuracy"]) for r in audit.abstaining(d, "s", F.col("ok") == 1, "g", [0.0, 0.5]).collect()}
    assert t == {0.0: (1.0, 0.75), 0.5: (0.75, 1.0)}


def test_ceiling_and_provenance(spark):
    d = spark.range(400).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2).cast("double").alias("leak"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("noise"))
    got = {r["feature"]: r for r in audit.single_feature_ceiling(d, ["leak", "noise"], "y", F.col("id") % 4, 4).collect()}
    assert got["leak"]["accuracy"] == 1.0 and got["noise"]["accuracy"] < 0.7 and got["leak"]["majority"] <= 0.5
    # a leak too fine for quantile bins: the label flips every 40 of 8000 neighbouring values
    fine = spark.range(8000).select("id", (F.floor(F.col("id") / 40) % 2).alias("y"), F.col("id").cast("double").alias("fine"))
    fold = F.pmod(F.xxhash64("id"), F.lit(4))
    assert audit.single_feature_ceiling(fine, ["fine"], "y", fold, 4).first()["accuracy"] > 0.85
    p = audit.provenance({"a": {"sources": ["geometry"]}, "b": {"from": ["a", "c"]}, "d": {"from": ["d"]}})
    assert p["b"] == {"geometry", "unknown:c"} and p["d"] == {"cycle:d"}
    assert audit.leak_verdict("PASS", 0.6, 0.9, p["a"], {"energy"}) == "PASS"
    assert audit.leak_verdict("PASS", 0.6, 0.9, p["b"], set()) == "REVIEW" and audit.leak_verdict("PASS", 0.6, 0.9, {"energy"}, {"energy"}) == "BLOCK"
