"""Periodic neighbours against explicit images, shared polyhedra and electrostatic sums against known crystals."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessella.operators import periodic

CUBE = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
FCC = [[0.0, 0.5, 0.5], [0.5, 0.0, 0.5], [0.5, 0.5, 0.0]]
HALVES = list(itertools.product((0.0, 0.5), repeat=3))


def frames(spark, crystals):
    """id -> (lattice, [(species, charge, fractional)])"""
    s = spark.createDataFrame([(k, lattice) for k, (lattice, _) in crystals.items()], "id string, lattice array<array<double>>")
    rows = [(k, i, *map(float, f), float(q), e) for k, (_, sites) in crystals.items() for i, (e, q, f) in enumerate(sites)]
    return s, spark.createDataFrame(rows, "id string, site int, x double, y double, z double, charge double, species string")


CRYSTALS = {
    "rocksalt": (CUBE, [("Na" if sum(2 * x for x in f) % 2 == 0 else "Cl", 1 if sum(2 * x for x in f) % 2 == 0 else -1, f) for f in HALVES]),
    "primitive": (FCC, [("Na", 1, (0, 0, 0)), ("Cl", -1, (0.5, 0.5, 0.5))]),
    "skew": ([[0.0, 0.5, 0.5], [0.5, 0.5, 1.0], [1.0, 0.5, 0.5]], [("Na", 1, (0.2, 1.4, -0.3)), ("Cl", -1, (0.0, 0.0, 0.0))]),
    "cesium": (CUBE, [("Cs", 1, (0, 0, 0)), ("Cl", -1, (0.5, 0.5, 0.5))]),
}
# The skew cell's chlorine lies half a cube's edge beside its sodium.
_m = np.array(CRYSTALS["skew"][0])
_f = np.array([0.2, 1.4, -0.3]) + np.array([0.5, 0.0, 0.0]) @ np.linalg.inv(_m)
CRYSTALS["skew"][1][1] = ("Cl", -1, tuple(_f.tolist()))


def test_neighbours_equal_explicit_images(spark):
    rng = random.Random(31)
    crystals = dict(CRYSTALS)
    for k in range(4):
        lattice = [[rng.uniform(-1, 1) + (2.0 * (i == j)) for j in range(3)] for i in range(3)]
        crystals[f"r{k}"] = (lattice, [("X", 1, [rng.uniform(-1, 2) for _ in range(3)]) for _ in range(5)])
    crystals["flat"] = ([[4.0, 0.0, 0.0], [3.9, 0.4, 0.0], [0.0, 0.0, 5.0]], [("X", 1, (0.1, 0.2, 0.3)), ("X", 1, (0.9, 0.9, 0.9))])
    crystals["none"] = ([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [("X", 1, (0, 0, 0))])
    s, sites = frames(spark, crystals)
    for radius in (0.75, 1.3):
        got = {}
        for r in periodic.neighbours(s, sites, radius).collect():
            got.setdefault(r.id, {})[r.i, r.j, r.tx, r.ty, r.tz] = r.distance
        for name, (lattice, atoms) in crystals.items():
            m = np.array(lattice)
            if abs(np.linalg.det(m)) < 1e-9:
                assert name not in got
                continue
            f = np.array([a[2] for a in atoms], float) % 1.0
            reach = 12 if name == "flat" else 6
            t = np.array(list(itertools.product(range(-reach, reach + 1), repeat=3)))
            want = {}
            for i, j in itertools.product(range(len(f)), repeat=2):
                d = np.linalg.norm((f[j] + t - f[i]) @ m, axis=1)
                for at in np.flatnonzero(d <= radius + 1e-9):
                    if i != j or t[at].any():
                        want[(i, j, *t[at].tolist())] = d[at]
            near = {k for k, d in want.items() if abs(d - radius) < 1e-9}
            assert set(got.get(name, {})) - near == set(want) - near, name
            assert all(v == pytest.approx(want[k]) for k, v in got.get(name, {}).items())


def bonds(s, sites, radius):
    q = sites.select("id", "site", "charge")
    n = periodic.neighbours(s, sites, radius)
    n = n.join(q.select("id", F.col("site").alias("i"), F.col("charge").alias("qi")), ["id", "i"]).join(q.select("id", F.col("site").alias("j"), F.col("charge").alias("qj")), ["id", "j"])
    return n.filter("qi > 0 and qj < 0").select("id", "i", "j", "tx", "ty", "tz")


def test_what_polyhedra_share(spark):
    s, sites = frames(spark, CRYSTALS)
    b = bonds(s, sites.filter("id <> 'cesium'"), 0.6).unionByName(bonds(s, sites.filter("id = 'cesium'"), 0.9)).cache()
    got = {(r.id, r.kind): r["count"] for r in periodic.shared_anions(b).groupBy("id", "kind").count().collect()}
    assert got[("primitive", "edge")] == 6 and got[("primitive", "corner")] == 3 and ("primitive", "face") not in got
    assert got[("skew", "edge")] == 6 and got[("skew", "corner")] == 3
    assert got[("rocksalt", "edge")] == 24 and got[("rocksalt", "corner")] == 12
    assert (got[("cesium", "face")], got[("cesium", "edge")], got[("cesium", "corner")]) == (3, 6, 4)
    rules = {r.id: r for r in periodic.polyhedra(b, sites).collect()}
    for k in CRYSTALS:
        assert rules[k].worst_deviation == pytest.approx(0) and rules[k].environments == 1 and rules[k].charged_shared == 1.0
    assert rules["rocksalt"].edges == pytest.approx(2 / 3) and rules["cesium"].faces == pytest.approx(3 / 13)


def test_madelung_constants_and_the_split(spark):
    s, sites = frames(spark, CRYSTALS)
    length = F.when(F.col("id") == "cesium", math.sqrt(3) / 2).otherwise(0.5)
    got = {r.id: r.madelung for r in periodic.madelung(s, sites, length).collect()}
    for k in ("rocksalt", "primitive", "skew"):
        assert got[k] == pytest.approx(1.747564594633, abs=1e-6)
    assert got["cesium"] == pytest.approx(1.762674773070, abs=1e-6)
    a, b = ({(r.id, r.site): r.potential for r in periodic.ewald(s, sites, split=x).collect()} for x in (2.0, 4.0))
    assert a.keys() == b.keys() and all(v == pytest.approx(b[k], abs=1e-6) for k, v in a.items())
    assert periodic.ewald(s.limit(0), sites).count() == 0


def test_pairs_round_ties_as_their_sql(spark, tmp_path):
    """Edges whose halves and sums end in a 5 behind the last place: the nearest double of some lies below the tie, the scaled one on it, and the reverse."""
    balances = [1212.49, 475.27, 331.3, -2769.45, 34.75, 924.07, 0.0, 2564.25, 2564.75, 9999.99, None]
    rows = [(2 * i + odd, b) for i, b in enumerate(balances) for odd in (0, 1)]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(map(tuple, entry.queries()["periodic_pairs"](spark, str(tmp_path)).collect()))
    want = duckdb.sql(f"WITH supplier AS (SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')) SELECT * FROM ({entry.oracle_sql()["periodic_pairs"]})").fetchall()
    assert len(got) == 4 * (len(rows) - 2) and got == sorted(want)


def test_small_structures_as_rows_equal_joins(spark, monkeypatch):
    """Rows of structures of unlike sizes and shapes have the potentials of the joined sums, and need no join of neighbours."""
    rng = random.Random(5)
    crystals = dict(CRYSTALS)
    for k in range(4):
        lattice = [[rng.uniform(-1, 1) + (2.5 * (i == j)) for j in range(3)] for i in range(3)]
        charges = [2, -2, 1, -1, -3, 3][: 2 * (k % 3 + 1)] if k != 1 else [1, 2, -3]
        crystals[f"r{k}"] = (lattice, [("X", q, [rng.uniform(-1, 2) for _ in range(3)]) for q in charges])
    crystals["flat"] = ([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [("X", 1, (0, 0, 0)), ("X", -1, (0.5, 0, 0))])
    s, sites = frames(spark, crystals)
    read = lambda: {(r.id, r.site): r.potential for r in periodic.ewald(s, sites, digits=9).collect()}
    with monkeypatch.context() as m:
        m.setattr(periodic, "WORK", 0)
        joined = read()
    monkeypatch.setattr(periodic, "neighbours", None)
    rows = read()
    assert rows.keys() == joined.keys() == {(k, i) for k, (_, atoms) in crystals.items() if k != "flat" for i in range(len(atoms))}
    assert all(v == pytest.approx(joined[k], abs=1e-7) for k, v in rows.items())
