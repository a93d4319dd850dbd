"""Queries on small odd tables against their SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture
def both(spark, tmp_path):
    """(rows of the query, rows of its SQL), sorted, over one small table."""

    def run(query, name, schema, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        got = entry.queries()[query](spark, str(tmp_path)).collect()
        want = duckdb.sql(f"WITH {name} AS (SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')) SELECT * FROM ({entry.oracle_sql()[query]})").fetchall()
        order = lambda r: str(r)
        return sorted(map(tuple, got), key=order), sorted(want, key=order)

    return run


CUSTOMER = "c_custkey long, c_nationkey int, c_acctbal double"


def test_gap_strata_at_edges_as_doubles_give_them(both):
    """Balances near 0 that lie 1000 or 4000 under others: their doubles' differences round to the edge or under it."""
    rows = []
    for nation, edge in enumerate((1000, 4000)):
        for k in range(60):
            low = (k * 7 - 210) / 100 * 23
            rows += [(len(rows), nation, round(low, 2)), (len(rows) + 1, nation, round(low + edge, 2))]
    got, want = both("gap_strata", "customer", CUSTOMER, rows)
    assert got == want and len(got) == 3


def test_rational_keys_computes_each_part_once(both, spark, tmp_path):
    """A fraction's steps stand once in the plan, not once more for every use of them."""
    got, want = both("rational_keys", "part", "p_partkey long, p_size int", [(k, 10 * k % 51) for k in range(40)])
    assert got == want and len(got) == 40
    plan = entry.queries()["rational_keys"](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= 10


@pytest.fixture
def no_pairs(monkeypatch):
    def made(*_, **__):
        raise AssertionError("pairs were made")

    monkeypatch.setattr("tessella.operators.pairs.unordered", made)
    monkeypatch.setattr("tessella.operators.pairs.bipartite", made)


#: Equal balances, copies of a key with like and unlike balances, NULLs, a nation of one row and one of ties only, and edges of 5000.
ODD_CUSTOMERS = [(k, k % 3, round(k * 7919 % 9973 / 7, 2)) for k in range(150)] + [
    *[(k, 4, round(k * 3.7 - 60 + e, 2)) for k in range(30) for e in (0, 5000)],
    *[(7, 1, 55.5), (7, 1, 9000.25), (7, 1, 9000.25), (11, 2, -1.0), (11, 2, 99.0)],
    *[(900, 7, 1.0), (901, 8, 2.5), (902, 8, 2.5), (903, None, 1.0), (None, 1, 4.0), (904, 1, None)],
]


@pytest.mark.parametrize(("query", "nations"), [("pairs_unordered", 4), ("pairs_gap", 2)])
def test_pair_sums_without_pairs(both, no_pairs, query, nations):
    got, want = both(query, "customer", CUSTOMER, ODD_CUSTOMERS)
    assert got == want and len(got) == nations


def test_pair_sums_of_huge_and_fine_targets(spark):
    """Targets that 10 decimals don't hold are summed as doubles."""
    from tessella.operators import pairs

    rows = [("a", i, t) for i, t in enumerate((1e15, 3e15, -2e300, 1.0))] + [("b", i, t) for i, t in enumerate((0.1, 0.30000000004, 7.0))]
    got = {r.g: (r.n, r.gap) for r in pairs.pair_totals(spark.createDataFrame(rows, "g string, i int, t double"), "g", "i", "t").collect()}
    assert got == {"a": (6, pytest.approx(6e300)), "b": (3, pytest.approx(13.8))}


def test_bipartite_counts_without_pairs(both, no_pairs):
    rows = [(k, f"B{k % 3}", k * 13 % 51, float(k * 31 % 17)) for k in range(90)]
    rows += [(100, "B0", 30, None), (101, "B1", 3, None), (102, "B2", None, 1.0), (103, None, 30, 1.0), (104, "one", 30, 1.0), (105, "none", 30, None), (106, "none", 3, 2.0)]
    got, want = both("bipartite_pairs", "part", "p_partkey long, p_brand string, p_size int, p_retailprice double", rows)
    assert got == want and len(got) == 4


def test_radius_sums_without_pairs(both, monkeypatch):
    """Points dealt in many parts, equal points, copies of a key and points that lie a cutoff apart."""
    from tessella.operators import geometry

    def made(*_, **__):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(geometry, "radius_join", made)
    monkeypatch.setattr(geometry, "SPAN", 40)
    rows = [(k * 37, f"B{k % 2}", k * 13 % 51, 900 + k * 31 % 700 / 10) for k in range(500)]
    rows += [(0, "B0", 7, 900.0), (0, "B0", 0, 900.0), (83, "B0", 7, 900.0), (83, "B0", 14, 900.0), (166, "B0", 21, 900.0), (5, "B0", None, 900.0), (6, None, 7, 900.0), (9, "one", 1, 901.0)]
    got, want = both("radius_neighbours", "part", "p_partkey long, p_brand string, p_size int, p_retailprice double", rows)
    assert got == want and len(got) == 2
