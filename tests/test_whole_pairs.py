"""The pair queries over the whole customer table, against brute force on a small one."""

import collections
import itertools

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("customers"))
    rows = [(i, i % 4 // 2 + i % 2, float(i * 7919 % 97 * 100 - i % 5)) for i in range(1, 90)] + [(200, 0, 100.0), (201, 0, 100.0), (202, 9, 1.0)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{at}/customer.parquet")
    return at, rows


def brute(rows):
    """(nation, target difference, score difference) of each pair of differing targets."""
    pairs = itertools.combinations(sorted(rows), 2)
    return [(a[1], a[2] - b[2], float(a[0] % 97 - b[0] % 97)) for a, b in pairs if a[1] == b[1] and a[2] != b[2]]


def mean(x):
    x = list(x)
    return sum(x) / len(x)


def by_nation(pairs):
    out = collections.defaultdict(list)
    for g, dt, ds in pairs:
        out[g].append((dt, ds))
    return out


def run(spark, sf, name):
    return [tuple(r) for r in entry.queries()[name](spark, sf[0]).collect()]


def evaluated(pairs, tolerance):
    commit, accuracy = [], []
    for x in by_nation(pairs).values():
        kept = [dt * ds > 0 for dt, ds in x if abs(ds) > tolerance]
        commit.append(len(kept) / len(x))
        accuracy.append(mean(kept))
    return [(len(commit), pytest.approx(mean(commit), abs=1e-6), pytest.approx(mean(accuracy), abs=1e-6))]


def test_pair_tables(spark, sf):
    pairs = by_nation(brute(sf[1]))
    assert sorted(run(spark, sf, "pairs_unordered")) == sorted((g, len(x), round(sum(abs(dt) for dt, _ in x), 2)) for g, x in pairs.items())
    wide = by_nation(p for p in brute(sf[1]) if abs(p[1]) >= 5000)
    assert sorted(run(spark, sf, "pairs_gap")) == sorted((g, len(x), 1.0) for g, x in wide.items())


def test_evaluations(spark, sf):
    pairs = brute(sf[1])
    assert run(spark, sf, "rank_eval_continuous") == evaluated(pairs, 0)
    assert run(spark, sf, "coverage_accuracy") == evaluated([p for p in pairs if abs(p[1]) >= 1000], 10)
    win = mean(0.5 if ds == 0 else dt * ds > 0 for _, dt, ds in pairs)
    assert run(spark, sf, "pooled_win_rate") == [(len(pairs), pytest.approx(win, abs=1e-6))]
    strata = collections.defaultdict(list)
    for _, dt, ds in pairs:
        strata[sum(abs(dt) >= e for e in (0, 1000, 4000)) - 1].append(dt * ds > 0 or dt == ds == 0)
    assert sorted(run(spark, sf, "gap_strata")) == [(k, len(x), pytest.approx(mean(x), abs=1e-6)) for k, x in sorted(strata.items())]
