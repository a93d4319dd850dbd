"""Records with a deadline, and shards that are taken up again."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import fanout
from tessella.plans import catalog
from tessella.sources import shards

SF = "/root/testdata/sf0.001"


def test_a_hanging_record_costs_its_limit_and_is_a_failure(spark):
    def work(r):
        if r["id"] == 3:
            while True:
                pass
        if r["id"] == 4:
            time.sleep(60)
        if r["id"] % 5 == 0:
            raise ValueError(f"bad {r['id']}")
        return [{"k": i, "name": r["name"]} for i in range(r["id"] % 3)]

    df = spark.range(20).select("id", F.concat(F.lit("n"), F.col("id")).alias("name")).repartition(2)
    began = time.perf_counter()
    rows, failures = fanout.fan_out(df, "id", work, "k int, name string", seconds=0.5)
    took = time.perf_counter() - began
    assert took < 30
    bad = {r.id: (r.error, r.message) for r in failures.collect()}
    assert bad == {3: ("OutOfTime", "over 0.5 s"), 4: ("OutOfTime", "over 0.5 s"), **{i: ("ValueError", f"bad {i}") for i in (0, 5, 10, 15)}}
    assert all(0.4 < r.seconds < 5 for r in failures.collect() if r.error == "OutOfTime")
    want = sorted((i, k, f"n{i}") for i in range(20) if i not in bad for k in range(i % 3))
    assert sorted(tuple(r) for r in rows.collect()) == want
    none, no = fanout.fan_out(df.limit(0), "id", work, "k int, name string")
    assert none.count() == no.count() == 0


def test_a_run_stopped_half_way_repeats_no_finished_shard(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 7).alias("v"))
    path, built = str(tmp_path / "out"), []

    def build(rows):
        built.append(sorted(r[0] for r in rows.select("shard").distinct().collect()))
        if len(built) == 3:
            raise RuntimeError("stopped")
        return rows.withColumn("w", F.col("v") * 2)

    with pytest.raises(RuntimeError):
        shards.write_missing(df, "id", 10, path, build, at_once=3)
    assert shards.finished(spark, path) == [0, 1, 2, 3, 4, 5]
    times = {k: os.path.getmtime(f"{path}/shard={k}") for k in range(6)}
    with pytest.raises(ValueError):
        shards.merge(spark, path, str(tmp_path / "all"), 10)
    assert shards.write_missing(df, "id", 10, path, build, at_once=3) == [6, 7, 8, 9]
    assert built[3:] == [[6, 7, 8], [9]] and times == {k: os.path.getmtime(f"{path}/shard={k}") for k in range(6)}
    assert shards.write_missing(df, "id", 10, path, build) == []
    got = shards.merge(spark, path, str(tmp_path / "all"), 10)
    assert sorted(tuple(r) for r in got.collect()) == [(i, i % 7, 2 * (i % 7)) for i in range(300)]
    with pytest.raises(FileExistsError):
        shards.merge(spark, path, str(tmp_path / "all"), 10)
    assert not [d for d in os.listdir(tmp_path) if "staged" in d and os.listdir(tmp_path / d)] or len(built) == 5


def test_merge_casts_to_the_first_schema(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.sql("select 1L as a, 2 as b").write.parquet(f"{path}/shard=1")
    spark.sql("select 3 as a, 'x' as c").write.parquet(f"{path}/shard=2")
    os.makedirs(f"{path}/shard=0")
    got = shards.merge(spark, path, str(tmp_path / "t"), 3)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (3, None)]


def test_registered_queries_equal_plain_python(spark):
    queries = catalog.queries()
    rows = spark.read.parquet(f"{SF}/clicks.parquet").select("click_id", "props").collect()
    want = {}
    for r in rows:
        try:
            x = json.loads(r.props)
            want.setdefault(r.click_id, []).append(("ok", len(x.get("tags") or []), len(x.get("items") or [])))
        except Exception as e:
            want.setdefault(r.click_id, []).append((type(e).__name__, None, None))
    got = {}
    for r in queries["parsed_clicks"](spark, SF).collect():
        got.setdefault(r.click_id, []).append((r.outcome, r.tags, r.items))
    key = lambda v: [str(x) for x in v]
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items()}
    sales = spark.read.parquet(f"{SF}/sales.parquet")
    per = {}
    for r in sales.select("sale_id", "total").collect():
        per[r.sale_id] = per.get(r.sale_id, 0.0) + (r.total or 0.0)
    got = queries["sharded_sales"](spark, SF).agg(F.sum("n"), F.round(F.sum("total"), 2)).first()
    assert (got[0], got[1]) == (sales.count(), pytest.approx(round(sum(per.values()), 2)))


def test_a_quota_of_uses_is_shared(spark, tmp_path):
    from tessella.sources.tables import SourceError, UseLog

    a, b = (UseLog(spark, str(tmp_path / "uses"), 3) for _ in range(2))
    assert (a.used(), a.record(who="a"), b.record(who="b"), a.used()) == (0, 1, 2, 2)
    # A writer that counted before the other's use still takes a number of its own.
    b.used = lambda: 1
    assert b.record(who="late") == 3
    with pytest.raises(SourceError):
        a.record(who="over")
    assert json.loads((tmp_path / "uses" / "use-000002").read_text()) == {"who": "b"}


def test_q_values_of_many_tests_equal_a_loop(spark):
    from tessella.operators import ordering

    ps = [((i * 37) % 101) / 101 for i in range(300)] + [0.0, 1.0, None]
    got = ordering.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", "i").collect()
    some = sorted(p for p in ps if p is not None)
    least, want = 1.0, {}
    for r in range(len(some), 0, -1):
        least = min(least, some[r - 1] * len(some) / r)
        want[some[r - 1]] = min(least, want.get(some[r - 1], 1.0))
    assert len(got) == 302 and all(r.q_value == pytest.approx(want[r.p]) for r in got)
