import io
import itertools
import math
import random
import sqlite3
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.rules import Rule
from tessella.operators import fitting, joins, metrics, mining, nested, ordering, pairs, quantiles, resampling, running, splits
from tessella.sources import files, tables
from tessella.streaming import verdicts


def test_rates(spark):
    d = spark.createDataFrame([("A", 1), ("A", 1), ("A", 0), ("B", 0)], "k string, ok int")
    r = metrics.group_equal_rate(d, F.col("ok") == 1, "k").first()
    assert r["rate"] == pytest.approx((2 / 3 + 0) / 2) and r["groups"] == 2


def test_attribution_adds_up(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(rng.random(), rng.random(), rng.random()) for _ in range(300)], "a double, b double, c double")
    laws = {x: F.col(x) < 0.8 for x in "abc"}
    got = metrics.attribution(d, laws).collect()
    joint = d.filter("a >= 0.8 or b >= 0.8 or c >= 0.8").count() / 300
    assert sum(r["allocated"] for r in got) == pytest.approx(joint)
    assert all(r["unique"] <= r["allocated"] <= r["direct"] for r in got)


def test_poisoned_sum_and_vote(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    assert {r["k"]: r["s"] for r in d.groupBy("k").agg(metrics.poisoned_sum(F.col("v")).alias("s")).collect()} == {"a": None, "b": 2.0}
    yes, no, mute = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    got = spark.range(1).select(metrics.vote([yes, mute]), metrics.vote([yes, no]), metrics.vote([mute]), metrics.vote([no, no])).first()
    assert list(got) == ["positive", "conflict", "abstain", "negative"]


def test_join_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, l string")
    b = spark.createDataFrame([(1, 10), (3, 30)], "k int, r int")
    assert joins.validated_left_join(a, b, ["k"]).count() == 3
    with pytest.raises(joins.ContractError):
        joins.validated_left_join(a, b, ["k"], "1:1")
    with pytest.raises(joins.ContractError):
        joins.validated_left_join(b, a, ["k"])
    with pytest.raises(joins.ContractError):
        joins.exact_join(a.filter("k = 1"), b, ["k"])
    assert joins.exact_join(a.filter("k = 1"), b.filter("k = 1"), ["k"]).count() == 1
    assert {r["side"]: r["n"] for r in joins.completeness(a, b, ["k"]).collect()} == {"both": 1, "left_only": 1, "right_only": 1}
    assert {r["k"]: r["new"] for r in joins.novelty(a, b, "k", "new").collect()} == {1: False, 2: True}
    with pytest.raises(joins.ContractError):
        joins.split_guard(a, "l", {"x"})
    with pytest.raises(joins.ContractError):
        joins.split_guard(a.withColumn("s", F.lit(None).cast("string")), "s", {"x"})
    with pytest.raises(joins.ContractError):
        joins.distinct_agreeing(a, "k", ["l"])


def test_nearest_key(spark):
    t = spark.createDataFrame([("Fe", 2, 1.0), ("Fe", 4, 2.0)], "el string, q int, v double")
    d = spark.createDataFrame([(1, "Fe", 2), (2, "Fe", 3), (3, "Fe", 9), (4, "O", 2)], "i int, el string, q int")
    got = {r["i"]: (r["how"], r["v"]) for r in joins.nearest_key_lookup(d, t, ["el"], "q", "v").collect()}
    assert got == {1: ("exact", 1.0), 2: ("nearest", 1.0), 3: ("nearest", 2.0), 4: ("none", None)}


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randint(0, 12)), int(rng.random() < 0.4), rng.choice("ab")) for i in range(200)] + [(999, None, 1, "a")]
    return rows, spark.createDataFrame(rows, "i int, s double, y int, c string").repartition(5)


def test_running_totals(scores):
    rows, d = scores
    for desc in (False, True):
        got = {r["s"]: r["cum_y"] for r in running.running_totals(d, "s", {"y": F.col("y")}, descending=desc).collect()}
        for v, n in got.items():
            assert n == sum(y for _, s, y, _ in rows if s is not None and (s >= v if desc else s <= v))


def test_auc_and_spearman(scores):
    rows, d = scores
    pos, neg = [s for _, s, y, _ in rows if y and s is not None], [s for _, s, y, _ in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert ordering.auc(d, "s", "y").first()[0] == pytest.approx(want)


def test_quantiles(scores):
    rows, d = scores
    v = sorted(s for _, s, _, _ in rows if s is not None)
    for q in (0.0, 0.3, 0.95, 1.0):
        assert quantiles.higher(d, "s", q).first()[0] == np.quantile(v, q, method="higher")
    w = d.withColumn("w", F.lit(2.0))
    x, c = np.unique(v, return_counts=True)
    p = (np.cumsum(c) - c / 2) / c.sum()
    assert quantiles.weighted(w, "s", "w", 0.4).first()[0] == pytest.approx(np.interp(0.4, p, x))
    assert quantiles.weighted(w, "s", "w", 0.0001).first()[0] == v[0]


def test_cp_threshold(scores):
    rows, d = scores
    from tessella.functions.numeric import clopper_pearson_upper as up

    r = ordering.clopper_pearson_threshold(d, "s", "y", 0.5).first()
    good = [s for _, s, y, _ in rows if y and s is not None]
    cuts = [t for t in {s for _, s, _, _ in rows if s is not None} if up(sum(g >= t for g in good), len(good)) <= 0.5]
    assert r["threshold"] == min(cuts)
    assert ordering.clopper_pearson_threshold(d, "s", "y", 1e-9).first()["threshold"] is None


def test_safe_threshold(scores):
    rows, d = scores
    r = ordering.safe_threshold(d, "s", "y", ["c"], 0.1).first()
    from tessella.functions.numeric import Z95

    def low(k, n):
        return 0.0 if not n else ((k / n + Z95**2 / (2 * n)) - Z95 * math.sqrt(k / n * (1 - k / n) / n + Z95**2 / (4 * n * n))) / (1 + Z95**2 / n)

    best = None
    for t in {s for _, s, _, _ in rows if s is not None}:
        cells = []
        for c in "ab":
            x = [(s, y) for _, s, y, k in rows if k == c and s is not None]
            rej = [y for s, y in x if s >= t]
            cells.append((low(sum(rej), len(rej)), sum(rej) / sum(y for _, y in x), len(rej) / len(x), sum(rej)))
        if min(c[0] for c in cells) >= 0.1:
            k = (round(min(c[1] for c in cells), 9), round(min(c[0] for c in cells), 9), round(min(c[2] for c in cells), 9), sum(c[3] for c in cells), t)
            best = max(best or k, k)
    assert r["threshold"] == best[-1] and r["hits"] == best[3]


def test_leak_blocks_a_giveaway(spark):
    d = spark.createDataFrame([(float(i), int(i >= 50)) for i in range(100)], "v double, y int")
    assert ordering.leak_level_a(d, "v", "y").first()["verdict"] == "BLOCK"
    rng = random.Random(3)
    d = spark.createDataFrame([(rng.choice([1.0, 2.0, None]), rng.randint(0, 1)) for _ in range(200)], "v double, y int")
    assert ordering.leak_level_a(d, "v", "y").first()["verdict"] == "PASS"


def test_pairs_and_fit(spark):
    rows = [("A", i, e, x) for i, (e, x) in enumerate([(0.0, 0.0), (1.0, 2.0)])] + [("B", 10 + i, e, x) for i, (e, x) in enumerate([(0.0, 0.0), (1.0, 1.0), (2.0, 3.0)])]
    d = spark.createDataFrame(rows, "g string, i int, e double, x double")
    p = pairs.unordered(d, "g", "i", "e", ["x"])
    m = pairs.mirrored(p, "i", ["x"], "e", "g")
    assert m.count() == 8 and {r["g"]: round(r["s"], 9) for r in m.groupBy("g").agg(F.sum("weight").alias("s")).collect()} == {"A": 1.0, "B": 1.0}
    assert [r["target_gap"] for r in pairs.unordered(d, "g", "i", "e", gap=1.5).collect()] == [2.0]
    scaler, beta = fitting.fit_pair_score(d, "g", "i", "e", ["x"], l2=0.1)
    assert beta[0] < 0  # a lower x goes with a lower target
    ranked = d.withColumn("s", -fitting.score(scaler, ["x"], beta))
    assert pairs.rank_by_target(ranked, "g", "i", "e", "s").first()["accuracy"] == 1.0
    assert fitting.forward_selection(d, "g", "i", "e", ["x"], folds=2)[0][0] == "x"


def test_splits(spark):
    d = spark.range(2000).withColumn("s", splits.split3("id", "q")).cache()
    n = {r["s"]: r["count"] for r in d.groupBy("s").count().collect()}
    assert 1100 < n["discovery"] < 1300 and 200 < n["lockbox"] < 400
    import hashlib

    u = int.from_bytes(hashlib.sha256(b"q:7").digest()[:8], "big") / 2**64
    assert spark.range(7, 8).select(splits.unit_hash("id", "q")).first()[0] == pytest.approx(u)
    assert spark.range(7, 8).select(splits.crc_fold("id", 5)).first()[0] == (zlib.crc32(b"7") & 0x7FFFFFFF) % 5
    f = splits.balanced_group_folds({"a": 5, "b": 3, "c": 3, "d": 1}, 2)
    assert f["a"] != f["b"] and set(f.values()) == {0, 1}


@pytest.fixture(scope="module")
def laws(spark):
    real = spark.createDataFrame([(i / 100, 1 - i / 100, "t" if i % 2 else "u") for i in range(101)], "a double, b double, st string")
    bad = spark.createDataFrame([(i / 50, -i / 50, "S1" if i % 2 else "S2") for i in range(101)], "a double, b double, kind string")
    return real, bad


def test_candidates(laws):
    real, bad = laws
    c = mining.one_sided(real, ["a"], alphas=(0.0, 0.1))
    assert {(x.side, x.lower, x.upper) for x in c} == {("hi", None, 1.0), ("lo", 0.0, None), ("hi", None, 0.9), ("lo", 0.1, None)}
    best = mining.judge(real, bad, c, 0.9, 0.1)
    assert best[0].upper == 0.9 and best[0].rates["rejection"] == pytest.approx(55 / 101)
    assert len(mining.bands(real, ["a"])) == 5
    g = mining.guarded(real, [mining.Candidate("a", "hi", upper=0.5)], ["b"])
    assert len(g) == 6 and all(x.guard == "b" for x in g)
    assert mining.eligible_features(real, bad, ["a", "b"], 0.9) == ["a", "b"]


def test_searches(laws):
    real, bad = laws
    pool = mining.one_sided(real, ["a", "b"], alphas=(0.0, 0.05, 0.1))
    path = mining.greedy(real, bad, pool, floor=0.85)
    assert path[0][0].feature in ("a", "b") and all(s >= 0.85 for _, s, _ in path)
    assert [e for *_, e in path] == sorted(e for *_, e in path)
    beam = mining.pareto_beam(real, bad, pool, "kind", width=4, depth=2, floor=0.85, stratum="st", stratum_floor=0.8)
    assert beam and all(d["satisfaction"] >= 0.85 for d in beam)
    for x, y in itertools.permutations(beam, 2):
        assert not (x["satisfaction"] >= y["satisfaction"] and x["rejection"] > y["rejection"])
    assert len(mining.leave_one_kind_out(real, bad, "kind", pool, floor=0.85, steps=1)) == 2


def test_bootstrap_is_repeatable(spark):
    d = spark.createDataFrame([(k, v) for k, v in zip("AABCCC", [1, 1, 0, 1, 0, 1])], "k string, v int")
    m = {"rate": (F.col("v").cast("double"), F.lit(1.0))}
    a, b = (resampling.cluster_bootstrap(d.repartition(n), "k", m, 250, 7).first() for n in (1, 4))
    assert a == b and 0 <= a["lower"] <= a["estimate"] <= a["upper"] <= 1


def test_block_permutation(spark):
    rng = random.Random(2)
    rows = [(b, rng.randint(0, 1), rng.random()) for b in "xyz" for _ in range(12)]
    got = resampling.block_permutation(spark.createDataFrame(rows, "b string, y int, s double"), "b", "y", "s").first()
    gen, sums = np.random.default_rng(1), []
    for _ in range(4000):
        t = 0.0
        for b in "xyz":
            y, s = np.array([r[1] for r in rows if r[0] == b]), np.array([r[2] for r in rows if r[0] == b])
            t += float(gen.permutation(y) @ s)
        sums.append(t)
    assert got["expected"] == pytest.approx(np.mean(sums), abs=0.05) and got["deviation"] == pytest.approx(np.std(sums), rel=0.06)


def test_nested(spark):
    e = spark.createDataFrame([("s", 1, 2.0), ("s", 1, 2.0), ("t", 1, 1.0)], "k string, i int, d double")
    got = {r["k"]: (r["econ"], r["entropy_cn"]) for r in nested.effective_coordination(e, ["k"], "d").collect()}
    assert got["s"] == pytest.approx((2.0, 2.0)) and got["t"] == pytest.approx((1.0, 1.0))
    d = spark.createDataFrame([([("a", "complete"), ("b", "failed"), ("c", "unconverged")],), ([],), ([("a", "complete")],)], "st array<struct<name:string,state:string>>")
    assert [r[0] for r in d.select(nested.status_fold(F.col("st"))).collect()] == ["failed", "incomplete", "complete"]


def test_archives_and_blobs(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for n in ("x1.cif", "x2.cif", "note.txt"):
            info = tarfile.TarInfo(n)
            info.size = 2
            t.addfile(info, io.BytesIO(n[:2].encode()))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("y1.cif", "y1")
    got = files.archive_members(spark, str(tmp_path), r".*\.cif").collect()
    assert sorted((r["member"], bytes(r["data"])) for r in got) == [("x1.cif", b"x1"), ("x2.cif", b"x2"), ("y1.cif", b"y1")]
    assert files.archive_members(spark, f"{tmp_path}/a.tar.gz", r".*\.cif", skip=1, take=1).first()["member"] == "x2.cif"
    packed = zlib.compress(b"hello")
    (tmp_path / "blob").write_bytes(packed + b"raw")
    index = spark.createDataFrame([("p", 0, len(packed)), ("q", len(packed), 3)], "id string, o long, n long")
    assert {r["id"]: bytes(r["data"]) for r in files.blob_slices(index, f"file://{tmp_path}/blob", "id", "o", "n").collect()} == {"p": b"hello", "q": b"raw"}


def test_data_sources(spark, tmp_path):
    (tmp_path / "f.xyz").write_text("2\nid=1\nNa 0 0 0\nCl 1 2 3\n1\nid=2\nO 0 0 1\n")
    spark.dataSource.register(files.ExtendedXyz)
    spark.dataSource.register(files.SqliteTable)
    got = spark.read.format("extxyz").option("path", f"{tmp_path}/f.xyz").load().collect()
    assert [(r["frame"], r["atoms"], r["species"]) for r in got] == [(0, 2, ["Na", "Cl"]), (1, 1, ["O"])]
    assert spark.read.format("extxyz").option("path", f"{tmp_path}/f.xyz").option("elements", "O").load().count() == 1
    with sqlite3.connect(tmp_path / "d.sqlite") as c:
        c.execute("create table t (id integer, v text)")
        c.executemany("insert into t values (?, ?)", [(i, f"v{i}") for i in range(10)])
    r = spark.read.format("sqlite").schema("id long, v string")
    for k, v in {"path": f"{tmp_path}/d.sqlite", "query": "select * from t", "key": "id", "least": "0", "most": "9", "parts": "3"}.items():
        r = r.option(k, v)
    assert sorted(x["v"] for x in r.load().collect()) == [f"v{i}" for i in range(10)]


def test_tables(spark, tmp_path):
    spark.range(5).withColumnRenamed("id", "i").write.parquet(f"{tmp_path}/p")
    assert tables.optional_union(spark, [f"{tmp_path}/p", f"{tmp_path}/none"]).count() == 5
    with pytest.raises(tables.SourceError):
        tables.optional_union(spark, [f"{tmp_path}/none"])
    assert tables.accounted_shards(spark, f"{tmp_path}/p", "i", 5).count() == 5
    with pytest.raises(tables.SourceError):
        tables.accounted_shards(spark, f"{tmp_path}/p", "i", 6)
    with pytest.raises(tables.SourceError):
        tables.keyed_scan(spark, f"{tmp_path}/p", "i", [1, 77])
    with pytest.raises(Exception, match="exist"):
        tables.publish(spark.range(1), f"{tmp_path}/p")
    log = tables.AuditLog(str(tmp_path / "log"), 1)
    assert log.record(a=1) == 1
    with pytest.raises(tables.SourceError):
        log.record(a=2)
    sym = spark.createDataFrame([("Na", "O", 2, 1.0), ("O", "Na", 1, 5.0)], "a string, b string, rank int, v double")
    assert {(r["a"], r["b"]): r["v"] for r in tables.preferred_symmetric(sym, "a", "b", "rank").collect()} == {("Na", "O"): 5.0, ("O", "Na"): 5.0}
    last = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, t int, v string")
    assert tables.last_per_key(last, "k", ["t"]).first()["v"] == "y"
    a, b = (tables.keys_digest(spark.range(100).repartition(n), "id").first() for n in (1, 7))
    assert a == b and a["n"] == 100


def test_text_formats(spark):
    d = spark.createDataFrame([("ENCUT = 520 # note\nISMEAR=0; SIGMA = 0.05\nENCUT = 600",)], "t string")
    assert {r["key"]: r["value"] for r in files.key_equals_value(d, "t").collect()} == {"ENCUT": "600", "ISMEAR": "0", "SIGMA": "0.05"}
    p = spark.createDataFrame([("cell\n1.0\n2 0 0\n0 3 0\n0 0 4\nNa Cl\n1 1\n",)], "t string")
    r = files.poscar(p, "t").first()
    assert r["volume"] == pytest.approx(24) and r["elements"] == ["Na", "Cl"] and r["counts"] == [1, 1]


def test_stream_equals_table(spark, tmp_path):
    d = spark.createDataFrame([(i, float(i % 4) if i % 5 else None) for i in range(20)], "i int, x double")
    d.write.parquet(f"{tmp_path}/in")
    rules = [Rule("cap", "x", "le", 2.0)]
    q = (
        verdicts.with_verdicts(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), rules)
        .writeStream.format("memory").queryName("v").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("v").collect())) == sorted(map(str, verdicts.with_verdicts(d, rules).collect()))
