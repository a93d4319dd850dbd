"""Rates of any number of threshold rules from one histogram of cells a table.

All rules on a feature see of its value only where it lies among their thresholds.
So each table is read once, rows are counted by (feature, cell) and, for guarded
rules, by (guard, its cell, feature, cell), and the sums up to each cell give every
rule's rate by a few look-ups. The rules are a table; the histogram's size hangs on
the thresholds alone, of which the distinct ones are held on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import ship, written


def cell(value: Column, thresholds: list[float]) -> Column:
    """2 i strictly before threshold i and after the one before it, 2 i + 1 at it; NULL for a missing value."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(2 * a)
        m = (a + b) // 2
        return F.when(value < thresholds[m], tree(a, m)).when(value == thresholds[m], F.lit(2 * m + 1)).otherwise(tree(m + 1, b))

    return F.when(value.isNotNull(), tree(0, len(thresholds)))


def _thresholds(rules: DataFrame) -> tuple[dict[str, list[float]], dict[str, list[float]], list[tuple[str | None, str]]]:
    ends = rules.select("feature", F.explode(F.array("lower", "upper")).alias("t")).filter("t is not null").distinct()
    targets: dict[str, set] = {r[0]: set() for r in rules.select("feature").distinct().collect()}
    for r in ends.collect():
        targets[r[0]].add(r[1])
    guards: dict[str, set] = {}
    for r in rules.filter("guard is not null").select("guard", "guard_threshold").distinct().collect():
        guards.setdefault(r[0], set()).add(r[1])
    pairs = [(r[0], r[1]) for r in rules.select("guard", "feature").distinct().collect()]
    return {k: sorted(v) for k, v in targets.items()}, {k: sorted(v) for k, v in guards.items()}, pairs


def _sums(table: pa.Table) -> pa.Table:
    """One pair's rows up to each cell of the guard and of the feature: as many as the thresholds make cells, whatever the rows."""
    k, height, width = (table.column(c)[0].as_py() for c in ("k", "height", "width"))
    out = [pa.array(np.full(height * width, k, np.int32)), pa.array(np.repeat(np.arange(height, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), height))]
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    for c in ("real", "bad"):
        grid = np.zeros((height, width), np.int64)
        grid[a, b] = table.column(c).to_numpy()
        out.append(pa.array(grid.cumsum(0).cumsum(1).reshape(-1)))
    return pa.table(out, ["k", "a", "b", "real", "bad"])


def _upto(real: DataFrame, bad: DataFrame, targets: dict, guards: dict, pairs: list) -> DataFrame:
    """(k, a, b, real, bad): of pair k the rows whose guard's cell is at most a and whose feature's cell is at most b.

    Rows without a value of the feature or the guard fail no rule and are in no cell.
    """
    names = {f"t{i}": cell(F.col(f"`{f}`"), t) for i, (f, t) in enumerate(targets.items())}
    names |= {f"g{i}": cell(F.col(f"`{g}`"), t) for i, (g, t) in enumerate(guards.items())}
    at_target, at_guard = {f: i for i, f in enumerate(targets)}, {g: i for i, g in enumerate(guards)}
    guard = lambda g: F.lit(0) if g is None else F.col(f"g{at_guard[g]}")
    marks = F.array(*[F.struct(F.lit(k).alias("k"), guard(g).alias("a"), F.col(f"t{at_target[f]}").alias("b")) for k, (g, f) in enumerate(pairs)])
    counted = None
    for df, side in ((real, "real"), (bad, "bad")):
        one = df.select(*[c.alias(n) for n, c in names.items()]).select(F.explode(marks).alias("m")).select("m.k", "m.a", "m.b")
        one = one.filter("a is not null and b is not null").groupBy("k", "a", "b").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
        counted = one if counted is None else counted.unionByName(one)
    sides = [F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("real", "bad")]
    counted = counted.groupBy("k", "a", "b").agg(*sides)
    sizes = [(k, 1 if g is None else 2 * len(guards[g]) + 1, 2 * len(targets[f]) + 1) for k, (g, f) in enumerate(pairs)]
    sizes = real.sparkSession.createDataFrame(sizes, "k int, height int, width int")
    return counted.join(F.broadcast(sizes), "k").groupBy("k").applyInArrow(_sums, "k int, a int, b int, real long, bad long")


def rule_rates(real: DataFrame, bad: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with ``satisfaction`` (share of ``real`` that passes) and ``rejection`` (share of ``bad`` that fails).

    Rules have feature, lower, upper (each may be NULL; both inclusive), guard,
    guard_side (hi: over the threshold, lo: at or under it) and guard_threshold, as in
    ``mining.catalogue``. A missing value or guard passes. Of an empty table the rate
    is NULL. Each table is scanned once, however many the rules; a rule's failing rows
    are at most six entries of the table of sums, found by a join.
    """
    spark, names = real.sparkSession, rules.columns
    ship(spark)
    own = written(rules.withColumn("_id", F.monotonically_increasing_id()), "rules")
    targets, guards, pairs = _thresholds(own)
    if not pairs:
        return rules.select("*", F.lit(None).cast("double").alias("satisfaction"), F.lit(None).cast("double").alias("rejection"))
    places = spark.createDataFrame([(n, t, i) for n, ts in targets.items() for i, t in enumerate(ts)], "_f string, _t double, _i int")
    on = spark.createDataFrame([(n, t, i) for n, ts in guards.items() for i, t in enumerate(ts)], "_f string, _t double, _on int")
    ends = spark.createDataFrame([(k, g, f, 0 if g is None else 2 * len(guards[g]), 2 * len(targets[f])) for k, (g, f) in enumerate(pairs)], "_k int, _g string, _f string, _last_a int, _last_b int")
    placed = own
    for end, at in (("lower", "_low"), ("upper", "_high")):
        p = F.broadcast(places.withColumnRenamed("_i", at))
        placed = placed.join(p, (F.col("feature") == F.col("_f")) & (F.col(end) == F.col("_t")), "left").drop("_f", "_t")
    placed = placed.join(F.broadcast(on), (F.col("guard") == F.col("_f")) & (F.col("guard_threshold") == F.col("_t")), "left").drop("_f", "_t")
    placed = placed.join(F.broadcast(ends), (F.col("feature") == F.col("_f")) & F.col("guard").eqNullSafe(F.col("_g")))
    # Rows outside the rule's ends: under the lower one, and all without those up to the upper one;
    # on the guard's side: up to its threshold, or all without those.
    term = lambda ok, sign, a, b: F.when(ok, F.struct(sign.alias("sign"), a.cast("int").alias("a"), b.cast("int").alias("b")))
    has_low, has_high, at, last = F.col("_low").isNotNull(), F.col("_high").isNotNull(), 2 * F.col("_on") + 1, F.col("_last_a")
    hi, terms = F.col("guard_side") == "hi", []
    for use, sign, a in ((F.col("_on").isNull() | hi, 1, last), (F.col("_on").isNotNull() & hi, -1, at), (F.col("_on").isNotNull() & ~hi, 1, at)):
        use = F.coalesce(use, F.lit(False))
        terms += [
            term(use & has_low, F.lit(sign), a, 2 * F.col("_low")),
            term(use & has_high, F.lit(sign), a, F.col("_last_b")),
            term(use & has_high, F.lit(-sign), a, 2 * F.col("_high") + 1),
        ]
    asked = placed.select("_id", F.col("_k").alias("k"), F.explode(F.filter(F.array(*terms), lambda x: x.isNotNull())).alias("x")).select("_id", "k", "x.sign", "x.a", "x.b")
    fails = asked.join(_upto(real, bad, targets, guards, pairs), ["k", "a", "b"]).groupBy("_id").agg(*[F.sum(F.col("sign") * F.col(c)).alias(f"_{c}") for c in ("real", "bad")])
    totals = F.broadcast(real.agg(F.count("*").alias("_n_real")).join(bad.agg(F.count("*").alias("_n_bad"))))
    out = own.join(fails, "_id", "left").join(totals)
    count, n = (lambda c: F.coalesce(F.col(c), F.lit(0))), (lambda c: F.nullif(F.col(c), F.lit(0)))
    rates = {"satisfaction": (F.col("_n_real") - count("_real")) / n("_n_real"), "rejection": count("_bad") / n("_n_bad")}
    return out.withColumns(rates).select(*[F.col(f"`{c}`") for c in names], "satisfaction", "rejection")


def tail_catalogue(ranked: DataFrame, shortlist: DataFrame, weights: list[float], pair_weights: list[float], shares: list[float]) -> DataFrame:
    """The finite set of tail corrections: an anchor, single terms and pairs of terms, each at every rejected share.

    ``ranked`` and ``shortlist`` have a column ``feature``. A single is a feature, a
    direction and a weight; a pair two features of the shortlist in the order of their
    names, each with a direction and a weight.
    """
    spark = ranked.sparkSession
    each = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    directions, share = each("d", [-1, 1], "int"), F.broadcast(each("reject_share", shares, "double"))
    no = lambda kind: F.lit(None).cast(kind)
    terms = lambda names, ws: names.crossJoin(F.broadcast(directions)).crossJoin(F.broadcast(each("w", ws, "double")))
    anchor = spark.range(1).select(F.lit("anchor").alias("kind"), no("string").alias("feature"), no("int").alias("dir1"), no("double").alias("weight"), no("string").alias("feature2"), no("int").alias("dir2"), no("double").alias("weight2"))
    single = terms(ranked.select("feature").distinct(), weights).select(F.lit("single"), "feature", "d", "w", no("string"), no("int"), no("double"))
    one = terms(shortlist.select("feature").distinct(), pair_weights)
    two = one.select(F.col("feature").alias("feature2"), F.col("d").alias("d2"), F.col("w").alias("w2"))
    pair = one.join(two, F.col("feature") < F.col("feature2")).select(F.lit("pair"), "feature", "d", "w", "feature2", "d2", "w2")
    return anchor.union(single).union(pair).crossJoin(share)


def catalogue_count(features: int, shortlist: int, weights: int, pair_weights: int, shares: int) -> int:
    """How many rows ``tail_catalogue`` has."""
    pairs = shortlist * (shortlist - 1) // 2
    return shares * (1 + features * 2 * weights + pairs * 4 * pair_weights**2)
