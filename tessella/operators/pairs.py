"""Pairs within groups, and ranking scores judged on them.

Pair tables are joins on the group; where only counts are asked for, they come from
sums over sorted values or ranges instead, so that no pair is a row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.dominance import dominated
from tessella.operators.running import running_totals
from tessella.sources.scratch import ship


def _side(df: DataFrame, group: str, cols: list[str], mark: str) -> DataFrame:
    return df.select(F.col(group).alias(group), *[F.col(c).alias(f"{c}_{mark}") for c in cols])


def unordered(df: DataFrame, group: str, identity: str, target: str, extra: list[str] = (), gap: float = 0.0) -> DataFrame:
    """Pairs i < j of one group whose targets differ (by at least ``gap``), with weight 1 / pairs of the group."""
    cols = [identity, target, *extra]
    p = _side(df, group, cols, "i").join(_side(df, group, cols, "j"), group)
    d = F.abs(F.col(f"{target}_i") - F.col(f"{target}_j"))
    p = p.filter((F.col(f"{identity}_i") < F.col(f"{identity}_j")) & (F.col(f"{target}_i") != F.col(f"{target}_j")) & (d >= gap))
    # The number of a group's pairs is counted without making them.
    counts = pair_counts(df, group, identity, target, target, gap).groupBy(group).agg(F.sum("n").alias("_pairs"))
    return p.withColumn("target_gap", d).join(counts, group).withColumn("weight", 1 / F.col("_pairs")).drop("_pairs")


def mirrored(pairs: DataFrame, identity: str, features: list[str], target: str, group: str) -> DataFrame:
    """Each pair in both directions: feature differences, y (1 if the first target is lower), half the weight."""
    out = []
    for a, b in (("i", "j"), ("j", "i")):
        out.append(
            pairs.select(
                group,
                *[(F.col(f"{f}_{a}") - F.col(f"{f}_{b}")).alias(f) for f in features],
                (F.col(f"{target}_{a}") < F.col(f"{target}_{b}")).cast("int").alias("y"),
                (F.col("weight") / 2).alias("weight"),
                "target_gap",
            )
        )
    return out[0].unionByName(out[1])


def bipartite(df: DataFrame, group: str, identity: str, positive: Column, extra: list[str]) -> DataFrame:
    """Positives times negatives of each group; columns _p and _n."""
    d = df.withColumn("_pos", positive)
    cols = [identity, *extra]
    return _side(d.filter("_pos"), group, cols, "p").join(_side(d.filter(~F.col("_pos")), group, cols, "n"), group)


def _sorted_counts(d: DataFrame, by: list[str]) -> DataFrame:
    """Per group and score ``s``: rows ``vm``, label-1 rows ``vp``, and label-1 rows of lower scores ``below``."""
    run = running_totals(d, "s", {"vp": F.col("y")}, by).withColumnRenamed("n", "vm")
    return run.withColumn("below", F.col("cum_vp") - F.col("vp"))


def rank_by_label(df: DataFrame, group: str, label: str, score: str, reference: str | None = None) -> DataFrame:
    """One row, each number the mean over groups with both labels: commit (share of pairs with two scores that
    differ), accuracy of those (label 1 should score lower), tie rate, top-1 (share of label 1 in the best score's
    ties) and its chance, lift.

    Counts come from running totals over the group's sorted scores; no pair is made,
    and a group of any size is dealt in ranges of its scores.
    """
    d = df.filter(F.col(label).isNotNull()).select(group, F.col(label).cast("long").alias("y"), F.col(score).alias("s"))
    t = d.groupBy(group).agg(F.sum("y").alias("p"), F.count("*").alias("m"), F.sum(F.when(F.col("s").isNotNull(), F.col("y"))).alias("ps"), F.count("s").alias("ms"))
    t = t.filter((F.col("p") > 0) & (F.col("p") < F.col("m")))
    v = _sorted_counts(d, [group]).withColumn("_first", F.col("cum_n") == F.col("vm"))
    c = v.groupBy(group).agg(
        F.sum(F.col("below") * (F.col("vm") - F.col("vp"))).alias("right"),
        F.sum(F.col("vp") * (F.col("vm") - F.col("vp"))).alias("tie"),
        F.max(F.when(F.col("_first"), F.col("vp") / F.col("vm"))).alias("top1"),
    )
    j = t.join(c, group, "left")
    both = F.coalesce(F.col("ps") * (F.col("ms") - F.col("ps")), F.lit(0))
    committed = both - F.coalesce("tie", F.lit(0))
    pairs = F.col("p") * (F.col("m") - F.col("p"))
    per = j.select(
        (committed / pairs).alias("commit"),
        (F.col("right") / F.nullif(committed, F.lit(0))).alias("accuracy"),
        (F.coalesce("tie", F.lit(0)) / F.nullif(both, F.lit(0))).alias("tie"),
        F.col("top1"),
        (F.col("p") / F.col("m")).alias("chance"),
    )
    out = per.agg(F.count("*").alias("groups"), *[F.avg(c).alias(c) for c in ("commit", "accuracy", "tie", "top1", "chance")])
    return out.withColumn("lift", F.col("top1") / F.col("chance"))


SUMS = ("n", "known", "ties", "committed", "right", "concordant")


MOST = 1.7976931348623157e308
PART: int | None = None  # points of a group in a range, where the default is not wanted


def _key(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles, neighbours for neighbours."""
    i = v.view(np.int64)
    return np.where(i >= 0, i, np.iinfo(np.int64).min - i)


def _double(key: np.ndarray) -> np.ndarray:
    return np.where(key >= 0, key, np.iinfo(np.int64).min - key).view(np.float64)


def _under(v: np.ndarray, start: np.ndarray, step: float, fits) -> np.ndarray:
    """The smallest number over the largest w that fits; what fits is all up to some number near ``start`` = v -+ step.

    A difference is rounded to the spacing of v or step, which near 0 spans many
    doubles w, so that the border is found by halving.
    """
    some = np.isfinite(start)
    wide = 4 * np.spacing(np.maximum(np.maximum(np.abs(v), np.abs(start)), abs(step)), where=some, out=np.zeros(len(v)))
    lo, hi = _key(np.where(some, start - wide, 0.0)), _key(np.where(some, start + wide, 0.0))
    while True:
        mid = (lo >> 1) + (hi >> 1) + (lo & hi & 1)
        if not (mid > lo).any():
            break
        ok = fits(v, _double(mid))
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
    return np.where(some, _double(hi), start)


def _limits(levels: list[float], tolerance: float):
    """Per row, level and kind of question, the numbers that a point must lie under, exact for differences as doubles give them.

    Kinds: 0 any row, 1 a row with a score, 2 a lower score, 3 a lower or equal one,
    4 one lower by more than the tolerance, 5 one not higher by more than it.
    """

    def run(batches):
        for batch in batches:
            t, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_s"))
            known = ~np.isnan(s)
            ys = [np.full(len(s), np.inf), np.full(len(s), MOST), s, np.nextafter(s, np.inf)]
            if tolerance > 0:
                ys.append(_under(s, s - tolerance, tolerance, lambda v, w: v - w > tolerance))
                ys.append(_under(s, s + tolerance, tolerance, lambda v, w: w - v <= tolerance))
            for i, c in enumerate(levels):
                x = t if c <= 0 else _under(t, t - c, c, lambda v, w: v - w >= c)  # noqa: B023
                for kind, y in enumerate(ys):
                    some = pa.array(known if kind else np.ones(len(s), bool))
                    rows = batch.filter(some)
                    tag = pa.array(np.full(rows.num_rows, 6 * i + kind), pa.int32())
                    keys = [rows.column(j) for j in range(batch.num_columns - 2)]
                    yield pa.RecordBatch.from_arrays([*keys, tag, pa.array(x).filter(some), pa.array(y).filter(some)], [*batch.schema.names[:-2], "tag", "x", "y"])

    return run


def _counts_by_level(d: DataFrame, by: list[str], levels: list[float], tolerance: float) -> DataFrame:
    """(by, level, counts) of the pairs whose targets differ by the level or more."""
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by)
    points = d.groupBy(*by, F.col("_t").alias("x"), F.coalesce("_s", F.lit(MOST)).alias("y")).agg(F.count("*").alias("n"))
    ship(d.sparkSession)
    asked = d.select(*by, "_t", "_s").mapInArrow(_limits(levels, tolerance), f"{kinds}, tag int, x double, y double")
    found = dominated(points, asked, by, PART).withColumns({"level": F.floor(F.col("tag") / 6).cast("int"), "kind": F.col("tag") % 6})
    wide = found.groupBy(*by, "level").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("m"))), F.lit(0)).alias(f"k{k}") for k in range(6)])
    right, near = (F.col("k4"), F.col("k5")) if tolerance > 0 else (F.col("k2"), F.col("k3"))
    counts = {"n": F.col("k0"), "known": F.col("k1"), "ties": F.col("k3") - F.col("k2"), "committed": right + F.col("k1") - near, "right": right, "concordant": F.col("k2")}
    return wide.select(*by, "level", *[v.alias(k) for k, v in counts.items()])


def pair_counts(df: DataFrame, group: str, identity: str, target: str, score: str, gap: float = 0.0, tolerance: float = 0.0, edges: list[float] = ()) -> DataFrame:
    """(group, stratum, counts) over the pairs of one group with unlike identities whose targets differ by ``gap`` or more.

    ``n`` pairs; ``known`` with both scores, of them ``ties`` and ``concordant`` (lower
    target, lower score); ``committed`` whose scores differ by more than ``tolerance``,
    of them ``right``. The stratum is the number of ``edges`` at or under the target gap.

    Of each row it is counted how many lie under it in target and score (``dominated``),
    which costs n log n in a group of n rows and makes no pair. Rows that share an
    identity are counted as a group of their own and taken off.
    """
    d = df.filter(F.col(group).isNotNull() & F.col(target).isNotNull() & F.col(identity).isNotNull())
    s = F.col(score).cast("double")
    d = d.select(group, F.col(identity).alias("_id"), F.col(target).cast("double").alias("_t"), F.when(~F.isnan(s), s).alias("_s"))
    cuts = sorted(edges)
    # Pairs of a stratum are those of its lower edge without those of the next.
    levels = [max(float(gap), float(e)) for e in [gap, *cuts]]
    all_ = _counts_by_level(d, [group], levels, tolerance)
    again = d.groupBy(group, "_id").agg(F.count("*").alias("_times")).filter("_times > 1").drop("_times")
    own = _counts_by_level(d.join(again, [group, "_id"], "left_semi"), [group, "_id"], levels, tolerance).drop("_id")
    signed = all_.unionByName(own.withColumns({c: -F.col(c) for c in SUMS}))
    steps = signed.withColumn("stratum", F.explode(F.array(F.struct("level", F.lit(1).alias("sign")), F.struct((F.col("level") - 1).alias("level"), F.lit(-1).alias("sign")))))
    steps = steps.filter("stratum.level >= 0").groupBy(group, F.col("stratum.level").alias("stratum")).agg(*[F.sum(F.col("stratum.sign") * F.col(c)).alias(c) for c in SUMS])
    return steps.filter("n > 0")


def _from(c: float):
    """Rows with ``x``: what is under it lies at least c under the row's target, for differences as doubles give them."""

    def run(batches):
        for batch in batches:
            t = batch.column("_t").to_numpy(zero_copy_only=False)
            yield batch.append_column("x", pa.array(_under(t, t - c, c, lambda v, w: v - w >= c)))

    return run


def _gap_sums(d: DataFrame, by: list[str], gap: float) -> DataFrame:
    """(by, n, gap) of the pairs of rows (by, _t) whose targets differ, by ``gap`` or more."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # Sums of targets are exact where they have at most 10 decimals and are not huge, else sums of doubles.
    exact = F.col("_t").try_cast("decimal(20,10)")
    row = {"p": one, "pd": exact, "pf": F.col("_t"), "q": one, "qd": exact, "qf": F.col("_t"), "lost": exact.isNull().cast("long")}
    if gap <= 0:
        both = d.select(*by, F.col("_t").alias("x"), *[v.alias(k) for k, v in row.items()])
    else:
        ship(d.sparkSession)
        kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in by)
        asked = d.select(*by, "_t").mapInArrow(_from(gap), f"{kinds}, _t double, x double")
        empty = lambda names: {k: v if k in names else (none if k in ("p", "q", "lost") else F.lit(0).cast(d.select(v).schema[0].dataType)) for k, v in row.items()}
        points = d.select(*by, F.col("_t").alias("x"), *[v.alias(k) for k, v in empty(("p", "pd", "pf", "lost")).items()])
        both = points.unionByName(asked.select(*by, "x", *[v.alias(k) for k, v in empty(("q", "qd", "qf", "lost")).items()]))
    run = running_totals(both, "x", {k: F.col(k) for k in row}, by)
    below = {k: F.col(f"cum_{k}") - F.col(k) for k in ("p", "pd", "pf")}
    whole, parts = lambda c: c.cast("decimal(11,0)"), lambda c: c.try_cast("decimal(26,10)")
    sums = run.groupBy(*by).agg(
        F.sum(F.col("q") * below["p"]).alias("n"),
        (F.try_sum(parts(F.col("qd")) * whole(below["p"])) - F.try_sum(parts(below["pd"]) * whole(F.col("q")))).cast("double").alias("_exact"),
        F.sum(F.col("qf") * below["p"] - below["pf"] * F.col("q")).alias("_near"),
        F.sum("lost").alias("_lost"),
    )
    return sums.select(*by, "n", F.when(F.col("_lost") == 0, F.coalesce("_exact", "_near")).otherwise(F.col("_near")).alias("gap"))


def pair_totals(df: DataFrame, group: str, identity: str, target: str, gap: float = 0.0) -> DataFrame:
    """(group, n, gap): number and summed target gap of the pairs that ``unordered`` would make, n log n in a group and without a pair.

    Over the sorted targets each row's gaps are its target times the rows under it less
    their sum. Rows that share an identity are summed as a group of their own and taken off.
    """
    d = df.filter(F.col(group).isNotNull() & F.col(target).isNotNull() & F.col(identity).isNotNull())
    d = d.select(group, F.col(identity).alias("_id"), F.col(target).cast("double").alias("_t"))
    again = d.groupBy(group, "_id").agg(F.count("*").alias("_times")).filter("_times > 1").drop("_times")
    own = _gap_sums(d.join(again, [group, "_id"], "left_semi"), [group, "_id"], gap).select(group, (-F.col("n")).alias("n"), (-F.col("gap")).alias("gap"))
    both = _gap_sums(d, [group], gap).unionByName(own)
    return both.groupBy(group).agg(F.sum("n").alias("n"), F.sum("gap").alias("gap")).filter("n > 0")


def bipartite_totals(df: DataFrame, group: str, positive: Column, value: str) -> DataFrame:
    """(group, n, lower): the pairs that ``bipartite`` would make, and in how many the positive has the lower value; no pair is made.

    NULL values are pairs that are not compared; ``lower`` is NULL where none is.
    """
    d = df.select(group, positive.cast("long").alias("y"), F.col(value).cast("double").alias("s")).filter(F.col(group).isNotNull() & F.col("y").isNotNull())
    known = F.col("s").isNotNull()
    of = lambda *cs: F.count(F.when(reduce(and_, cs), 1))
    t = d.groupBy(group).agg(of(F.col("y") == 1).alias("p"), of(F.col("y") == 0).alias("m"), of(F.col("y") == 1, known).alias("ps"), of(F.col("y") == 0, known).alias("ms"))
    v = _sorted_counts(d, [group]).groupBy(group).agg(F.sum(F.col("below") * (F.col("vm") - F.col("vp"))).alias("lower"))
    j = t.filter((F.col("p") > 0) & (F.col("m") > 0)).join(v, group, "left")
    return j.select(group, (F.col("p") * F.col("m")).alias("n"), F.when((F.col("ps") > 0) & (F.col("ms") > 0), F.col("lower")).alias("lower"))


def rank_by_target(df: DataFrame, group: str, identity: str, target: str, score: str, gap: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """One row over pairs of differing targets, each number group-equal: commit and accuracy (lower target, lower score)."""
    p = pair_counts(df, group, identity, target, score, gap, tolerance)
    return p.agg(F.count("*").alias("groups"), F.avg(F.col("committed") / F.col("n")).alias("commit"), F.avg(F.col("right") / F.nullif("committed", F.lit(0))).alias("accuracy"))


def pooled_win_rate(df: DataFrame, group: str, identity: str, target: str, score: str) -> DataFrame:
    """One row over all pairs alike: ties count one half."""
    p = pair_counts(df, group, identity, target, score).agg(*[F.sum(c).alias(c) for c in SUMS])
    win = (F.col("concordant") + F.col("ties") / 2) / F.nullif("known", F.lit(0))
    return p.select(F.coalesce("n", F.lit(0)).alias("pairs"), win.alias("win_rate"))


def gap_strata(df: DataFrame, group: str, identity: str, target: str, score: str, edges: list[float]) -> DataFrame:
    """Accuracy and count of pairs by the size of their target gap, bins [edge, next)."""
    p = pair_counts(df, group, identity, target, score, edges=edges).groupBy((F.col("stratum") - 1).alias("stratum"))
    p = p.agg(F.sum("n").alias("pairs"), F.sum("concordant").alias("_right"), F.sum("known").alias("_known"))
    return p.select("stratum", "pairs", (F.col("_right") / F.nullif("_known", F.lit(0))).alias("accuracy"))


def concentration(df: DataFrame, group: str) -> DataFrame:
    """One row: groups, pairs, and the share of pairs in the largest and the five largest groups; no pair is made."""
    g = df.groupBy(group).agg(F.count("*").alias("m")).withColumn("pairs", (F.col("m") * (F.col("m") - 1) / 2).cast("long"))
    top = g.orderBy(F.desc("pairs"), group).limit(5)
    t = g.agg(F.count("*").alias("groups"), F.sum("pairs").alias("pairs"))
    s = top.agg(F.max("pairs").alias("_one"), F.sum("pairs").alias("_five"))
    return t.join(F.broadcast(s)).select("groups", "pairs", (F.col("_one") / F.col("pairs")).alias("top1_share"), (F.col("_five") / F.col("pairs")).alias("top5_share"))


def feature_audit(df: DataFrame, group: str, label: str, features: list[str]) -> DataFrame:
    """(feature, orientation, accuracy): each feature as a score in both directions, best first.

    Features are stacked, so this is one job whatever their number.
    """
    long = df.select(group, label, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("s")) for f in features])).alias("x"))
    long = long.select(F.col(group).alias("g"), "x.feature", F.col(label).cast("long").alias("y"), "x.s").filter("s is not null")
    c = _sorted_counts(long, ["feature", "g"]).groupBy("feature", "g").agg(
        F.sum(F.col("below") * (F.col("vm") - F.col("vp"))).alias("right"),
        F.sum(F.col("vp") * (F.col("vm") - F.col("vp"))).alias("tie"),
        (F.sum("vp") * (F.sum("vm") - F.sum("vp"))).alias("pairs"),
    )
    per = c.withColumn("a", F.col("right") / F.nullif(F.col("pairs") - F.col("tie"), F.lit(0)))
    f = per.groupBy("feature").agg(F.avg("a").alias("a"))
    both = f.select("feature", F.explode(F.array(F.struct(F.lit("low").alias("orientation"), F.col("a").alias("accuracy")), F.struct(F.lit("high").alias("orientation"), (1 - F.col("a")).alias("accuracy")))).alias("r"))
    return both.select("feature", "r.orientation", "r.accuracy").orderBy(F.desc_nulls_last("accuracy"), "feature", "orientation")
