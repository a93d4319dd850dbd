"""Cohort cubes, abstaining evaluation, provenance closure and combined leak verdicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import ordering
from tessella.operators.running import running_totals
from tessella.sources.scratch import ship, written


def cohort_cube(df: DataFrame, cohorts: dict[str, Column], sets: dict[str, Column], group: str) -> DataFrame:
    """(cohort, law_set, n, micro, group_equal): every cohort and set from one scan; a row may be in several cohorts."""
    c = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in cohorts.items()]), lambda x: x.isNotNull())
    s = F.array(*[F.struct(F.lit(k).alias("law_set"), x.cast("double").alias("ok")) for k, x in sets.items()])
    flat = df.select(group, s.alias("_s"), F.explode(c).alias("cohort")).select(group, "cohort", F.explode("_s").alias("_x"))
    per = flat.groupBy("cohort", F.col("_x.law_set").alias("law_set"), group).agg(F.count("*").alias("n"), F.sum("_x.ok").alias("k"))
    return per.groupBy("cohort", "law_set").agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("micro"), F.avg(F.col("k") / F.col("n")).alias("group_equal"))


def abstaining(df: DataFrame, score: str, correct: Column, group: str, thresholds: list[float]) -> DataFrame:
    """(threshold, coverage, accuracy), group-equal: rows of |score| under a threshold abstain."""
    t = F.array(*[F.lit(float(x)) for x in thresholds])
    d = df.select(group, F.abs(score).alias("_s"), correct.cast("double").alias("_ok"), F.explode(t).alias("threshold"))
    said = F.coalesce(F.col("_s") >= F.col("threshold"), F.lit(False))
    per = d.groupBy("threshold", group).agg(F.avg(said.cast("double")).alias("c"), F.avg(F.when(said, F.col("_ok"))).alias("a"))
    return per.groupBy("threshold").agg(F.avg("c").alias("coverage"), F.avg("a").alias("accuracy"))


def grown_tree(n: np.ndarray, p: np.ndarray, leaf: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of the leaves of a tree grown on sorted cells with ``n`` rows, ``p`` of label 1.

    A node is split where the children's Gini impurity is least (the first such place),
    each with at least ``leaf`` rows, until it is pure or no place is left.
    """
    rows, ones = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(p))
    out, open_ = [], [(0, len(n))]
    while open_:
        a, b = open_.pop()
        left, right = rows[a + 1 : b] - rows[a], rows[b] - rows[a + 1 : b]
        ok = (left >= leaf) & (right >= leaf)
        one = ones[b] - ones[a]
        if not ok.any() or one == 0 or one == rows[b] - rows[a]:
            out.append((a, b))
            continue
        x, y = ones[a + 1 : b] - ones[a], ones[b] - ones[a + 1 : b]
        pure = np.where(ok, (x * x + (left - x) ** 2) / np.maximum(left, 1) + (y * y + (right - y) ** 2) / np.maximum(right, 1), -1.0)
        at = a + 1 + int(np.argmax(np.round(pure, 9)))
        open_ += [(at, b), (a, at)]
    return out


def _tree_right(leaf: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("low").combine_chunks()
        n, p, tn, tp, low, high = (table.column(c).to_numpy() for c in ("n", "p", "tn", "tp", "low", "high"))
        own = np.flatnonzero(n > 0)
        # A cut lies halfway between neighbouring training values; held-out values between them go to its sides.
        cuts = (high[own[:-1]] + low[own[1:]]) / 2 if len(own) else np.zeros(0)
        to = np.searchsorted(cuts, low, "left") if len(own) else np.zeros(len(n), np.int64)
        right = 0
        for a, b in grown_tree(n[own], p[own], leaf) if len(own) else []:
            one = 2 * p[own[a:b]].sum() > n[own[a:b]].sum()
            mine = (to >= a) & (to < b)
            right += int(tp[mine].sum() if one else (tn[mine] - tp[mine]).sum())
        sums = [pa.array([int(x.sum())], pa.int64()) for x in (n, p, tn, tp)]
        return pa.table([table.column("feature").slice(0, 1), table.column("fold").slice(0, 1), pa.array([right], pa.int64()), *sums], ["feature", "fold", "right", "n", "p", "tn", "tp"])

    return run


def single_feature_ceiling(df: DataFrame, features: list[str], label: str, fold: Column, folds: int, leaf: int = 5, cells: int = 4096) -> DataFrame:
    """(feature, accuracy, majority): what one feature alone predicts on held-out folds, by a tree as deep as it grows.

    For each fold a tree is grown on the others' rows (``grown_tree``, leaves of at
    least ``leaf`` rows, a tie of labels is 0). ``fold`` must keep rows of one group
    together. Missing values sort lowest. A feature of at most ``cells`` values is
    split between any two of them; one of more is cut into as many cells of equal
    numbers of rows first, so that a tree sees at most ``cells`` sums, whatever the
    table (finer structure of single values is ``leak_level_a``'s matter, which is exact).
    Values are counted once with a column a fold; accuracies are means over folds.
    """
    ship(df.sparkSession)
    low = F.lit(-1e18)
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), low).alias("v")) for f in features]))
    long = df.select(F.col(label).cast("long").alias("y"), fold.cast("int").alias("fold"), stacked.alias("x")).select("y", "fold", "x.feature", "x.v")
    sums = {}
    for k in range(folds):
        held = F.col("fold") == k
        sums |= {f"n{k}": held.cast("long"), f"p{k}": F.when(held, F.col("y")).otherwise(0)}
    run = running_totals(long, "v", {**sums, "p": F.col("y")}, ["feature"])
    size = run.groupBy("feature").agg(F.count("*").alias("_values"), F.max("cum_n").alias("_all"))
    place = F.floor((F.col("cum_n") - F.col("n")) * cells / F.col("_all")).cast("double")
    run = run.join(F.broadcast(size), "feature").withColumn("_cell", F.when(F.col("_values") <= cells, F.col("v")).otherwise(place))
    parts = ["n", "p", *[f"{c}{k}" for k in range(folds) for c in "np"]]
    at = run.groupBy("feature", "_cell").agg(F.min("v").alias("low"), F.max("v").alias("high"), *[F.sum(c).alias(c) for c in parts])
    views = F.array(
        *[
            F.struct(F.lit(k).alias("fold"), (F.col("n") - F.col(f"n{k}")).alias("n"), (F.col("p") - F.col(f"p{k}")).alias("p"), F.col(f"n{k}").alias("tn"), F.col(f"p{k}").alias("tp"))
            for k in range(folds)
        ]
    )
    each = at.select("feature", "low", "high", F.explode(views).alias("x")).select("feature", "x.fold", "low", "high", "x.n", "x.p", "x.tn", "x.tp")
    per = each.groupBy("feature", "fold").applyInArrow(_tree_right(leaf), "feature string, fold int, right long, n long, p long, tn long, tp long")
    base = F.when(F.col("p") * 2 >= F.col("n"), F.col("tp")).otherwise(F.col("tn") - F.col("tp"))
    share = lambda c: F.avg(c / F.nullif(F.col("tn"), F.lit(0)))
    return per.groupBy("feature").agg(share(F.col("right")).alias("accuracy"), share(base).alias("majority"))


def leak_audit(
    df: DataFrame,
    features: list[str],
    label: str,
    identity: str,
    fold: Column,
    folds: int,
    sources: dict[str, set],
    forbidden: set,
    controls: int = 4,
    block: float = 0.98,
    review: float = 0.95,
) -> DataFrame:
    """(feature, control, statistical, ceiling, verdict): every feature's verdict, and those of negative controls.

    Controls are numbers that hang on nothing but the identity (``control_0`` ...);
    with any of them not at PASS the audit itself is at fault. The ceiling blocks from
    ``block`` on and asks for review from ``review`` on.
    """
    made = [f"control_{i}" for i in range(controls)]
    rows = df.select(label, identity, *features, fold.alias("_fold"))
    # Few enough values that no value and no tail is pure by chance alone.
    rows = rows.withColumns({c: F.pmod(F.xxhash64(identity, F.lit(i)), F.lit(20)).cast("double") for i, c in enumerate(made)})
    rows = written(rows, "leak-audit")
    spark = df.sparkSession
    a = None
    for f in [*features, *made]:
        one = ordering.leak_level_a(rows, f, label).select(F.lit(f).alias("feature"), F.col("verdict").alias("statistical"))
        a = one if a is None else a.unionByName(one)
    b = single_feature_ceiling(rows, [*features, *made], label, F.col("_fold"), folds).select("feature", F.col("accuracy").alias("ceiling"))
    # The declared sources decide alone where they do: one row a feature, on the driver.
    own = {f: sources.get(f, set()) for f in features} | {c: {"identity hash"} for c in made}
    declared = [(f, f in made, bool(s & forbidden), not s or any(x.startswith(("unknown:", "cycle:")) for x in s)) for f, s in own.items()]
    declared = spark.createDataFrame(declared, "feature string, control boolean, banned boolean, undeclared boolean")
    worst = F.when((F.col("statistical") == "BLOCK") | F.col("banned") | (F.col("ceiling") >= block), "BLOCK")
    worst = worst.when((F.col("ceiling") >= review) | F.col("undeclared"), "REVIEW").otherwise("PASS")
    met = F.broadcast(declared).join(a, "feature").join(b, "feature")
    return met.select("feature", "control", "statistical", "ceiling", worst.alias("verdict"))


def accepted(verdicts: DataFrame, known_leaks: list[str]) -> DataFrame:
    """One row: whether every known leak is blocked, and how many controls are not at PASS (there must be none)."""
    caught = F.count_if(F.col("feature").isin(known_leaks) & (F.col("verdict") == "BLOCK")) == len(known_leaks)
    return verdicts.agg(caught.alias("all_caught"), F.count_if(F.col("control") & (F.col("verdict") != "PASS")).alias("controls_failed"))


def provenance(declared: dict[str, dict]) -> dict[str, set]:
    """Each feature's sources through everything it derives from (``sources``, ``from``); an unknown parent is its own source."""

    def walk(name: str, seen: frozenset) -> set:
        d = declared.get(name)
        if d is None:
            return {f"unknown:{name}"}
        if name in seen:
            return {f"cycle:{name}"}
        out = set(d.get("sources", []))
        for parent in d.get("from", []):
            out |= walk(parent, seen | {name})
        return out

    return {name: walk(name, frozenset()) for name in declared}


def leak_verdict(statistical: str, ceiling: float, ceiling_bound: float, sources: set, forbidden: set) -> str:
    """BLOCK before REVIEW before PASS; undeclared provenance is never a PASS."""
    if statistical == "BLOCK" or sources & forbidden:
        return "BLOCK"
    if ceiling >= ceiling_bound or not sources or any(s.startswith(("unknown:", "cycle:")) for s in sources):
        return "REVIEW"
    return "PASS"
