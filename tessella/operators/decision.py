"""Decisions against endpoints: metrics, paired detection, predicate grids, conjunctive rules, scorecards, ledgers, checks."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import wilson
from tessella.operators.mining import Candidate, evaluate
from tessella.operators.quantiles import quantile_lists


def derived_endpoint(ratio: str, shift: str, most_ratio: float, most_shift: float) -> Column:
    """Whether |ln ratio| or |shift| is over its bound; NULL only where neither tells."""
    far = F.abs(F.ln(F.when(F.col(ratio) > 0, F.col(ratio)))) > F.lit(float(most_ratio))
    return far | (F.abs(F.col(shift)) > most_shift)


def first_match(reasons: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(default)
    for name, c in reversed(reasons):
        out = F.when(F.coalesce(c, F.lit(False)), name).otherwise(out)
    return out


def decision_metrics(df: DataFrame, supported: Column, reject: Column, endpoint: str, protected: float = 1.0, severe: float = 2.0, by: list[str] = ()) -> DataFrame:
    """Counts, rates and Wilson lower bounds of rejecting rows; rows between the two bounds never enter precision.

    A row is protected at or under ``protected`` and severe at or over ``severe``; an
    unsupported row is never rejected.
    """
    s = F.coalesce(supported, F.lit(False))
    r = s & F.coalesce(reject, F.lit(False))
    e = F.col(endpoint)
    good, bad = F.coalesce(e <= protected, F.lit(False)), F.coalesce(e >= severe, F.lit(False))
    n = F.count_if
    t = df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        n(s).alias("supported"),
        n(r).alias("rejected"),
        n(good).alias("protected"),
        n(good & ~r).alias("protected_kept"),
        n((good | bad) & r).alias("rejected_extremes"),
        n(bad).alias("severe"),
        n(bad & r).alias("severe_rejected"),
    )
    rates = {
        "coverage": ("supported", "rows"),
        "protected_recall": ("protected_kept", "protected"),
        "precision": ("severe_rejected", "rejected_extremes"),
        "savings": ("rejected", "rows"),
        "severe_recall": ("severe_rejected", "severe"),
    }
    rate = lambda k, m: F.when(F.col(m) > 0, F.col(k) / F.col(m)).otherwise(0.0)
    bounds = {f"{name}_lower": F.coalesce(wilson(k, m)[0], F.lit(0.0)) for name, (k, m) in rates.items() if name != "severe_recall"}
    return t.withColumns({**{name: rate(k, m) for name, (k, m) in rates.items()}, **bounds})


def paired_detection(df: DataFrame, first: Column, second: Column, by: list[str] = ()) -> DataFrame:
    """The 2 x 2 table of two detectors on the same rows, and both rates."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    t = df.groupBy(*by).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))
    n = F.col("both") + F.col("first_only") + F.col("second_only") + F.col("neither")
    return t.withColumns({"first_rate": (F.col("both") + F.col("first_only")) / n, "second_rate": (F.col("both") + F.col("second_only")) / n})


def predicate_grid(df: DataFrame, features: list[str], points: int = 21, guard: str | None = None, guards: tuple = (), least: int = 100) -> list[Candidate]:
    """Every feature at its quantiles, both sides, without a guard and under each guard threshold.

    Features with fewer than ``least`` values or without spread are left out.
    """
    facts = evaluate(df, [x for f in features for x in (F.count(f), F.stddev_pop(f))])
    use = [f for i, f in enumerate(features) if facts[2 * i] >= least and (facts[2 * i + 1] or 0) > 0]
    qs = [i / (points - 1) for i in range(points)]
    found = quantile_lists(df, use, qs) if use else {}
    out = []
    for f, g in product(use, [None, *guards]):
        if g is not None and f == guard:
            continue
        at = (guard, "lo", float(g)) if g is not None else (None, None, None)
        for t in dict.fromkeys(found[f]):
            out += [Candidate(f, "hi", None, t, *at), Candidate(f, "lo", t, None, *at)]
    return out


def conjunctive_rules(df: DataFrame, risks: dict[str, Column], bad: Column, good: Column, cutoffs: dict[str, list[float]], least: float, width: int = 2) -> DataFrame:
    """(rule, rejected_bad, rejected_good, precision_lower, recall): conjunctions of up to ``width`` risks at or over a cut-off.

    All rules are one wide aggregate a batch. Kept are those with a Wilson bound of
    precision at ``least`` or over, best by recall, precision bound and name.
    """
    bad, good = F.coalesce(bad, F.lit(False)), F.coalesce(good, F.lit(False))
    rules = []
    for k in range(1, width + 1):
        for names in combinations(sorted(risks), k):
            for cuts in product(*[sorted(set(cutoffs[n])) for n in names]):
                on = F.lit(True)
                for n, c in zip(names, cuts):
                    on = on & F.coalesce(risks[n] >= c, F.lit(False))
                rules.append((" & ".join(f"{n} >= {c:g}" for n, c in zip(names, cuts)), on))
    counts = evaluate(df, [x for _, on in rules for x in (F.count_if(on & bad), F.count_if(on & good))])
    total = evaluate(df, [F.count_if(bad)])[0]
    rows = [(name, counts[2 * i], counts[2 * i + 1], total) for i, (name, _) in enumerate(rules)]
    t = df.sparkSession.createDataFrame(rows, "rule string, rejected_bad long, rejected_good long, _bad long")
    t = t.withColumn("precision_lower", F.coalesce(wilson("rejected_bad", F.col("rejected_bad") + F.col("rejected_good"))[0], F.lit(0.0)))
    t = t.withColumn("recall", F.col("rejected_bad") / F.nullif(F.col("_bad"), F.lit(0))).filter(F.col("precision_lower") >= least).drop("_bad")
    return t.orderBy(F.round("recall", 9).desc_nulls_last(), F.round("precision_lower", 9).desc(), "rule")


def scorecard(df: DataFrame, on: Column, body: int, labels: list[str], mode: str, family: str, least: tuple[int, int] = (50, 200)) -> DataFrame:
    """One row of a rule's facts: triggered rows, accuracy by labelling, their spread, gain over a mode table, discordant
    counts with the first labelling, families with support, and the worst ratio of held-out to other families."""
    t = df.filter(F.coalesce(on, F.lit(False)))
    right = F.col(labels[0]) == body
    base = F.col(mode) == F.col(labels[0])
    accs = [F.avg((F.col(x) == body).cast("double")).alias(f"accuracy_{x}") for x in labels]
    whole = t.agg(
        F.count("*").alias("triggered"),
        *accs,
        F.avg(base.cast("double")).alias("mode_accuracy"),
        F.count_if(right & ~base).alias("rule_only"),
        F.count_if(~right & base).alias("mode_only"),
    )
    cols = [F.col(f"accuracy_{x}") for x in labels]
    whole = whole.withColumn("spread", F.greatest(*cols) - F.least(*cols) if len(cols) > 1 else F.lit(0.0))
    whole = whole.withColumn("gain", F.col(f"accuracy_{labels[0]}") - F.col("mode_accuracy"))
    per = t.groupBy(family).agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("k"))
    both = per.join(F.broadcast(per.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))))
    ratio = (F.col("k") / F.col("n")) / F.greatest((F.col("_k") - F.col("k")) / F.nullif(F.col("_n") - F.col("n"), F.lit(0)), F.lit(1e-9))
    enough = (F.col("n") >= least[0]) & (F.col("_n") - F.col("n") >= least[1])
    worst = both.agg(F.count_if(F.col("n") >= 20).alias("families"), F.min(F.when(enough, ratio)).alias("worst_transfer"))
    return whole.join(F.broadcast(worst))


def fixed_commitment(metrics: DataFrame, fold: str, target: str, variant: str, baseline: str, measures: list[str]) -> DataFrame:
    """Per variant and target: mean difference to the baseline on the same fold, and the folds in which it is not worse."""
    base = metrics.filter(F.col(variant) == baseline).select(fold, target, *[F.col(m).alias(f"_b_{m}") for m in measures])
    met = metrics.filter(F.col(variant) != baseline).join(base, [fold, target])
    aggs = [a for m in measures for a in (F.avg(F.col(m) - F.col(f"_b_{m}")).alias(f"{m}_gain"), F.count_if(F.col(m) >= F.col(f"_b_{m}")).alias(f"{m}_not_worse"))]
    return met.groupBy(variant, target).agg(F.count("*").alias("folds"), *aggs)


def prediction_ledger(spark, facts: list[tuple[str, str, float | None, bool | None]]) -> DataFrame:
    """(experiment, prediction, value, met): what was predicted and what came of it, in the order given."""
    rows = [(i, e, p, None if v is None else float(v), m) for i, (e, p, v, m) in enumerate(facts)]
    return spark.createDataFrame(rows, "position int, experiment string, prediction string, value double, met boolean")


def table_issues(df: DataFrame, required: list[str], key: str, groups: list[tuple[str, str]] = (), twins: list[tuple[str, str]] = ()) -> DataFrame:
    """(issue, level, n): missing columns, nulls, repeated keys, grids (group, value) that do not rise, twin columns that differ.

    A grid's rows are taken in the order of the key. Nothing but counts leaves the scan.
    """
    spark, out = df.sparkSession, []
    gone = [c for c in required if c not in df.columns]
    parts = [spark.createDataFrame([(f"column {c} is missing", "error", 1) for c in gone], "issue string, level string, n long")]
    there = [c for c in required if c in df.columns]
    if there:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in there])
        out = F.array(*[F.struct(F.lit(f"column {c} has nulls").alias("issue"), F.lit("error").alias("level"), F.col(c).alias("n")) for c in there])
        parts.append(nulls.select(F.explode(out).alias("r")).select("r.*"))
    again = df.groupBy(key).count().filter("count > 1")
    parts.append(again.agg(F.count("*").alias("n")).select(F.lit(f"key {key} repeats").alias("issue"), F.lit("error").alias("level"), "n"))
    for group, value in groups:
        step = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(key, F.col(value).alias("v")))).alias("a"))
        falls = F.exists(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.get("a", i)["v"] <= F.get("a", i - 1)["v"])
        bad = step.filter(F.size("a") > 1).agg(F.count_if(F.coalesce(falls, F.lit(True))).alias("n"))
        parts.append(bad.select(F.lit(f"{value} does not rise within {group}").alias("issue"), F.lit("error").alias("level"), "n"))
    for a, b in twins:
        parts.append(df.agg(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("n")).select(F.lit(f"{a} and {b} differ").alias("issue"), F.lit("warning").alias("level"), "n"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.filter("n > 0")
