"""Rates, attribution and cluster statistics as two-level aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(ok: Column) -> Column:
    """Share of true; NULL rows are left out."""
    return F.avg(ok.cast("double"))


def group_equal_rate(df: DataFrame, ok: Column, *levels: str) -> DataFrame:
    """One row: the mean of the means, level by level from the innermost (last) to the outermost."""
    keys, value = list(levels), ok.cast("double")
    while keys:
        df = df.groupBy(*keys).agg(F.avg(value).alias("_rate"))
        keys, value = keys[:-1], F.col("_rate")
    return df.agg(F.avg(value).alias("rate"), F.count("*").alias("groups"))


def satisfaction_detection(df: DataFrame, ok: Column, is_reference: Column, kind: str, min_rows: int = 0) -> DataFrame:
    """Satisfaction of the reference rows and rejection of the others by kind."""
    return (
        df.groupBy(F.when(is_reference, "reference").otherwise(F.col(kind)).alias("kind"))
        .agg(F.count("*").alias("n"), rate(ok).alias("satisfied"))
        .filter(F.col("n") >= min_rows)
        .withColumn("rejected", 1 - F.col("satisfied"))
    )


def worst_class_score(df: DataFrame, ok: Column, kind: str, weight: float = 0.5) -> DataFrame:
    """Mean rejection plus ``weight`` times the smallest rejection of a kind."""
    by = df.groupBy(kind).agg(F.sum((~ok).cast("double")).alias("_r"), F.count("*").alias("_n"))
    return by.agg((F.sum("_r") / F.sum("_n") + weight * F.min(F.col("_r") / F.col("_n"))).alias("score"))


def coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """A row per feature with its share of present values, in one pass."""
    wide = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in features])
    return wide.unpivot([], features, "feature", "coverage")


def attribution(df: DataFrame, laws: dict[str, Column]) -> DataFrame:
    """Per law: direct, allocated (1/k of a row failing k laws), unique, and what leaving it out loses.

    The allocated shares add up to the joint rejection. A row is rejected by the
    set when any law fails, so leaving a law out loses the rows it alone rejects.
    """
    fails = {k: (~v).cast("double") for k, v in laws.items()}
    k = reduce(lambda a, b: a + b, fails.values())
    aggs = [F.count("*").alias("_n")]
    for name, f in fails.items():
        aggs += [
            F.avg(f).alias(f"{name}__direct"),
            F.avg(F.when(k > 0, f / k).otherwise(0.0)).alias(f"{name}__allocated"),
            F.avg(((f == 1) & (k == 1)).cast("double")).alias(f"{name}__unique"),
        ]
    wide = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("law"), *[F.col(f"{n}__{x}").alias(x) for x in ("direct", "allocated", "unique")])
            for n in laws
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.law", "r.direct", "r.allocated", "r.unique", F.col("r.unique").alias("leave_one_out"))


def cell_grid(df: DataFrame, value: Column, source: str, fold: str) -> DataFrame:
    """Rates per source and per source and fold in one pass."""
    df = df.withColumn("_v", value.cast("double"))
    return df.groupingSets([[F.col(source)], [F.col(source), F.col(fold)]], F.col(source), F.col(fold)).agg(
        F.count("*").alias("n"), F.avg("_v").alias("rate")
    )


def pivot_spread(df: DataFrame, row: str, column: str, values: list, measure: Column) -> DataFrame:
    """Per row key: measure by column value, its least, mean and spread."""
    wide = df.groupBy(row).pivot(column, values).agg(measure)
    cols = [F.col(f"`{v}`") for v in values]
    return wide.select(row, *cols, (F.greatest(*cols) - F.least(*cols)).alias("spread"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def design_effect(df: DataFrame, cluster: str, hit: Column) -> DataFrame:
    """One row: Kish mean cluster size, intraclass correlation and design effect of a 0/1 column."""
    by = df.groupBy(cluster).agg(F.count("*").cast("double").alias("m"), F.sum(hit.cast("double")).alias("s"))
    t = by.agg(
        F.sum("m").alias("n"),
        F.sum(F.col("m") * F.col("m")).alias("mm"),
        F.sum("s").alias("s"),
        F.count("*").cast("double").alias("g"),
        F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ssm"),
    )
    p = F.col("s") / F.col("n")
    msb = (F.col("ssm") - F.col("n") * p * p) / (F.col("g") - 1)
    msw = (F.col("s") - F.col("ssm")) / (F.col("n") - F.col("g"))
    m0 = (F.col("n") - F.col("mm") / F.col("n")) / (F.col("g") - 1)
    t = t.select((F.col("mm") / F.col("n")).alias("kish_m"), ((msb - msw) / (msb + (m0 - 1) * msw)).alias("icc"))
    return t.withColumn("deff", 1 + (F.col("kish_m") - 1) * F.greatest(F.col("icc"), F.lit(0.0)))


def triage(df: DataFrame, decision: str, good: Column) -> DataFrame:
    """One row: counts of KEEP, REJECT and ABSTAIN, recall of good rows, precision and savings."""
    is_ = lambda x: F.col(decision) == x
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.agg(
        *[count(is_(x)).alias(x.lower()) for x in ("KEEP", "REJECT", "ABSTAIN")],
        (count(good & ~is_("REJECT")) / F.nullif(count(good), F.lit(0))).alias("recall"),
        (count(~good & is_("REJECT")) / F.nullif(count(is_("REJECT")), F.lit(0))).alias("precision"),
        (count(is_("REJECT")) / F.count("*")).alias("savings"),
    )


def cell_cost_bits(df: DataFrame, laws: list[Column], label: str, deff: float = 1.0, bits_per_law: float = 8.0) -> DataFrame:
    """One row: description length of a label given the laws' outcome cell."""
    cell = F.concat_ws("", *[F.coalesce(x.cast("int").cast("string"), F.lit("?")) for x in laws])
    by = df.groupBy(cell.alias("cell")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("k"))
    p = F.col("k") / F.col("n")
    h = lambda p: F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))
    return by.agg((F.sum(F.col("n") * h(p)) / deff + bits_per_law * len(laws)).alias("bits"), F.count("*").alias("cells"))


def vote(members: list[Column]) -> Column:
    """'positive' or 'negative' where all members that speak agree, 'conflict' where not, 'abstain' where none speaks."""
    yes = reduce(lambda a, b: a + b, [F.coalesce(m.cast("int"), F.lit(0)) for m in members])
    said = reduce(lambda a, b: a + b, [m.isNotNull().cast("int") for m in members])
    return F.when(said == 0, "abstain").when(yes == said, "positive").when(yes == 0, "negative").otherwise("conflict")


def poisoned_sum(value: Column) -> Column:
    """A sum that is NULL if any of its values is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
