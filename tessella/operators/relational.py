"""Small relational operators: group facts, set checks, paired rows, merges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.joins import ContractError


def any_all(df: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """Per group and flag ``any_`` and ``all_``; a missing flag is neither."""
    aggs = []
    for name, c in flags.items():
        known = F.coalesce(c, F.lit(False))
        aggs += [F.bool_or(known).alias(f"any_{name}"), F.bool_and(known).alias(f"all_{name}")]
    return df.groupBy(group).agg(*aggs)


def constant_within(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, most, constant): the largest number of values of any inner group; constant if that is 1."""
    per = df.groupBy(outer, inner).agg(F.count_distinct(value).alias("k"))
    return per.groupBy(outer).agg(F.max("k").alias("most")).withColumn("constant", F.col("most") == 1)


def sorted_sets(df: DataFrame, group: str, member: str, out: str = "members") -> DataFrame:
    """Per group its distinct members, sorted. Members are deduplicated before they meet."""
    return df.select(group, member).distinct().groupBy(group).agg(F.array_sort(F.collect_list(member)).alias(out))


def group_frame(df: DataFrame, group: str, measure: str) -> DataFrame:
    """``df`` with its group's size, least measure and each row's gap to that.

    Facts are aggregated and joined back, so that a group of any size needs no window;
    AQE splits a skewed join.
    """
    facts = df.groupBy(group).agg(F.count("*").alias("group_size"), F.min(measure).alias("group_least"))
    return df.join(facts, group, "left").withColumn("gap", F.col(measure) - F.col("group_least"))


def conflicts(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """(group, marked): groups in which more than one row has the flag."""
    return df.groupBy(group).agg(F.count_if(flag).alias("marked")).filter("marked > 1")


def partition_check(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """One row: whether the parts are disjoint and together the whole, by distinct keys."""
    tagged = [p.select(key).distinct().withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    per = union.groupBy(key).agg(F.count("*").alias("times"))
    all_ = whole.select(key).distinct().withColumn("there", F.lit(True))
    met = all_.join(per, key, "full")
    return met.agg(
        F.count_if(F.col("times") > 1).alias("overlapping"),
        F.count_if(F.col("times").isNull()).alias("uncovered"),
        F.count_if(F.col("there").isNull()).alias("foreign"),
    ).withColumn("partition", (F.col("overlapping") == 0) & (F.col("uncovered") == 0) & (F.col("foreign") == 0))


def blocked_pairs(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str) -> DataFrame:
    """(block, left, right): pairs across two cohorts, within equal blocks only."""
    a = left.select(*block, F.col(left_id).alias("left"))
    return a.join(right.select(*block, F.col(right_id).alias("right")), block)


def paired_roles(df: DataFrame, identity: str, role: str, measure: str, control: str, treatment: str) -> DataFrame:
    """(identity, control, treatment, difference) of the identities that have exactly one row of each role."""
    at = lambda r: F.max(F.when(F.col(role) == r, F.col(measure)))
    count = lambda r: F.count_if(F.col(role) == r)
    g = df.filter(F.col(role).isin(control, treatment)).groupBy(identity)
    g = g.agg(at(control).alias("control"), at(treatment).alias("treatment"), count(control).alias("_c"), count(treatment).alias("_t"))
    return g.filter("_c = 1 and _t = 1").select(identity, "control", "treatment", (F.col("treatment") - F.col("control")).alias("difference"))


def relative_shift(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: number, mean and largest |treatment - control| / control, over pairs whose control is positive."""
    d = pairs.filter(F.col("control") > 0).withColumn("_s", F.abs(F.col("treatment") - F.col("control")) / F.col("control"))
    return d.groupBy(*by).agg(F.count("_s").alias("n"), F.avg("_s").alias("mean_shift"), F.max("_s").alias("most_shift"))


def first_columns(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A merge in which a column that both sides have comes from the left alone."""
    have = {c.lower() for c in left.columns}
    return left.join(right.select(*on, *[c for c in right.columns if c.lower() not in have]), on, how)


def verified_rows(df: DataFrame, expected: DataFrame, on: list[str], measures: list[str], tolerance: float) -> DataFrame:
    """The table itself; an error if a published row is not met within the tolerance."""
    named = expected.select(*on, *[F.col(m).alias(f"_want_{m}") for m in measures])
    met = named.join(df.select(*on, *measures), on, "left")
    bad = F.lit(False)
    for m in measures:
        bad = bad | F.coalesce(F.abs(F.col(m) - F.col(f"_want_{m}")) > tolerance, F.lit(True))
    gone = met.filter(bad).limit(1).collect()
    if gone:
        raise ContractError(f"a published row is not met: {gone[0].asDict()}")
    return df


def weighted_moments(df: DataFrame, features: list[str], weight: str) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance) under weights from one aggregate; rows with a missing value are left out."""
    d = df.dropna(subset=[*features, weight])
    w, pairs = F.col(weight), [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    # Sums about a first mean lose no digits to large offsets.
    m = d.agg(F.sum(w).alias("w"), *[F.sum(w * F.col(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    if not m["w"]:
        return np.full(len(features), np.nan), np.full((len(features),) * 2, np.nan)
    mean = np.array([m[f"m{i}"] for i in range(len(features))]) / m["w"]
    c = [F.col(f) - float(x) for f, x in zip(features, mean)]
    r = d.agg(*[F.sum(w * c[i] * c[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(features),) * 2)
    for i, j in pairs:
        out[i, j] = out[j, i] = r[f"c{i}_{j}"] / m["w"]
    return mean, out


def collinearity(df: DataFrame, features: list[str], weight: str) -> DataFrame:
    """(feature, vif, condition): variance inflation of each feature and the condition number of the correlations.

    A constant feature or an exact linear relation has an infinite one, as NULL.
    """
    _, cov = weighted_moments(df, features, weight)
    sd = np.sqrt(np.diag(cov))
    if not (sd > 0).all():
        rows = [(f, None, None) for f in features]
    else:
        corr = cov / np.outer(sd, sd)
        eigen = np.linalg.eigvalsh(corr)
        flat = eigen[0] <= 1e-12
        vif = [None] * len(features) if flat else np.diag(np.linalg.inv(corr)).tolist()
        rows = [(f, v, None if flat else float(np.sqrt(eigen[-1] / eigen[0]))) for f, v in zip(features, vif)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, condition double")
