"""Resampling over group sums: Spark makes the sums, each draw is a column of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def poisson_weight(key: Column, replicate: Column, seed: int) -> Column:
    """A Poisson(1) number from a hash, the same wherever and whenever it is computed."""
    u = F.pmod(F.xxhash64(key, replicate, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    out, p, cdf = F.lit(7), np.exp(-1.0), 0.0
    edges = []
    for k in range(7):
        cdf += p
        edges.append((k, cdf))
        p /= k + 1
    for k, e in reversed(edges):
        out = F.when(u < float(e), k).otherwise(out)
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, metrics: dict[str, tuple[Column, Column]], replicates: int = 250, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(metric, estimate, lower, upper): ratios of sums, whole clusters resampled, all metrics on the same draws.

    Each cluster's sums are made once; a replicate gives it a Poisson(1) weight. The
    table grows by the number of replicates only after it is down to a row a cluster,
    and is summed again before the shuffle.
    """
    sums = [x for k, (a, b) in metrics.items() for x in (F.sum(a).alias(f"{k}__a"), F.sum(b).alias(f"{k}__b"))]
    by = df.groupBy(cluster).agg(*sums)
    whole = by.agg(*[(F.sum(f"{k}__a") / F.sum(f"{k}__b")).alias(k) for k in metrics])
    drawn = by.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("_w", poisson_weight(F.col(cluster), F.col("_r"), seed))
    reps = drawn.filter("_w > 0").groupBy("_r").agg(
        *[(F.sum(F.col(f"{k}__a") * F.col("_w")) / F.sum(F.col(f"{k}__b") * F.col("_w"))).alias(k) for k in metrics]
    )
    lo = (1 - level) / 2
    ci = reps.agg(*[F.percentile(k, [lo, 1 - lo]).alias(f"{k}__ci") for k in metrics])
    rows = F.array(
        *[F.struct(F.lit(k).alias("metric"), F.col(k).alias("estimate"), F.col(f"{k}__ci")[0].alias("lower"), F.col(f"{k}__ci")[1].alias("upper")) for k in metrics]
    )
    return whole.join(F.broadcast(ci)).select(F.explode(rows).alias("r")).select("r.*")


def stratified_bootstrap(df: DataFrame, unit: str, stratum: str, value: Column, replicates: int = 250, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row (estimate, lower, upper): a mean over strata of fixed shares, units resampled within each.

    Units' sums are made once; a replicate weighs them by Poisson(1) and takes each
    stratum's mean under its own weights, so that strata keep their shares in every draw.
    """
    by = df.groupBy(stratum, unit).agg(F.sum(value).alias("_s"), F.count(value).cast("double").alias("_n"))
    strata = by.groupBy(stratum).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).filter("_n > 0")
    strata = strata.join(F.broadcast(strata.agg(F.sum("_n").alias("_all"))))
    strata = strata.select(stratum, (F.col("_n") / F.col("_all")).alias("_share"), (F.col("_s") / F.col("_n")).alias("_mean"))
    whole = strata.agg(F.sum(F.col("_share") * F.col("_mean")).alias("estimate"))
    rounds = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r")
    drawn = by.select("*", rounds).withColumn("_w", poisson_weight(F.col(unit), F.col("_r"), seed)).filter("_w > 0")
    mean = F.sum(F.col("_s") * F.col("_w")) / F.nullif(F.sum(F.col("_n") * F.col("_w")), F.lit(0.0))
    per = drawn.groupBy("_r", stratum).agg(mean.alias("_x"))
    # A stratum that a draw leaves empty keeps its own mean.
    reps = strata.select("*", rounds).join(per, ["_r", stratum], "left").groupBy("_r").agg(F.sum(F.col("_share") * F.coalesce("_x", "_mean")).alias("_v"))
    lo = (1 - level) / 2
    ci = reps.agg(F.percentile("_v", [lo, 1 - lo]).alias("_q"))  # as many values as replicates
    return whole.join(F.broadcast(ci)).select("estimate", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def subsample_stability(df: DataFrame, unit: str, metrics: dict[str, tuple[Column, Column]], fractions: list[float], draws: int = 200, seed: int = 7) -> DataFrame:
    """(metric, fraction, mean, deviation): ratios of sums over units drawn by hash without replacement.

    Each unit's sums are made once; a unit belongs to a draw of a fraction if its hash
    for that draw is under the fraction.
    """
    sums = [x for k, (a, b) in metrics.items() for x in (F.sum(a).alias(f"{k}__a"), F.sum(b).alias(f"{k}__b"))]
    by = df.groupBy(unit).agg(*sums).withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(unit, "_r", F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    by = by.withColumn("_u", u).withColumn("_f", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).filter("_u < _f")
    reps = by.groupBy(F.col("_f").alias("fraction"), "_r").agg(*[(F.sum(f"{k}__a") / F.sum(f"{k}__b")).alias(k) for k in metrics])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in metrics])
    long = reps.select("fraction", F.explode(rows).alias("r"))
    return long.groupBy(F.col("r.metric").alias("metric"), "fraction").agg(F.avg("r.v").alias("mean"), F.stddev_samp("r.v").alias("deviation"))


def block_permutation(df: DataFrame, block: str, label: str, statistic: str) -> DataFrame:
    """One row: observed sum of statistic over label 1, mean and deviation when labels are permuted within blocks, z.

    The permutation distribution of such a sum has a closed mean and variance, so no
    permutation is drawn.
    """
    by = df.groupBy(block).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(F.col(label).cast("double")).alias("k"),
        F.sum(statistic).alias("s"),
        F.sum(F.col(statistic) * F.col(statistic)).alias("ss"),
        F.sum(F.col(label).cast("double") * F.col(statistic)).alias("obs"),
    )
    mean = F.col("k") * F.col("s") / F.col("n")
    spread = F.when(F.col("n") > 1, (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).otherwise(0.0)
    var = F.col("k") * (F.col("n") - F.col("k")) / F.col("n") * spread
    t = by.agg(F.sum("obs").alias("observed"), F.sum(mean).alias("expected"), F.sqrt(F.sum(var)).alias("deviation"))
    return t.withColumn("z", (F.col("observed") - F.col("expected")) / F.nullif(F.col("deviation"), F.lit(0.0)))
