"""Score algebra, resampling and streams over stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numeric
from tessella.functions.rules import Rule
from tessella.operators import quantiles, resampling
from tessella.plans.registry import register, table
from tessella.sources import tables
from tessella.streaming import verdicts


@register(
    "score_terms",
    """WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT l_returnflag, round(sum(ln(1 + l_quantity)), 3) AS log1p, round(sum(asinh(l_discount * 10)), 3) AS asinh, round(sum((l_quantity - q[2]) / (q[3] - q[1])), 3) AS robust_z,
      round(sum(greatest(l_quantity - 30.0, 0.0)), 3) AS hinge, round(sum(least(greatest((l_tax - 0.02) / (0.06 - 0.02), 0), 1)), 3) AS clipped,
      round(sum(CASE WHEN abs(l_discount) >= 1e-9 THEN l_tax / l_discount END), 3) AS ratio FROM lineitem, q GROUP BY 1""",
)
def score_terms(spark, sf):
    d = quantiles.robust_z(table(spark, sf, "lineitem"), "l_quantity", "z")
    s = lambda c, n: F.round(F.sum(c), 3).alias(n)
    return d.groupBy("l_returnflag").agg(
        s(F.log1p("l_quantity"), "log1p"),
        s(F.asinh(F.col("l_discount") * 10), "asinh"),
        s(F.col("z"), "robust_z"),
        s(numeric.hinge("l_quantity", 30.0), "hinge"),
        s(numeric.clip_scaled("l_tax", 0.02, 0.06), "clipped"),
        s(numeric.guarded_ratio("l_tax", "l_discount"), "ratio"),
    )


@register(
    "joint_transforms",
    """SELECT l_returnflag, round(sum(least(l_tax, l_discount)), 4) AS "min", round(sum(l_tax * l_discount), 4) AS product, round(sum(pow(l_tax * l_discount, 0.5)), 4) AS geometric,
      round(sum(CASE WHEN l_tax > 0 AND l_discount > 0 THEN 2 / (1 / l_tax + 1 / l_discount) END), 4) AS harmonic, round(sum(round_even(l_tax * 16, 0) / 16), 4) AS grid FROM lineitem GROUP BY 1""",
)
def joint_transforms(spark, sf):
    a = [F.round(F.sum(numeric.joint(k, "l_tax", "l_discount")), 4).alias(k) for k in ("min", "product", "geometric", "harmonic")]
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*a, F.round(F.sum(numeric.quantise("l_tax", 16)), 4).alias("grid"))


@register("cluster_bootstrap_ci")
def cluster_bootstrap_ci(spark, sf):
    y = lambda x: (F.col("l_returnflag") == x).cast("double")
    got = resampling.cluster_bootstrap(table(spark, sf, "lineitem"), "l_orderkey", {"returned": (y("R"), F.lit(1.0)), "accepted": (y("A"), F.lit(1.0))}, replicates=100)
    return got.select("metric", *[F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper")])


@register(
    "block_permutation_z",
    """WITH b AS (SELECT l_linenumber, count(*)::DOUBLE AS n, sum(CAST(l_returnflag = 'R' AS INT))::DOUBLE AS k, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS ss, sum(CAST(l_returnflag = 'R' AS INT) * l_quantity) AS o FROM lineitem GROUP BY 1),
    t AS (SELECT sum(o) AS observed, sum(k * s / n) AS expected, sqrt(sum(k * (n - k) / n * (ss - s * s / n) / (n - 1))) AS deviation FROM b)
    SELECT round(observed, 3) AS observed, round(expected, 3) AS expected, round(deviation, 3) AS deviation, round((observed - expected) / deviation, 5) AS z FROM t""",
)
def block_permutation_z(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    got = resampling.block_permutation(d, "l_linenumber", "y", "l_quantity")
    return got.select(*[F.round(c, 3).alias(c) for c in ("observed", "expected", "deviation")], F.round("z", 5).alias("z"))


@register(
    "event_verdicts",
    """WITH v AS (SELECT ts, CASE WHEN value IS NULL THEN 'no verdict' WHEN value <= 50.0 THEN 'plausible' ELSE 'implausible' END AS set_verdict FROM events)
    SELECT time_bucket(INTERVAL '1 day', ts) AS start, set_verdict, count(*) AS n FROM v GROUP BY 1, 2""",
)
def event_verdicts(spark, sf):
    return verdicts.verdict_counts(table(spark, sf, "events"), [Rule("value_cap", "value", "le", 50.0)], "ts", "1 day", "1 hour")


@register(
    "keys_digest",
    "SELECT sha256(string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderkey::VARCHAR)) AS digest, count(*) AS n FROM orders",
)
def keys_digest(spark, sf):
    return tables.keys_digest(table(spark, sf, "orders"), "o_orderkey")
