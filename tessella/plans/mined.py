"""Candidate mining and searches over rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import mining
from tessella.plans.registry import register, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sides(spark, sf):
    d = table(spark, sf, "lineitem").select(*FEATURES, "l_returnflag", "l_linenumber")
    return d.filter("l_returnflag = 'N'"), d.filter("l_returnflag <> 'N'")


def _rounded(df):
    cols = [c for c in ("lower", "upper", "guard_threshold", "satisfaction", "rejection") if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _one_sided_sql() -> str:
    hi = ", ".join(str(1 - a) for a in mining.ALPHAS)
    lo = ", ".join(str(a) for a in mining.ALPHAS)
    parts = []
    for f in FEATURES:
        parts.append(f"SELECT '{f}' AS feature, 'hi' AS side, NULL::DOUBLE AS lower, t AS upper FROM (SELECT DISTINCT unnest(quantile_cont({f}, [{hi}])) AS t FROM real)")
        parts.append(f"SELECT '{f}', 'lo', t, NULL FROM (SELECT DISTINCT unnest(quantile_cont({f}, [{lo}])) AS t FROM real)")
    rates = " ".join(
        f"WHEN feature = '{f}' THEN (SELECT avg(CAST({{ok}} AS INT)) FROM {{side}} WHERE true)".replace("{ok}", f"coalesce({f} >= lower, true) AND coalesce({f} <= upper, true)") for f in FEATURES
    )
    return f"""WITH real AS (SELECT * FROM lineitem WHERE l_returnflag = 'N'), bad AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N'), c AS ({' UNION ALL '.join(parts)}),
    j AS (SELECT feature, side, lower, upper, CASE {rates.replace('{side}', 'real')} END AS s, 1 - CASE {rates.replace('{side}', 'bad')} END AS r FROM c)
    SELECT feature, side, round(lower, 6) AS lower, round(upper, 6) AS upper, round(s, 6) AS satisfaction, round(r, 6) AS rejection FROM j WHERE s >= 0.9 AND r >= 0.01"""


@register("one_sided_candidates", _one_sided_sql())
def one_sided_candidates(spark, sf):
    real, bad = _sides(spark, sf)
    got = mining.judge(real, bad, mining.one_sided(real, FEATURES), 0.9, 0.01)
    return _rounded(mining.catalogue(spark, got)).select("feature", "side", "lower", "upper", "satisfaction", "rejection")


def _band_sql() -> str:
    parts = [
        f"SELECT '{f}' AS feature, quantile_cont({f}, {(1 - c) / 2!r}) AS lower, quantile_cont({f}, {1 - (1 - c) / 2!r}) AS upper FROM real"
        for f in FEATURES
        for c in mining.CENTRES
    ]
    rate = " ".join(f"WHEN feature = '{f}' THEN (SELECT avg(CAST({f} BETWEEN lower AND upper AS INT)) FROM {{side}})" for f in FEATURES)
    return f"""WITH real AS (SELECT * FROM lineitem WHERE l_returnflag = 'N'), bad AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N'), c AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)})),
    j AS (SELECT *, CASE {rate.replace('{side}', 'real')} END AS s, 1 - CASE {rate.replace('{side}', 'bad')} END AS r FROM c)
    SELECT feature, round(lower, 6) AS lower, round(upper, 6) AS upper, round(s, 6) AS satisfaction, round(r, 6) AS rejection FROM j"""


@register("band_candidates", _band_sql())
def band_candidates(spark, sf):
    real, bad = _sides(spark, sf)
    got = mining.judge(real, bad, mining.bands(real, FEATURES))
    return _rounded(mining.catalogue(spark, got)).select("feature", "lower", "upper", "satisfaction", "rejection")


@register(
    "guarded_candidates",
    """WITH real AS (SELECT * FROM lineitem WHERE l_returnflag = 'N'), bad AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N'),
    g AS (SELECT DISTINCT unnest(quantile_cont(l_quantity, [0.25, 0.5, 0.75])) AS t FROM real), c AS (SELECT t, side FROM g, (SELECT unnest(['hi', 'lo']) AS side)),
    a AS (SELECT t, side, (SELECT avg(CAST(CASE WHEN side = 'hi' THEN l_quantity > t ELSE l_quantity <= t END AS INT)) FROM real) AS app FROM c),
    j AS (SELECT t, side, (SELECT avg(CAST(NOT (CASE WHEN side = 'hi' THEN l_quantity > t ELSE l_quantity <= t END) OR l_tax <= 0.07 AS INT)) FROM real) AS s,
      (SELECT avg(CAST(NOT (NOT (CASE WHEN side = 'hi' THEN l_quantity > t ELSE l_quantity <= t END) OR l_tax <= 0.07) AS INT)) FROM bad) AS r FROM a WHERE app > 0.1 AND app < 0.9)
    SELECT side AS guard_side, round(t, 6) AS guard_threshold, round(s, 6) AS satisfaction, round(r, 6) AS rejection FROM j""",
)
def guarded_candidates(spark, sf):
    real, bad = _sides(spark, sf)
    target = [mining.Candidate("l_tax", "hi", upper=0.07)]
    got = mining.judge(real, bad, mining.guarded(real, target, ["l_quantity"]))
    return _rounded(mining.catalogue(spark, got)).select("guard_side", "guard_threshold", "satisfaction", "rejection")


@register(
    "greedy_step_best",
    """WITH real AS (SELECT * FROM lineitem WHERE l_returnflag = 'N'), bad AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N'), q AS (SELECT unnest([0.01, 0.03, 0.05, 0.07]) AS t),
    j AS (SELECT t, (SELECT avg(CAST(l_tax <= t::DOUBLE AS INT)) FROM real) AS s, (SELECT avg(CAST(l_tax > t::DOUBLE AS INT)) FROM bad) AS r FROM q)
    SELECT t::DOUBLE AS upper, round(s, 6) AS satisfaction, round(r, 6) AS exclusion FROM j WHERE s >= 0.6 ORDER BY r DESC LIMIT 1""",
)
def greedy_step_best(spark, sf):
    real, bad = _sides(spark, sf)
    pool = [mining.Candidate("l_tax", "hi", upper=t) for t in (0.01, 0.03, 0.05, 0.07)]
    path = mining.greedy(real, bad, pool, floor=0.6, steps=1)
    rows = [(c.upper, round(s, 6), round(e, 6)) for c, s, e in path]
    return spark.createDataFrame(rows, "upper double, satisfaction double, exclusion double")


@register("greedy_path")
def greedy_path(spark, sf):
    real, bad = _sides(spark, sf)
    pool = mining.one_sided(real, FEATURES, alphas=(0.0, 0.02, 0.05, 0.1))
    path = mining.greedy(real, bad, pool, floor=0.81, least_gain=0.001)
    rows = [(i, c.feature, c.side, c.lower, c.upper, round(s, 6), round(e, 6)) for i, (c, s, e) in enumerate(path)]
    return spark.createDataFrame(rows, "step int, feature string, side string, lower double, upper double, satisfaction double, exclusion double")


@register("beam_frontier")
def beam_frontier(spark, sf):
    real, bad = _sides(spark, sf)
    pool = mining.one_sided(real, FEATURES, alphas=(0.02, 0.05))
    found = mining.pareto_beam(real, bad, pool, "l_returnflag", width=6, depth=2, floor=0.85)
    rows = [("+".join(f"{pool[i].feature}:{pool[i].side}" for i in d["laws"]), round(d["satisfaction"], 6), round(d["rejection"], 6)) for d in found]
    return spark.createDataFrame(rows, "laws string, satisfaction double, rejection double")


@register("leave_one_kind_out")
def leave_one_kind_out(spark, sf):
    real, bad = _sides(spark, sf)
    pool = mining.one_sided(real, FEATURES, alphas=(0.02, 0.05))
    rows = [(d["kind"], d["laws"], d["held_out_rejection"]) for d in mining.leave_one_kind_out(real, bad, "l_returnflag", pool, floor=0.85, steps=2, least_gain=0.0001)]
    return spark.createDataFrame(rows, "kind string, laws int, held_out_rejection double")


@register(
    "majority_body_rules",
    """WITH t AS (SELECT unnest([10.0, 25.0, 40.0])::DOUBLE AS threshold), r AS (SELECT threshold, op, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem, t, (SELECT unnest(['<=', '>']) AS op) WHERE CASE WHEN op = '<=' THEN l_quantity <= threshold ELSE l_quantity > threshold END),
    c AS (SELECT threshold, op, y, count(*) AS m, sum(count(*)) OVER (PARTITION BY threshold, op) AS n, row_number() OVER (PARTITION BY threshold, op ORDER BY count(*) DESC, y) AS k FROM r GROUP BY 1, 2, 3)
    SELECT threshold, op, n::BIGINT AS n, y::BIGINT AS body, m AS hits FROM c WHERE k = 1""",
)
def majority_body_rules(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return mining.majority_body_rules(d, "l_quantity", "y", [10.0, 25.0, 40.0])
