"""Rule evaluation, verdicts and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.missing import clean
from tessella.functions.numeric import wilson
from tessella.functions.rules import Rule, compile_rule, compile_rules, failed_mechanisms, failed_names, set_verdict, verdict
from tessella.operators import metrics
from tessella.plans.registry import register, table

TAX = Rule("tax_cap", "l_tax", "le", 0.06, mechanism="levy")
DISCOUNT = Rule("discount_guarded", "l_discount", "le", 0.05, guard_feature="l_quantity", guard_op="gt", guard_threshold=25.0, mechanism="price")
PRICE = Rule("price_band", "l_extendedprice", "band", 2000.0, 60000.0, mechanism="price")
QUANTITY = Rule("quantity_floor", "l_quantity", "ge", 3.0, mechanism="volume")
SETS = {"set1": [TAX], "set2": [TAX, DISCOUNT], "set3": [TAX, DISCOUNT, PRICE, QUANTITY]}

OK2 = "(l_tax <= 0.06 AND (NOT l_quantity > 25 OR l_discount <= 0.05))"
T, D, P, Q = (
    "l_tax <= 0.06",
    "(NOT l_quantity > 25 OR l_discount <= 0.05)",
    "(l_extendedprice >= 2000 AND l_extendedprice <= 60000)",
    "l_quantity >= 3",
)


@register(
    "satisfaction_detection",
    f"""SELECT CASE WHEN l_returnflag = 'N' THEN 'reference' ELSE l_returnflag END AS kind, count(*) AS n,
    round(avg(CAST({OK2} AS INT)), 6) AS satisfied, round(1 - avg(CAST({OK2} AS INT)), 6) AS rejected FROM lineitem GROUP BY 1""",
)
def satisfaction_detection(spark, sf):
    got = metrics.satisfaction_detection(table(spark, sf, "lineitem"), compile_rules(SETS["set2"]), F.col("l_returnflag") == "N", "l_returnflag")
    return got.withColumns({c: F.round(c, 6) for c in ("satisfied", "rejected")})


@register(
    "law_masks_fail_open",
    f"""WITH d AS (SELECT *, nullif(l_quantity, 1.0) AS q, nullif(l_tax, 0.0) AS t FROM lineitem)
    SELECT l_returnflag, sum(CAST(coalesce(t <= 0.06, true) AS INT))::BIGINT AS tax_ok,
      sum(CAST(coalesce(NOT q > 25, true) OR coalesce(l_discount <= 0.05, true) AS INT))::BIGINT AS discount_ok,
      sum(CAST(coalesce(t <= 0.06, true) AND (coalesce(NOT q > 25, true) OR coalesce(l_discount <= 0.05, true)) AS INT))::BIGINT AS both_ok
    FROM d GROUP BY 1""",
)
def law_masks_fail_open(spark, sf):
    d = _with_gaps(table(spark, sf, "lineitem"))
    n = lambda c: F.sum(c.cast("long"))
    return d.groupBy("l_returnflag").agg(
        n(compile_rule(TAX)).alias("tax_ok"), n(compile_rule(DISCOUNT)).alias("discount_ok"), n(compile_rules([TAX, DISCOUNT])).alias("both_ok")
    )


def _with_gaps(d):
    """Missing values where the quantity is 1 and the tax 0."""
    return d.withColumns({"l_quantity": F.nullif(clean("l_quantity"), F.lit(1.0)), "l_tax": F.nullif(clean("l_tax"), F.lit(0.0))})


@register(
    "law_verdict_3vl",
    """WITH d AS (SELECT *, nullif(l_quantity, 1.0) AS q, nullif(l_tax, 0.0) AS t FROM lineitem), v AS (SELECT
      CASE WHEN t IS NULL THEN 'no verdict' WHEN t <= 0.06 THEN 'pass' ELSE 'fail' END AS tax,
      CASE WHEN q IS NULL THEN 'no verdict' WHEN NOT q > 25 THEN 'not triggered' WHEN l_discount <= 0.05 THEN 'pass' ELSE 'fail' END AS discount FROM d)
    SELECT tax, discount, CASE WHEN tax = 'fail' OR discount = 'fail' THEN 'implausible' WHEN tax = 'no verdict' OR discount = 'no verdict' THEN 'no verdict' ELSE 'plausible' END AS set_verdict,
      count(*) AS n FROM v GROUP BY 1, 2, 3""",
)
def law_verdict_3vl(spark, sf):
    d = _with_gaps(table(spark, sf, "lineitem"))
    return d.groupBy(verdict(TAX).alias("tax"), verdict(DISCOUNT).alias("discount"), set_verdict([TAX, DISCOUNT]).alias("set_verdict")).agg(F.count("*").alias("n"))


@register(
    "law_nan_violates",
    "SELECT l_returnflag, sum(CAST(coalesce(nullif(l_tax, 0.0) <= 0.06, false) AS INT))::BIGINT AS ok FROM lineitem GROUP BY 1",
)
def law_nan_violates(spark, sf):
    return _with_gaps(table(spark, sf, "lineitem")).groupBy("l_returnflag").agg(F.sum(compile_rule(TAX, "nan_violates").cast("long")).alias("ok"))


@register(
    "set_verdict_lists",
    f"""WITH v AS (SELECT list_filter([CASE WHEN NOT {D} THEN 'discount_guarded' END, CASE WHEN NOT {P} THEN 'price_band' END, CASE WHEN NOT {Q} THEN 'quantity_floor' END, CASE WHEN NOT {T} THEN 'tax_cap' END], lambda x: x IS NOT NULL) AS f,
      list_sort(list_distinct(list_filter([CASE WHEN NOT {D} THEN 'price' END, CASE WHEN NOT {P} THEN 'price' END, CASE WHEN NOT {Q} THEN 'volume' END, CASE WHEN NOT {T} THEN 'levy' END], lambda x: x IS NOT NULL))) AS m,
      CASE WHEN {T} THEN 'plausible' ELSE 'implausible' END AS set1, CASE WHEN {T} AND {D} THEN 'plausible' ELSE 'implausible' END AS set2,
      CASE WHEN {T} AND {D} AND {P} AND {Q} THEN 'plausible' ELSE 'implausible' END AS set3 FROM lineitem)
    SELECT set1, set2, set3, coalesce(array_to_string(f, ','), '') AS failed, coalesce(array_to_string(m, ','), '') AS mechanisms, count(*) AS n FROM v GROUP BY ALL""",
)
def set_verdict_lists(spark, sf):
    rules = SETS["set3"]
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            *[set_verdict(r).alias(k) for k, r in SETS.items()],
            F.array_join(failed_names(rules), ",").alias("failed"),
            F.array_join(failed_mechanisms(rules), ",").alias("mechanisms"),
        )
        .agg(F.count("*").alias("n"))
    )


@register(
    "group_equal_rejection",
    f"""SELECT round(avg(r), 6) AS rate, count(*) AS groups FROM (SELECT l_orderkey, avg(CAST(NOT {OK2} AS INT)) AS r FROM lineitem GROUP BY 1)""",
)
def group_equal_rejection(spark, sf):
    got = metrics.group_equal_rate(table(spark, sf, "lineitem"), ~compile_rules(SETS["set2"]), "l_orderkey")
    return got.withColumn("rate", F.round("rate", 6))


@register(
    "parent_group_rates",
    f"""SELECT round(avg(s), 6) AS rate, count(*) AS groups FROM (SELECT l_suppkey, avg(r) AS s FROM (SELECT l_suppkey, l_orderkey, avg(CAST({OK2} AS INT)) AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1)""",
)
def parent_group_rates(spark, sf):
    got = metrics.group_equal_rate(table(spark, sf, "lineitem"), compile_rules(SETS["set2"]), "l_suppkey", "l_orderkey")
    return got.withColumn("rate", F.round("rate", 6))


@register(
    "law_attribution",
    f"""WITH v AS (SELECT CAST(NOT {T} AS INT) AS a, CAST(NOT {D} AS INT) AS b, CAST(NOT {P} AS INT) AS c FROM lineitem), k AS (SELECT *, a + b + c AS k FROM v)
    SELECT * FROM (
      SELECT 'tax_cap' AS law, round(avg(a), 6) AS direct, round(avg(CASE WHEN k > 0 THEN a / k::DOUBLE ELSE 0 END), 6) AS allocated, round(avg(CAST(a = 1 AND k = 1 AS INT)), 6) AS "unique", round(avg(CAST(a = 1 AND k = 1 AS INT)), 6) AS leave_one_out FROM k
      UNION ALL SELECT 'discount_guarded', round(avg(b), 6), round(avg(CASE WHEN k > 0 THEN b / k::DOUBLE ELSE 0 END), 6), round(avg(CAST(b = 1 AND k = 1 AS INT)), 6), round(avg(CAST(b = 1 AND k = 1 AS INT)), 6) FROM k
      UNION ALL SELECT 'price_band', round(avg(c), 6), round(avg(CASE WHEN k > 0 THEN c / k::DOUBLE ELSE 0 END), 6), round(avg(CAST(c = 1 AND k = 1 AS INT)), 6), round(avg(CAST(c = 1 AND k = 1 AS INT)), 6) FROM k)""",
)
def law_attribution(spark, sf):
    got = metrics.attribution(table(spark, sf, "lineitem"), {r.name: compile_rule(r) for r in (TAX, DISCOUNT, PRICE)})
    return got.withColumns({c: F.round(c, 6) for c in ("direct", "allocated", "unique", "leave_one_out")})


@register(
    "cell_grid",
    f"""SELECT l_returnflag, l_linenumber, count(*) AS n, round(avg(CAST({OK2} AS INT)), 6) AS rate FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linenumber))""",
)
def cell_grid(spark, sf):
    got = metrics.cell_grid(table(spark, sf, "lineitem"), compile_rules(SETS["set2"]), "l_returnflag", "l_linenumber")
    return got.withColumn("rate", F.round("rate", 6))


@register(
    "worst_class_score",
    f"""SELECT round(sum(r) / sum(n) + 0.5 * min(r / n), 6) AS score FROM (SELECT l_shipmode_, sum(CAST(NOT {OK2} AS DOUBLE)) AS r, count(*) AS n FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY 1)""",
)
def worst_class_score(spark, sf):
    got = metrics.worst_class_score(table(spark, sf, "lineitem"), compile_rules(SETS["set2"]), "l_linenumber")
    return got.withColumn("score", F.round("score", 6))


@register(
    "feature_coverage",
    """SELECT * FROM (SELECT 'l_quantity' AS feature, round(avg(CAST(nullif(l_quantity, 1.0) IS NOT NULL AS INT)), 6) AS coverage FROM lineitem
    UNION ALL SELECT 'l_tax', round(avg(CAST(nullif(l_tax, 0.0) IS NOT NULL AS INT)), 6) FROM lineitem UNION ALL SELECT 'l_discount', 1.0 FROM lineitem GROUP BY 1)""",
)
def feature_coverage(spark, sf):
    return metrics.coverage(_with_gaps(table(spark, sf, "lineitem")), ["l_quantity", "l_tax", "l_discount"]).withColumn("coverage", F.round("coverage", 6))


@register("crosstab_confusion", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab_confusion(spark, sf):
    return metrics.confusion(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@register(
    "pivot_spread",
    """SELECT l_linenumber, round(A, 6) AS A, round(N, 6) AS N, round(R, 6) AS R, round(greatest(A, N, R) - least(A, N, R), 6) AS spread FROM (
    SELECT l_linenumber, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS A, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS N, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS R FROM lineitem GROUP BY 1)""",
)
def pivot_spread(spark, sf):
    got = metrics.pivot_spread(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"], F.avg("l_quantity"))
    return got.withColumns({c: F.round(c, 6) for c in ("A", "N", "R", "spread")})


@register(
    "wilson_by_kind",
    f"""WITH c AS (SELECT l_returnflag, sum(CAST({OK2} AS INT))::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round((k/n + 3.8414588206941245/(2*n) - 1.959963984540054*sqrt(k/n*(1-k/n)/n + 3.8414588206941245/(4*n*n)))/(1+3.8414588206941245/n), 6) AS lower,
      round((k/n + 3.8414588206941245/(2*n) + 1.959963984540054*sqrt(k/n*(1-k/n)/n + 3.8414588206941245/(4*n*n)))/(1+3.8414588206941245/n), 6) AS upper FROM c""",
)
def wilson_by_kind(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum(compile_rules(SETS["set2"]).cast("long")).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson("k", "n")
    return c.select("l_returnflag", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


@register(
    "design_effect",
    """WITH b AS (SELECT l_orderkey, count(*)::DOUBLE AS m, sum(CAST(l_returnflag = 'R' AS INT))::DOUBLE AS s FROM lineitem GROUP BY 1),
    t AS (SELECT sum(m) AS n, sum(m*m) AS mm, sum(s) AS s, count(*)::DOUBLE AS g, sum(s*s/m) AS ssm FROM b),
    u AS (SELECT mm/n AS kish, (ssm - n*(s/n)*(s/n))/(g-1) AS msb, (s-ssm)/(n-g) AS msw, (n-mm/n)/(g-1) AS m0 FROM t), v AS (SELECT kish, (msb-msw)/(msb+(m0-1)*msw) AS icc FROM u)
    SELECT round(kish, 6) AS kish_m, round(icc, 6) AS icc, round(1+(kish-1)*greatest(icc, 0), 6) AS deff FROM v""",
)
def design_effect(spark, sf):
    got = metrics.design_effect(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R")
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@register(
    "triage_accounting",
    """WITH d AS (SELECT CASE WHEN o_totalprice > 300000 THEN 'REJECT' WHEN o_totalprice > 200000 THEN 'ABSTAIN' ELSE 'KEEP' END AS x, o_orderstatus = 'F' AS good FROM orders)
    SELECT count(*) FILTER (WHERE x = 'KEEP') AS keep, count(*) FILTER (WHERE x = 'REJECT') AS reject, count(*) FILTER (WHERE x = 'ABSTAIN') AS abstain,
      round(count(*) FILTER (WHERE good AND x <> 'REJECT') / nullif(count(*) FILTER (WHERE good), 0)::DOUBLE, 6) AS recall,
      round(count(*) FILTER (WHERE NOT good AND x = 'REJECT') / nullif(count(*) FILTER (WHERE x = 'REJECT'), 0)::DOUBLE, 6) AS "precision",
      round(count(*) FILTER (WHERE x = 'REJECT') / count(*)::DOUBLE, 6) AS savings FROM d""",
)
def triage_accounting(spark, sf):
    p = F.col("o_totalprice")
    d = table(spark, sf, "orders").withColumn("x", F.when(p > 300000, "REJECT").when(p > 200000, "ABSTAIN").otherwise("KEEP"))
    got = metrics.triage(d, "x", F.col("o_orderstatus") == "F")
    return got.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "savings")})


@register(
    "mdl_cell_cost",
    f"""WITH c AS (SELECT CAST(CAST({T} AS INT) AS VARCHAR) || CAST(CAST({D} AS INT) AS VARCHAR) AS cell, count(*)::DOUBLE AS n, sum(CAST(l_linestatus = 'F' AS INT))::DOUBLE AS k FROM lineitem GROUP BY 1)
    SELECT round(sum(n * CASE WHEN k = 0 OR k = n THEN 0 ELSE -(k/n)*log2(k/n) - (1-k/n)*log2(1-k/n) END) / 2.0 + 16, 4) AS bits, count(*) AS cells FROM c""",
)
def mdl_cell_cost(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("y", (F.col("l_linestatus") == "F").cast("int"))
    return metrics.cell_cost_bits(d, [compile_rule(TAX), compile_rule(DISCOUNT)], "y", deff=2.0).withColumn("bits", F.round("bits", 4))


@register(
    "rule_vote_abstain",
    """WITH v AS (SELECT l_linestatus, CASE WHEN l_quantity > 10 THEN l_discount > 0.03 END AS a, CASE WHEN l_tax > 0.02 THEN l_extendedprice > 30000 END AS b FROM lineitem),
    w AS (SELECT l_linestatus, coalesce(CAST(a AS INT), 0) + coalesce(CAST(b AS INT), 0) AS yes, CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) AS said FROM v)
    SELECT l_linestatus, CASE WHEN said = 0 THEN 'abstain' WHEN yes = said THEN 'positive' WHEN yes = 0 THEN 'negative' ELSE 'conflict' END AS vote, count(*) AS n FROM w GROUP BY 1, 2""",
)
def rule_vote_abstain(spark, sf):
    a = F.when(F.col("l_quantity") > 10, F.col("l_discount") > 0.03)
    b = F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice") > 30000)
    return table(spark, sf, "lineitem").groupBy("l_linestatus", metrics.vote([a, b]).alias("vote")).agg(F.count("*").alias("n"))
