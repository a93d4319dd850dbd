"""Joins, order statistics, strata, splits and nested data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numeric, text
from tessella.operators import joins, nested, quantiles, splits
from tessella.plans.registry import register, table
from tessella.sources import tables


@register("quantile_linear", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def quantile_linear(spark, sf):
    got = quantiles.quantile_columns(table(spark, sf, "lineitem"), "l_extendedprice", {"q10": 0.1, "q50": 0.5, "q90": 0.9}, ["l_returnflag"])
    return got.select("l_returnflag", *[F.round(q, 6).alias(q) for q in ("q10", "q50", "q90")])


@register("quantile_disc", "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.1) AS q10, quantile_disc(l_extendedprice, 0.5) AS q50 FROM lineitem GROUP BY 1")
def quantile_disc(spark, sf):
    return quantiles.quantile_columns(table(spark, sf, "lineitem"), "l_extendedprice", {"q10": 0.1, "q50": 0.5}, ["l_returnflag"], "discrete")


@register("quantile_higher", "SELECT v AS value FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders) WHERE r = ceil(0.9 * (n - 1)) + 1")
def quantile_higher(spark, sf):
    return quantiles.higher(table(spark, sf, "orders"), "o_totalprice", 0.9)


@register(
    "quantile_weighted",
    """WITH v AS (SELECT l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1), c AS (SELECT v, (sum(w) OVER (ORDER BY v) - w / 2) / sum(w) OVER () AS p FROM v),
    a AS (SELECT v, p FROM c WHERE p <= 0.3 ORDER BY p DESC LIMIT 1), b AS (SELECT v, p FROM c WHERE p > 0.3 ORDER BY p LIMIT 1)
    SELECT round(a.v + (b.v - a.v) * (0.3 - a.p) / (b.p - a.p), 4) AS value FROM a, b""",
)
def quantile_weighted(spark, sf):
    return quantiles.weighted(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 0.3).withColumn("value", F.round("value", 4))


@register(
    "label_free_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, min({c}) AS least, quantile_disc({c}, 0.1) AS q10, quantile_disc({c}, 0.5) AS median, quantile_disc({c}, 0.9) AS q90, max({c}) AS most FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def label_free_statistics(spark, sf):
    return quantiles.label_free_statistics(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@register(
    "threshold_grid",
    """WITH q AS (SELECT quantile_cont(l_quantity, list_transform(range(10), lambda i: (i + 0.5) / 10)) AS a, quantile_cont(l_discount, list_transform(range(10), lambda i: (i + 0.5) / 10)) AS b FROM lineitem)
    SELECT DISTINCT feature, round(t, 6) AS threshold FROM (SELECT 'l_quantity' AS feature, unnest(a) AS t FROM q UNION ALL SELECT 'l_discount', unnest(b) FROM q)""",
)
def threshold_grid(spark, sf):
    return quantiles.threshold_grid(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], points=10)


@register(
    "lower_inclusive_strata",
    "SELECT CAST(150000.0 < o_totalprice AS INT) + CAST(300000.0 < o_totalprice AS INT) AS stratum, count(*) AS n FROM orders GROUP BY 1",
)
def lower_inclusive_strata(spark, sf):
    return table(spark, sf, "orders").groupBy(numeric.lower_inclusive_stratum("o_totalprice", [150000.0, 300000.0]).alias("stratum")).agg(F.count("*").alias("n"))


@register(
    "qcut_rates",
    """WITH e AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
    SELECT CAST(o_totalprice > q[1] AS INT) + CAST(o_totalprice > q[2] AS INT) + CAST(o_totalprice > q[3] AS INT) + CAST(o_totalprice > q[4] AS INT) AS bin,
      count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS rate FROM orders, e GROUP BY 1""",
)
def qcut_rates(spark, sf):
    d = quantiles.equal_count_bins(table(spark, sf, "orders"), "o_totalprice", 5)
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("rate"))


@register(
    "cut_rates",
    """SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 0 WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN 1 WHEN o_totalprice > 200000 AND o_totalprice <= 1000000 THEN 2 END AS bin,
    count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS rate FROM orders GROUP BY 1""",
)
def cut_rates(spark, sf):
    b = numeric.fixed_bins("o_totalprice", [0.0, 100000.0, 200000.0, 1000000.0]).alias("bin")
    return table(spark, sf, "orders").groupBy(b).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("rate"))


@register(
    "group_rank_pct",
    """WITH r AS (SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0 AS r, count(s_acctbal) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
    SELECT s_suppkey, round(CASE WHEN n > 1 THEN (r - 1) / (n - 1) END, 6) AS pct FROM r""",
)
def group_rank_pct(spark, sf):
    got = quantiles.group_rank_percentile(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal", "pct")
    return got.select("s_suppkey", F.round("pct", 6).alias("pct"))


@register(
    "novelty_cohorts",
    """WITH cut AS (SELECT TIMESTAMP '1996-01-01' AS d), seen AS (SELECT DISTINCT o_custkey FROM orders, cut WHERE o_orderdate < d)
    SELECT s.o_custkey IS NULL AS is_new, count(*) AS n FROM orders o CROSS JOIN cut LEFT JOIN seen s ON o.o_custkey = s.o_custkey WHERE o.o_orderdate >= d GROUP BY 1""",
)
def novelty_cohorts(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1996-01-01").cast(o.schema["o_orderdate"].dataType)
    held = o.filter(F.col("o_orderdate") >= cut)
    return joins.novelty(held, o.filter(F.col("o_orderdate") < cut), "o_custkey", "is_new").groupBy("is_new").agg(F.count("*").alias("n"))


@register("validated_join", "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def validated_join(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    j = joins.validated_left_join(table(spark, sf, "lineitem"), part, ["l_partkey"])
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register(
    "join_completeness",
    """SELECT CASE WHEN c IS NULL THEN 'right_only' WHEN o IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n
    FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c = o GROUP BY 1""",
)
def join_completeness(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return joins.completeness(c, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@register(
    "nearest_key_lookup",
    """WITH t AS (SELECT p_brand, p_size AS k, min(p_retailprice) AS v FROM part WHERE p_size % 7 = 0 GROUP BY 1, 2),
    c AS (SELECT p.p_partkey, t.k, t.v, abs(t.k - p.p_size) AS d, row_number() OVER (PARTITION BY p.p_partkey ORDER BY abs(t.k - p.p_size), t.k) AS r FROM part p LEFT JOIN t ON p.p_brand = t.p_brand)
    SELECT p_partkey, CASE WHEN d IS NULL THEN 'none' WHEN d = 0 THEN 'exact' ELSE 'nearest' END AS how, d AS distance, round(v, 4) AS price FROM c WHERE r = 1""",
)
def nearest_key_lookup(spark, sf):
    p = table(spark, sf, "part")
    t = p.filter(F.col("p_size") % 7 == 0).groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("price"))
    return joins.nearest_key_lookup(p, t, ["p_brand"], "p_size", "price").select("p_partkey", "how", "distance", F.round("price", 4).alias("price"))


@register(
    "mode_table_baseline",
    """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), m AS (SELECT p_brand, p_size AS m FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM c) WHERE r = 1),
    g AS (SELECT p_size AS g FROM (SELECT p_size, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) ORDER BY n DESC, p_size LIMIT 1)
    SELECT count(*) AS n, sum(CAST(p_size = coalesce(m, g) AS INT))::BIGINT AS hits FROM part LEFT JOIN m USING (p_brand) CROSS JOIN g WHERE p_partkey % 2 = 1""",
)
def mode_table_baseline(spark, sf):
    p = table(spark, sf, "part")
    known = p.filter(F.col("p_partkey") % 2 == 0)
    modes = known.groupBy("p_brand").agg(F.mode("p_size", True).alias("guess"))
    overall = known.agg(F.mode("p_size", True)).first()[0]
    j = joins.lookup_with_default(p.filter(F.col("p_partkey") % 2 == 1), modes, ["p_brand"], "guess", F.lit(overall))
    return j.agg(F.count("*").alias("n"), F.sum((F.col("p_size") == F.col("guess")).cast("long")).alias("hits"))


@register(
    "representative_by_hash",
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('salt:' || doc_id), doc_id) AS r FROM documents) WHERE r = 1""",
)
def representative_by_hash(spark, sf):
    return joins.representative(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", "salt")


U = "('0x' || substr(sha256('{s}:' || o_orderkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"


@register("sha_split_counts", f"SELECT CASE WHEN u < 0.6 THEN 'discovery' WHEN u < 0.85 THEN 'calibration' ELSE 'lockbox' END AS split, count(*) AS n FROM (SELECT {U.format(s='s1')} AS u FROM orders) GROUP BY 1")
def sha_split_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(splits.split3("o_orderkey", "s1").alias("split")).agg(F.count("*").alias("n"))


@register("nested_split", f"SELECT CASE WHEN a < 0.2 THEN 'test' WHEN b < 0.25 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM (SELECT {U.format(s='outer')} AS a, {U.format(s='inner')} AS b FROM orders) GROUP BY 1")
def nested_split(spark, sf):
    return table(spark, sf, "orders").groupBy(splits.nested("o_orderkey", "outer", "inner").alias("split")).agg(F.count("*").alias("n"))


@register("crc_fold_rates")
def crc_fold_rates(spark, sf):
    return table(spark, sf, "customer").groupBy(splits.crc_fold("c_custkey", 5).alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@register("sha_fold_rates", "SELECT (('0x' || substr(sha256('f:' || c_custkey), 1, 15))::UBIGINT % 5)::INTEGER AS fold, count(*) AS n FROM customer GROUP BY 1")
def sha_fold_rates(spark, sf):
    return table(spark, sf, "customer").groupBy(splits.sha_fold("c_custkey", 5, "f").alias("fold")).agg(F.count("*").alias("n"))


@register("last_frame_per_key", "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_frame_per_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return tables.last_per_key(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@register(
    "first_record_per_key",
    "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1",
)
def first_record_per_key(spark, sf):
    d = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return tables.first_wins(d, ["l_partkey"], "at").select("l_partkey", "l_orderkey", "l_linenumber")


@register(
    "composition_key",
    """WITH f AS (SELECT p_partkey, p_size AS a, p_partkey % 12 + 1 AS b FROM part)
    SELECT 'Fe' || a || 'O' || b AS formula, 'Fe' || (a // gcd(a, b)) || '|O' || (b // gcd(a, b)) AS comp, 'Fe-O' AS system, count(*) AS n FROM f GROUP BY 1, 2""",
)
def composition_key(spark, sf):
    f = F.concat(F.lit("Fe"), F.col("p_size"), F.lit("O"), F.col("p_partkey") % 12 + 1)
    return table(spark, sf, "part").select(f.alias("formula")).groupBy("formula", text.composition_key("formula").alias("comp"), text.chemical_system("formula").alias("system")).agg(F.count("*").alias("n"))


@register(
    "site_summaries",
    """SELECT l_orderkey, CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END AS sign, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.05), 6) AS q05, round(quantile_cont(l_quantity, 0.95), 6) AS q95 FROM lineitem GROUP BY 1, 2""",
)
def site_summaries(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("charge", F.when(F.col("l_discount") > 0.05, 1.0).otherwise(-1.0))
    got = nested.site_summaries(d, "l_orderkey", "charge", ["l_quantity"])
    return got.select("l_orderkey", "sign", "n", *[F.round(f"l_quantity_{x}", 6).alias(x) for x in ("mean", "q05", "q95")])


@register(
    "effective_coordination",
    """WITH w AS (SELECT l_orderkey, exp(1 - pow((l_quantity + 50) / min(l_quantity + 50) OVER (PARTITION BY l_orderkey), 6)) AS w FROM lineitem), p AS (SELECT l_orderkey, w, w / sum(w) OVER (PARTITION BY l_orderkey) AS p FROM w)
    SELECT l_orderkey, round(sum(w), 5) AS econ, round(exp(-sum(p * ln(p))), 5) AS entropy_cn FROM p GROUP BY 1""",
)
def effective_coordination(spark, sf):
    e = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") + 50).alias("d"))
    got = nested.effective_coordination(e, ["l_orderkey"], "d")
    return got.select("l_orderkey", *[F.round(c, 5).alias(c) for c in ("econ", "entropy_cn")])


@register(
    "shared_ligands",
    """WITH l AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS c, l_partkey % 10 AS x FROM lineitem) SELECT kind, count(*) AS n FROM (
    SELECT CASE WHEN count(*) = 1 THEN 'corner' WHEN count(*) = 2 THEN 'edge' ELSE 'face' END AS kind FROM l a JOIN l b ON a.s = b.s AND a.x = b.x AND a.c < b.c GROUP BY a.s, a.c, b.c) GROUP BY 1""",
)
def shared_ligands(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_partkey") % 10).alias("x")).distinct()
    return nested.shared_ligands(d, "l_orderkey", "l_suppkey", "x").groupBy("kind").agg(F.count("*").alias("n"))


@register(
    "received_strength",
    """WITH c AS (SELECT s_suppkey, nullif(s_nationkey, 3)::DOUBLE AS ox, 1 + s_suppkey % 6 AS cn FROM supplier)
    SELECT l_orderkey, CASE WHEN count(ox) = count(*) THEN round(sum(ox / cn), 6) END AS strength, count(*) AS bonds FROM lineitem JOIN c ON l_suppkey = s_suppkey GROUP BY 1""",
)
def received_strength(spark, sf):
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.nullif("s_nationkey", F.lit(3)).cast("double").alias("ox"), (1 + F.col("s_suppkey") % 6).alias("cn"))
    got = nested.received_strength(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), c, ["l_suppkey"], ["l_orderkey"])
    return got.withColumn("strength", F.round("strength", 6))
