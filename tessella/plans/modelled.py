"""Large rule catalogues, searches on bit masks, joint ceilings and audits, exact keys and charges."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tessella.functions import numeric, text
from tessella.operators import additive, audit, boosting, cells, fanout, geometry, manyfits, masks, mining, periodic, quantiles
from tessella.plans.mined import FEATURES, _sides
from tessella.plans.registry import register, table
from tessella.sources import shards
from tessella.sources.scratch import scratch_dir

SINGLE_WEIGHTS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0]
PAIR_WEIGHTS = [0.1, 0.25, 0.5, 1.0, 2.0]
SHARES = [i / 100 for i in range(1, 30)]


@register("rule_universe")
def rule_universe(spark, sf):
    """Every one-sided rule on a grid of thresholds, alone and under every guard on the grid: over 100,000 rules, two scans."""
    real, bad = _sides(spark, sf)
    grid = quantiles.threshold_grid(real, FEATURES, points=120)
    no = lambda kind: F.lit(None).cast(kind)
    hi = grid.select("feature", F.lit("hi").alias("side"), no("double").alias("lower"), F.col("threshold").alias("upper"))
    alone = hi.union(grid.select("feature", F.lit("lo"), "threshold", no("double")))
    side = spark.createDataFrame([("hi",), ("lo",)], "guard_side string")
    guards = grid.select(F.col("feature").alias("guard"), F.col("threshold").alias("guard_threshold")).crossJoin(F.broadcast(side))
    guarded = alone.join(guards, F.col("feature") != F.col("guard")).select(*alone.columns, "guard", "guard_side", "guard_threshold")
    rules = alone.select("*", no("string").alias("guard"), no("string").alias("guard_side"), no("double").alias("guard_threshold")).union(guarded)
    got = cells.rule_rates(real, bad, rules)
    return got.withColumns({c: F.round(c, 6) for c in ("satisfaction", "rejection")})


def _guard_grid_sql() -> str:
    return """WITH real AS (SELECT * FROM lineitem WHERE l_returnflag = 'N'), bad AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N'),
    q AS (SELECT unnest([5.0, 10.0, 20.0, 30.0, 40.0, 45.0])::DOUBLE AS u), g AS (SELECT unnest([0.0, 0.02, 0.05, 0.08])::DOUBLE AS t), s AS (SELECT unnest(['hi', 'lo']) AS guard_side),
    c AS (SELECT u, t, guard_side FROM q, g, s),
    r AS (SELECT u, t, guard_side, avg(CAST(NOT coalesce(CASE WHEN guard_side = 'hi' THEN l_discount > t ELSE l_discount <= t END, false) OR coalesce(l_quantity <= u, true) AS INT)) AS satisfaction FROM c, real GROUP BY ALL),
    b AS (SELECT u, t, guard_side, avg(CAST(NOT (NOT coalesce(CASE WHEN guard_side = 'hi' THEN l_discount > t ELSE l_discount <= t END, false) OR coalesce(l_quantity <= u, true)) AS INT)) AS rejection FROM c, bad GROUP BY ALL)
    SELECT u AS upper, t AS guard_threshold, guard_side, round(satisfaction, 6) AS satisfaction, round(rejection, 6) AS rejection FROM r JOIN b USING (u, t, guard_side)"""


@register("guard_grid", _guard_grid_sql())
def guard_grid(spark, sf):
    real, bad = _sides(spark, sf)
    rules = [mining.Candidate("l_quantity", "hi", None, u, "l_discount", s, t) for u in (5.0, 10.0, 20.0, 30.0, 40.0, 45.0) for t in (0.0, 0.02, 0.05, 0.08) for s in ("hi", "lo")]
    got = cells.rule_rates(real, bad, mining.catalogue(spark, rules).drop("satisfaction", "rejection"))
    return got.select("upper", "guard_threshold", "guard_side", F.round("satisfaction", 6).alias("satisfaction"), F.round("rejection", 6).alias("rejection"))


@register(
    "tail_catalogue",
    f"""WITH n AS (SELECT p_brand AS feature, count(*) AS n FROM part GROUP BY 1), short AS (SELECT feature FROM n ORDER BY n DESC, feature LIMIT 8), d AS (SELECT unnest([-1, 1])::INT AS d),
    w AS (SELECT unnest({SINGLE_WEIGHTS})::DOUBLE AS w), v AS (SELECT unnest({PAIR_WEIGHTS})::DOUBLE AS w), s AS (SELECT unnest({SHARES})::DOUBLE AS reject_share),
    t AS (SELECT feature, d, w FROM short, d, v),
    c AS (SELECT 'anchor' AS kind, NULL::VARCHAR AS feature, NULL::INT AS dir1, NULL::DOUBLE AS weight, NULL::VARCHAR AS feature2, NULL::INT AS dir2, NULL::DOUBLE AS weight2
      UNION ALL SELECT 'single', feature, d, w, NULL, NULL, NULL FROM n, d, w
      UNION ALL SELECT 'pair', a.feature, a.d, a.w, b.feature, b.d, b.w FROM t a JOIN t b ON a.feature < b.feature)
    SELECT c.*, reject_share FROM c, s""",
)
def tail_catalogue(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.count("*").alias("n"))
    short = names.orderBy(F.desc("n"), "feature").limit(8)
    return cells.tail_catalogue(names, short, SINGLE_WEIGHTS, PAIR_WEIGHTS, SHARES)


@register("robust_beam")
def robust_beam(spark, sf):
    real, bad = _sides(spark, sf)
    pool = mining.one_sided(real, FEATURES, alphas=(0.02, 0.05, 0.1))
    strata = {"few": F.col("l_linenumber") <= 3, "cheap": F.col("l_extendedprice") < 20000}
    best = masks.robust_beam(real, bad, pool, "l_returnflag", 0.8, strata, {"few": 0.78, "cheap": 0.7}, width=12, most=4, least_gain=0.001)
    rows = [(pool[i].feature, pool[i].side, pool[i].lower, pool[i].upper, *[round(float(best[k]), 6) for k in ("satisfaction", "rejection", "worst_kind")]) for i in best["laws"]] if best else []
    return spark.createDataFrame(rows, "feature string, side string, lower double, upper double, satisfaction double, rejection double, worst_kind double")


@register(
    "joint_rates",
    """WITH r(i, lo, hi, f) AS (VALUES (0, NULL, 40.0, 'q'), (1, 5.0, NULL, 'q'), (2, NULL, 0.07, 't'), (3, 0.01, NULL, 'd')),
    o AS (SELECT l_returnflag AS flag, [l_quantity <= 40, l_quantity >= 5, l_tax <= 0.07, l_discount >= 0.01] AS ok FROM lineitem)
    SELECT flag, s.i AS first, r.i AS second, count(*) FILTER (WHERE ok[s.i + 1] AND ok[r.i + 1]) AS n FROM o, r s, r GROUP BY ALL""",
)
def joint_rates(spark, sf):
    d = table(spark, sf, "lineitem")
    rules = [F.col("l_quantity") <= 40, F.col("l_quantity") >= 5, F.col("l_tax") <= 0.07, F.col("l_discount") >= 0.01]
    got = masks.joint_counts(masks.pack(d, rules, F.col("l_returnflag")), [(i,) for i in range(4)])
    rows = [(k, i, j, int(x[i, j])) for k, x in got.items() for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "flag string, first int, second int, n long")


@register("joint_ceiling")
def joint_ceiling(spark, sf):
    """Two features that tell nothing alone tell the label together; folds by order."""
    d = table(spark, sf, "lineitem").withColumn("y", ((F.col("l_quantity") > 25) != (F.col("l_discount") > 0.05)).cast("int"))
    s = boosting.Settings(rounds=8, depth=3, rate=0.3)
    got = boosting.joint_ceiling(d, ["l_quantity", "l_discount", "l_tax"], "y", F.pmod(F.crc32(F.col("l_orderkey").cast("string").cast("binary")), F.lit(3)), 3, s)
    return got.select("features", *[F.round(c, 6).alias(c) for c in ("cv_accuracy", "cv_majority", "cv_gain")])


@register("leak_controls")
def leak_controls(spark, sf):
    d = table(spark, sf, "orders").withColumn("y", (F.col("o_totalprice") > 150000).cast("int")).withColumn("customer", F.col("o_custkey").cast("double"))
    fold = F.pmod(F.crc32(F.col("o_custkey").cast("string").cast("binary")), F.lit(3))
    got = audit.leak_audit(d, ["o_totalprice", "customer"], "y", "o_orderkey", fold, 3, {"o_totalprice": {"price"}, "customer": {"account"}}, set(), controls=3)
    return got.select("feature", "control", "statistical", F.round("ceiling", 6).alias("ceiling"), "verdict")


@register(
    "rational_keys",
    """WITH p AS (SELECT p_partkey, p_size % 9 + 1 AS a, p_partkey % 7 + 1 AS b, p_partkey % 3 + 1 AS c FROM part), g AS (SELECT *, gcd(a::BIGINT, gcd(b::BIGINT, c::BIGINT)) AS g FROM p)
    SELECT p_partkey, concat('Ca', a // g, '|O', c // g, '|Ti', b // g) AS key FROM g""",
)
def rational_keys(spark, sf):
    """Shares with six decimals (sevenths, ninths, elevenths ...) come back to their whole-number key."""
    a, b, c = F.col("p_size") % 9 + 1, F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 3 + 1
    share = lambda x: F.format_string("%.10f", x / (a + b + c).cast("double"))
    formula = F.concat(F.lit("Ca"), share(a), F.lit("Ti"), share(b), F.lit("O"), share(c))
    return text.with_rational_key(table(spark, sf, "part").select("p_partkey", formula.alias("formula")), "formula", "key").select("p_partkey", "key")


@register(
    "charge_balances",
    """WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS a, p_partkey % 3 + 1 AS b, p_partkey % 7 + 1 AS c FROM part),
    v AS (SELECT * FROM (SELECT unnest([2, 3]) AS x, unnest([0, 1]) AS i), (SELECT unnest([4, 3, 2]) AS y, unnest([0, 1, 2]) AS j)),
    m AS (SELECT p_partkey, first(concat('Fe+', x, ',Mn+', y, ',O-2') ORDER BY i, j) AS assignment FROM p, v WHERE a * x + b * y = 2 * c GROUP BY 1)
    SELECT p_partkey, assignment IS NOT NULL AS balanced, assignment FROM p LEFT JOIN m USING (p_partkey)""",
)
def charge_balances(spark, sf):
    d = table(spark, sf, "part").select(
        "p_partkey",
        F.array(F.lit("Fe"), F.lit("Mn"), F.lit("O")).alias("e"),
        F.array(F.col("p_size") % 4 + 1, (F.col("p_partkey") % 3 + 1).cast("int"), (F.col("p_partkey") % 7 + 1).cast("int")).alias("n"),
    )
    return geometry.charge_balance(d, "p_partkey", "e", "n", {"Fe": [2, 3], "Mn": [4, 3, 2], "O": [-2]})


@register(
    "mean_valences",
    """WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS a, p_partkey % 3 AS b, p_partkey % 7 + 1 AS c FROM part)
    SELECT p_partkey, CASE WHEN b = 0 THEN round(2 * c / a::DOUBLE, 6) WHEN (2 * c - b) / a::DOUBLE > 0 AND (2 * c - b) / a::DOUBLE <= 8 THEN round((2 * c - b) / a::DOUBLE, 6) END AS iron FROM p""",
)
def mean_valences(spark, sf):
    a, b, c = F.col("p_size") % 4 + 1, (F.col("p_partkey") % 3).cast("int"), (F.col("p_partkey") % 7 + 1).cast("int")
    d = table(spark, sf, "part").select(
        "p_partkey",
        F.when(b == 0, F.array(F.lit("Fe"), F.lit("O"))).otherwise(F.array(F.lit("Fe"), F.lit("Na"), F.lit("O"))).alias("e"),
        F.when(b == 0, F.array(a, c)).otherwise(F.array(a, b, c)).alias("n"),
    )
    v = geometry.mean_valences(F.col("e"), F.col("n"), {"O": -2}, {"Na": 1})
    return d.select("p_partkey", F.round(F.try_element_at(v, F.lit("Fe")), 6).alias("iron"))


def _parsed(record: dict) -> list[dict]:
    x = json.loads(record["props"])
    return [{"tags": len(x.get("tags") or []), "items": len(x.get("items") or [])}]


@register("parsed_clicks")
def parsed_clicks(spark, sf):
    """Every click's properties parsed, with what became of those that can't be."""
    clicks = table(spark, sf, "clicks").select("click_id", "props")
    rows, failures = fanout.fan_out(clicks, "click_id", _parsed, "tags int, items int", seconds=10.0)
    none = F.lit(None).cast("int")
    return rows.select("click_id", F.lit("ok").alias("outcome"), "tags", "items").union(failures.select("click_id", "error", none, none))


@register("sharded_sales")
def sharded_sales(spark, sf):
    """Sales written in shards, taken up again (nothing is left to do), merged and read back."""
    path = f"{scratch_dir(spark)}/tessella/sharded-sales-{uuid.uuid4().hex}"
    sales = table(spark, sf, "sales").select("sale_id", "client_id", "total")
    shards.write_missing(sales, "sale_id", 16, f"{path}/shards")
    if shards.write_missing(sales, "sale_id", 16, f"{path}/shards"):
        raise RuntimeError("finished shards were repeated")
    merged = shards.merge(spark, f"{path}/shards", f"{path}/merged", 16)
    return merged.groupBy(F.pmod(F.xxhash64("sale_id"), F.lit(16)).cast("int").alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@register("nested_selection")
def nested_selection(spark, sf):
    """Sparse pairwise scores of suppliers' balances by nested folds of four groups."""
    s, features = _supplier_features(spark, sf)
    part = F.col("part")
    got = manyfits.nested_selection(s, "part", "s_suppkey", "s_acctbal", features, part % 2, 2, F.floor(part / 2), 2, [10.0, 100.0], [1, 2])
    rows = [(c.fold, c.c, c.terms, round(c.mean, 6), round(c.accuracy, 6), ",".join(sorted(c.coefficients))) for c in got]
    return spark.createDataFrame(rows, "fold int, c double, terms int, inner_accuracy double, accuracy double, chosen string")


@register("refit_stability")
def refit_stability(spark, sf):
    s, features = _supplier_features(spark, sf)
    got = manyfits.refits(s, "s_nationkey", "s_suppkey", "s_acctbal", features, [0.5, 0.8], 5, 5, l2=0.01)
    rows = [(r["kind"], r["fraction"], r["draw"], round(r["cosine"], 6), round(r["accuracy"], 6)) for r in got]
    return spark.createDataFrame(rows, "kind string, fraction double, draw int, cosine double, accuracy double")


def _supplier_features(spark, sf):
    s = table(spark, sf, "supplier")
    noise = F.pmod(F.xxhash64("s_suppkey"), F.lit(1000)) / 1000.0
    s = s.select("s_nationkey", (F.col("s_suppkey") % 4).cast("int").alias("part"), "s_suppkey", "s_acctbal", noise.alias("noise"), (F.col("s_suppkey") % 7 / 7.0).alias("key"), (F.col("s_acctbal") / 10000 + noise).alias("told"))
    return s, ["noise", "key", "told"]


@register("additive_scores")
def additive_scores(spark, sf):
    """Sparse sums of an order line's ratios that single out returned lines from accepted ones, with their best cuts."""
    d = table(spark, sf, "lineitem")
    terms = [
        additive.Term("discount", "price", F.col("l_discount") * 10),
        additive.Term("tax", "price", F.col("l_tax") * 10),
        additive.Term("quantity", "size", F.col("l_quantity") / 50),
        additive.Term("number", "place", F.col("l_linenumber") / 7),
    ]
    found = additive.search(d, terms, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", 0.3, 0.2, (0.5, 1.0), pairs=3, triples=3)
    rows = [("+".join(f.terms), f.key, f.auc and round(f.auc, 6), f.threshold and round(f.threshold, 6), f.rejected, f.severe) for f in found]
    return spark.createDataFrame(rows, "terms string, formula string, auc double, threshold double, rejected long, severe long")


def _crystals(spark, sf):
    """A crystal a supplier: rock salt in its skew primitive cell or caesium chloride, of an edge that follows from the balance."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (4 + F.abs("s_acctbal") / 10000).alias("a"))
    rock = F.col("id") % 2 == 0
    corner = lambda i, j: F.when(rock, F.lit(0.0 if i == j else 0.5)).otherwise(F.lit(1.0 if i == j else 0.0)) * F.col("a")
    structures = s.select("id", "a", rock.alias("rock"), F.array(*[F.array(*[corner(i, j) for j in range(3)]) for i in range(3)]).alias("lattice"))
    site = lambda n, x, q, e: F.struct(F.lit(n).alias("site"), F.lit(x).alias("x"), F.lit(x).alias("y"), F.lit(x).alias("z"), F.lit(q).alias("charge"), F.lit(e).alias("species"))
    return structures, s.select("id", F.explode(F.array(site(0, 0.0, 1.0, "M"), site(1, 0.5, -1.0, "X"))).alias("r")).select("id", "r.*")


@register(
    "periodic_pairs",
    """WITH s AS (SELECT s_suppkey AS id, 4 + abs(s_acctbal) / 10000 AS a FROM supplier), f AS (SELECT unnest([0, 1]) AS site, unnest([0.0, 0.5])::DOUBLE AS p), t AS (SELECT unnest(range(-4, 5)) AS n),
    d AS (SELECT id, a, i.site AS i, j.site AS j, x.n + j.p - i.p AS x, y.n + j.p - i.p AS y, z.n + j.p - i.p AS z FROM s, f i, f j, t x, t y, t z WHERE i.site <> j.site OR x.n <> 0 OR y.n <> 0 OR z.n <> 0),
    r AS (SELECT id, i, j, a * CASE WHEN id % 2 = 0 THEN sqrt((y + z) ** 2 + (x + z) ** 2 + (x + y) ** 2) / 2 ELSE sqrt(x ** 2 + y ** 2 + z ** 2) END AS distance FROM d)
    SELECT id, i, j, count(*) AS n, round(min(distance), 6) AS nearest, round(sum(distance), 4) AS total FROM r WHERE distance <= 6 GROUP BY ALL""",
)
def periodic_pairs(spark, sf):
    structures, sites = _crystals(spark, sf)
    n = periodic.neighbours(structures, sites, 6.0)
    return n.groupBy("id", "i", "j").agg(F.count("*").alias("n"), numeric.scaled_round(F.min("distance"), 6).alias("nearest"), numeric.scaled_round(F.sum("distance"), 4).alias("total"))


def _bonds(spark, sf):
    structures, sites = _crystals(spark, sf)
    near = periodic.neighbours(structures, sites, 5.0).filter("i = 0 and j = 1")
    first = near.groupBy("id").agg(F.min("distance").alias("least"))
    return near.join(first, "id").filter("distance < 1.05 * least").select("id", "i", "j", "tx", "ty", "tz"), structures, sites


@register(
    "polyhedra_rules",
    """SELECT s_suppkey AS id, 0.0::DOUBLE AS worst_deviation, round(CASE WHEN s_suppkey % 2 = 0 THEN 6 / 9.0 ELSE 6 / 13.0 END::DOUBLE, 6) AS edges, round(CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 3 / 13.0 END::DOUBLE, 6) AS faces, 1::BIGINT AS environments FROM supplier""",
)
def polyhedra_rules(spark, sf):
    """Octahedra of rock salt share edges with 12 neighbours and corners with 6, cubes of caesium chloride faces with 6, edges with 12 and corners with 8."""
    bonds, _, sites = _bonds(spark, sf)
    got = periodic.polyhedra(bonds, sites)
    return got.select("id", F.round(F.abs(F.round("worst_deviation", 9)), 6).alias("worst_deviation"), F.round("edges", 6).alias("edges"), F.round("faces", 6).alias("faces"), "environments")


@register(
    "madelung_constants",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 1.747565 ELSE 1.762675 END::DOUBLE AS madelung FROM supplier""",
)
def madelung_constants(spark, sf):
    structures, sites = _crystals(spark, sf)
    nearest = F.col("a") * F.when(F.col("rock"), 0.5).otherwise(F.sqrt(F.lit(3.0)) / 2)
    return periodic.madelung(structures, sites, nearest, digits=9).select("id", F.round("madelung", 6).alias("madelung"))
