"""Order statistics with the four conventions in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.running import running_totals, with_range
from tessella.sources.scratch import written


def order_statistics(df: DataFrame, features: list[str], qs: list[float], how: str = "linear", by: list[str] = ()) -> DataFrame:
    """(by, feature, q, value) for every feature and q, from running totals, so that no task holds a feature's values.

    ``linear`` interpolates at q (n - 1); ``discrete`` is the smallest value whose
    share of rows reaches q. A feature without values has none.
    """
    keys = [*by, "feature"]
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = df.select(*by, stacked.alias("x")).select(*by, "x.feature", "x.v").filter("v is not null")
    values = written(long.groupBy(*keys, "v").agg(F.count("*").alias("n")), "order-statistics")
    ranged = with_range(values, "v", keys)
    # A row per range: how many rows lie before it and in all.
    up, all_ = Window.partitionBy(*keys).orderBy("_range"), Window.partitionBy(*keys)
    ranges = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_m"))
    ranges = ranges.withColumns({"_upto": F.sum("_m").over(up), "total": F.sum("_m").over(all_)})
    asked = ranges.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    if how == "discrete":
        at = F.greatest(F.ceil(F.col("q") * F.col("total") - 1e-9), F.lit(1)) - 1
        asked = asked.withColumn("low", at.cast("long")).withColumn("high", F.col("low")).withColumn("part", F.lit(0.0))
    else:
        place = F.col("q") * (F.col("total") - 1)
        asked = asked.withColumn("low", F.floor(place).cast("long")).withColumn("high", F.ceil(place).cast("long")).withColumn("part", place - F.floor(place))
    before = F.col("_upto") - F.col("_m")
    inside = lambda c: (F.col(c) >= before) & (F.col(c) < F.col("_upto"))
    asked = asked.filter(inside("low") | inside("high"))
    asked = asked.groupBy(*keys, "_range").agg(F.first(before).alias("_before"), F.collect_list(F.struct("q", "low", "high", "part")).alias("_asked"))
    # Only ranges that hold a place asked for are sorted; a range's list has at most as many entries as q.
    met = ranged.join(asked, [*keys, "_range"])
    met = met.withColumn("_cum", F.col("_before") + F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy("v")))
    first = F.col("_cum") - F.col("n")
    holds = lambda p: ((p >= first) & (p < F.col("_cum")))
    met = met.withColumn("x", F.explode(F.filter("_asked", lambda x: holds(x["low"]) | holds(x["high"]))))
    ends = [F.max(F.when(holds(F.col(f"x.{c}")), F.col("v"))).alias(n) for c, n in (("low", "a"), ("high", "b"))]
    out = met.groupBy(*keys, F.col("x.q").alias("q")).agg(*ends, F.first("x.part").alias("part"))
    return out.select(*keys, "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def quantile_columns(df: DataFrame, c: str, named: dict[str, float], by: list[str], how: str = "linear") -> DataFrame:
    """(by, a column per name): quantiles of one column within groups."""
    qs = sorted(set(named.values()))
    wide = order_statistics(df, [c], qs, how, by).groupBy(*by).pivot("q", qs).agg(F.first("value"))
    at = {q: n for q, n in zip(qs, wide.columns[len(by) :])}
    return wide.select(*by, *[F.col(f"`{at[q]}`").alias(n) for n, q in named.items()])


def quantile_lists(df: DataFrame, features: list[str], qs: list[float], how: str = "linear") -> dict[str, list[float] | None]:
    """Feature -> its quantiles in the order of ``qs``, None without values; only these numbers come to the driver."""
    got = {(r["feature"], r["q"]): r["value"] for r in order_statistics(df, features, sorted(set(qs)), how).collect()}
    return {f: [got[f, float(q)] for q in qs] if (f, float(qs[0])) in got else None for f in features}


def higher(df: DataFrame, c: str, q: float) -> DataFrame:
    """One row ``value``: the order statistic at ceil(q (n - 1)), counting from 0."""
    run = running_totals(df, c, {})
    n = df.agg(F.count(c).alias("_total"))
    return run.join(F.broadcast(n)).filter(F.col("cum_n") > F.ceil(F.lit(q) * (F.col("_total") - 1))).agg(F.min(c).alias("value"))


def weighted(df: DataFrame, c: str, w: str, q: float) -> DataFrame:
    """One row ``value``: interpolation at q of the weighted midpoint distribution (sum up to - w / 2) / total."""
    df = df.filter(F.col(c).isNotNull() & (F.col(w) > 0))
    run = running_totals(df, c, {"w": F.col(w)})
    total = df.agg(F.sum(w).alias("_total"))
    pos = run.join(F.broadcast(total)).select(F.col(c).alias("v"), ((F.col("cum_w") - F.col("w") / 2) / F.col("_total")).alias("p"))
    # The neighbours of q: the last at or under it and the first over it, as one aggregate.
    side = pos.agg(
        F.max(F.when(F.col("p") <= q, F.struct("p", "v"))).alias("a"), F.min(F.when(F.col("p") > q, F.struct("p", "v"))).alias("b")
    )
    inner = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (q - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))
    return side.select(F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull(), F.col("a.v")).otherwise(inner).alias("value"))


def threshold_grid(df: DataFrame, features: list[str], points: int = 60, digits: int = 6) -> DataFrame:
    """(feature, threshold): distinct rounded quantiles of every feature."""
    qs = [(i + 0.5) / points for i in range(points)]
    return order_statistics(df, features, qs).select("feature", F.round("value", digits).alias("threshold")).distinct()


def label_free_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, least, q10, median, q90, most), discrete quantiles."""
    ends = df.agg(*[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most")).alias(c) for c in features])
    ends = ends.select(F.explode(F.array(*features)).alias("r")).select("r.*")
    qs = order_statistics(df, features, [0.1, 0.5, 0.9], "discrete").groupBy("feature").pivot("q", [0.1, 0.5, 0.9]).agg(F.first("value"))
    qs = qs.toDF("feature", "q10", "median", "q90")
    return ends.join(F.broadcast(qs), "feature", "left").select("feature", "n", "least", "q10", "median", "q90", "most")


def equal_count_bins(df: DataFrame, c: str, k: int, out: str = "bin") -> DataFrame:
    """``df`` with the number of the quantile bin (0..k-1), edges in the lower bin."""
    edges = quantile_lists(df, [c], [i / k for i in range(1, k)])[c] or []
    b = F.lit(0)
    for e in edges:
        b = b + (F.col(c) > e).cast("int")
    return df.withColumn(out, F.when(F.col(c).isNotNull(), b))


def robust_z(df: DataFrame, c: str, out: str) -> DataFrame:
    """(v - median) / IQR; NULL if the IQR is 0."""
    q = quantile_lists(df, [c], [0.25, 0.5, 0.75])[c]
    spread = None if q is None or q[2] == q[0] else q[2] - q[0]
    return df.withColumn(out, (F.col(c) - q[1]) / spread if spread else F.lit(None).cast("double"))


def group_rank_percentile(df: DataFrame, group: str, c: str, out: str) -> DataFrame:
    """(mean rank - 1) / (count - 1) within groups of more than one row, from running totals of the group's values."""
    run = running_totals(df, c, {}, [group])
    n = F.max("cum_n").alias("_n")
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    ranks = run.join(run.groupBy(group).agg(n), group).filter("_n > 1").select(group, c, ((rank - 1) / (F.col("_n") - 1)).alias(out))
    return df.join(ranks, [group, c], "left")
