"""Running totals over a whole table without bringing it to one task.

Values are dealt in ranges whose bounds are quantiles of the data (at most one a
shuffle partition comes to the driver); a window runs inside each range and the
ranges' totals, a table of as many rows, give the rest. Equal values are in one
range, so that totals "up to and with this value" are right at ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.scratch import written


def with_range(values: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``values`` with ``_range``: how many bounds of its group are at or under the value.

    Bounds are quantiles of each group's values, at most one a shuffle partition, so
    that groups of different scales are dealt alike.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return values.withColumn("_range", F.lit(0))
    marks = F.array_sort(F.array_distinct(F.percentile_approx(key, [i / n for i in range(1, n)], 100 * n))).alias("_marks")
    if by:
        values = values.join(values.groupBy(*by).agg(marks), by)
    else:
        values = values.join(F.broadcast(values.agg(marks)))
    size = F.size("_marks")
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    at = F.aggregate(
        F.sequence(F.lit(0), F.lit(n.bit_length())),
        F.struct(F.lit(0).alias("lo"), size.alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(F.get("_marks", mid(s)) <= F.col(key), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
                F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))
            )
        ),
        lambda s: s["lo"],
    )
    return values.withColumn("_range", at).drop("_marks")


def running_totals(df: DataFrame, key: str, totals: dict[str, Column], by: list[str] = (), descending: bool = False) -> DataFrame:
    """A row per (by, value of key), with n, the sums of ``totals`` and their running sums ``cum_<name>``.

    The running sums take in the value itself (ties end together). NULL keys are left out.
    """
    df = df.filter(F.col(key).isNotNull())
    by = list(by)
    sums = {"n": F.count("*"), **{k: F.sum(v) for k, v in totals.items()}}
    # Bounds, ranges and windows read the grouped values; they are computed once.
    values = written(df.groupBy(*by, key).agg(*[v.alias(k) for k, v in sums.items()]), "values")
    values = with_range(values, key, by)
    order = F.col(key).desc() if descending else F.col(key).asc()
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    ranges = values.groupBy(*by, "_range").agg(*[F.sum(k).alias("_" + k) for k in sums])
    before = Window.partitionBy(*by).orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_range", *[F.coalesce(F.sum("_" + k).over(before), F.lit(0)).alias("_before_" + k) for k in sums])
    out = values.withColumns({"cum_" + k: F.sum(k).over(inside) for k in sums})
    out = out.join(ranges, [*by, "_range"])
    return out.withColumns({"cum_" + k: F.col("cum_" + k) + F.col("_before_" + k) for k in sums}).select(
        *by, key, *sums, *["cum_" + k for k in sums]
    )
