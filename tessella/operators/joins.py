"""Joins with contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> None:
    again = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if again:
        raise ContractError(f"{what}: key {again[0].asDict()} is not unique")


def validated_left_join(left: DataFrame, right: DataFrame, on: list[str], validate: str = "m:1") -> DataFrame:
    """Left join that keeps the row set; the right key (and for 1:1 the left) must be unique."""
    assert_unique(right, on, "right table")
    if validate == "1:1":
        assert_unique(left, on, "left table")
    elif validate != "m:1":
        raise ValueError("validate is '1:1' or 'm:1'")
    return left.join(right, on, "left")


def completeness(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Counts of keys on both sides and on one only."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(True))
    b = right.select(*on).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, on, "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def exact_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """1:1 join of equal key sets, else an error."""
    assert_unique(left, on, "left table")
    assert_unique(right, on, "right table")
    for a, b, what in ((left, right, "right"), (right, left, "left")):
        gone = a.join(b.select(*on), on, "left_anti").limit(1).collect()
        if gone:
            raise ContractError(f"a key is missing on the {what}: {[gone[0][k] for k in on]}")
    return left.join(right, on)


def novelty(df: DataFrame, seen: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with ``flag``: whether its key does not occur in ``seen``."""
    s = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    return df.join(s, key, "left").withColumn(flag, F.col("_seen").isNull()).drop("_seen")


def lookup_with_default(df: DataFrame, table: DataFrame, on: list[str], value: str, default: Column) -> DataFrame:
    return df.join(table.select(*on, value), on, "left").withColumn(value, F.coalesce(value, default))


def nearest_key_lookup(df: DataFrame, table: DataFrame, exact: list[str], near: str, value: str) -> DataFrame:
    """The table's value at the nearest ``near`` within equal ``exact`` keys, ties to the smaller; with ``how`` and ``distance``.

    The entries of a key are gathered and sorted once from the table, a parameter
    table; a row finds its place in them by bisection and looks at the two beside it.
    Of equal entries the smallest value counts.
    """
    entries = table.filter(F.col(near).isNotNull()).groupBy(*exact, F.col(near).alias("_k")).agg(F.min(value).alias("_v"))
    gathered = entries.groupBy(*exact).agg(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), F.col("_v").alias("v")))).alias("_all"))
    size = F.coalesce(F.size("_all"), F.lit(0))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    # The number of entries under the row's key; 31 halvings are enough for any array.
    place = F.aggregate(
        F.sequence(F.lit(1), F.lit(31)),
        F.struct(F.lit(0).alias("lo"), F.greatest(size, F.lit(0)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(F.get("_all", mid(s))["k"] < F.col(near), F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
                F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))
            )
        ),
        lambda s: s["lo"],
    )
    out = df.join(gathered, exact, "left").withColumn("_place", F.when(F.col(near).isNotNull(), place))
    beside = F.filter(F.array(F.get("_all", F.col("_place") - 1), F.get("_all", F.col("_place"))), lambda s: s.isNotNull())
    best = F.array_min(F.transform(beside, lambda s: F.struct(F.abs(s["k"] - F.col(near)).alias("distance"), s["k"].alias("k"), s["v"].alias("v"))))
    out = out.withColumn("_best", best)
    how = F.when(F.col("_best").isNull(), "none").when(F.col("_best.distance") == 0, "exact").otherwise("nearest")
    return out.withColumns({"how": how, "distance": F.col("_best.distance"), value: F.col("_best.v")}).drop("_all", "_place", "_best")


def representative(df: DataFrame, group: str, identity: str, salt: str) -> DataFrame:
    """One row a group: the smallest sha256 of salt and identity."""
    h = F.sha2(F.concat(F.lit(salt + ":"), F.col(identity).cast("string")), 256)
    names = df.columns
    return df.groupBy(group).agg(F.min_by(F.struct(*names), F.struct(h, F.col(identity))).alias("_r")).select("_r.*")


def distinct_agreeing(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row a key; an error if its records disagree."""
    bad = df.groupBy(key).agg(F.greatest(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in attributes], F.lit(1)).alias("_d"))
    if not bad.filter("_d > 1").limit(1).isEmpty():
        raise ContractError(f"records of one {key} disagree")
    return df.groupBy(key).agg(*[F.any_value(c).alias(c) for c in attributes])


def duplicates_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by an order that ends in a unique column."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def split_guard(df: DataFrame, column: str, allowed: set[str]) -> DataFrame:
    """The table itself; an error on a missing column, a null or a forbidden split."""
    if column not in df.columns:
        raise ContractError(f"no split column {column!r}")
    bad = df.filter(F.col(column).isNull() | ~F.col(column).isin(*sorted(allowed))).select(column).limit(1).collect()
    if bad:
        raise ContractError(f"split {bad[0][0]!r} is not allowed here")
    return df
