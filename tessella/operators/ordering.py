"""Operators on one sorted score: AUC, correlations, thresholds under gates, leaks."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numeric import clopper_pearson_upper, wilson
from tessella.operators.running import running_totals, with_range
from tessella.sources.scratch import written


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: exact Mann-Whitney AUC with ties averaged."""
    run = running_totals(df, score, {"pos": F.col(label).cast("long")})
    mid = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    t = run.agg(F.sum(mid * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return t.select(((F.col("r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0))).alias("auc"))


def midranks(df: DataFrame, c: str, out: str) -> DataFrame:
    """``df`` with the averaged rank of a column over the whole table."""
    run = running_totals(df, c, {}).select(c, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(out))
    return df.join(run, c, "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return midranks(midranks(df, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("rho"))


def cut_table(df: DataFrame, score: str, bad: str, by: list[str] = ()) -> DataFrame:
    """Rejecting every row at or over a value: n rejected, hits among them, totals, per value."""
    run = running_totals(df, score, {"bad": F.col(bad).cast("long")}, by, descending=True)
    total = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.col(bad).cast("long")).alias("total_bad"))
    run = run.join(total, list(by)) if by else run.join(F.broadcast(total))
    return run.select(*by, F.col(score).alias("threshold"), F.col("cum_n").alias("rejected"), F.col("cum_bad").alias("hits"), "total", "total_bad")


def wilson_threshold(df: DataFrame, score: str, bad: str, precision: float, recall: float = 0.0) -> DataFrame:
    """The feasible cut with the best (precision bound, hits, savings, threshold); no row if none is feasible."""
    t = cut_table(df, score, bad)
    low = wilson("hits", "rejected")[0]
    t = t.withColumn("precision_lower", low).withColumn("recall", F.col("hits") / F.nullif(F.col("total_bad"), F.lit(0)))
    t = t.withColumn("savings", F.col("rejected") / F.col("total"))
    ok = t.filter((F.col("precision_lower") >= precision) & (F.col("recall") >= recall))
    # The order of preference is taken on rounded numbers so that it does not hang on the last bit.
    return ok.orderBy(F.round("precision_lower", 9).desc(), F.desc("hits"), F.round("savings", 9).desc(), F.desc("threshold")).limit(1)


def clopper_pearson_threshold(df: DataFrame, score: str, good: str, most: float, confidence: float = 0.95) -> DataFrame:
    """The cut of most savings whose bound on good rows lost stays at or under ``most``.

    The bound grows with the good rows rejected, so their admissible number is found
    first, by bisection on the driver; one row, threshold NULL if even none is too many.
    """
    total = df.filter(F.col(score).isNotNull()).agg(F.coalesce(F.sum(F.col(good).cast("long")), F.lit(0))).first()[0]
    lo, hi = -1, total
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if clopper_pearson_upper(mid, total, confidence) <= most else (lo, mid - 1)
    t = cut_table(df, score, good).filter(F.col("hits") <= lo)
    return t.agg(F.min("threshold").alias("threshold"), F.max("rejected").alias("rejected"), F.max("hits").alias("good_lost"))


def safe_threshold(df: DataFrame, score: str, bad: str, cells: list[str], precision: float) -> DataFrame:
    """The cut that every cell passes, best by the worst cell's recall, precision bound and savings.

    The cells, which are few by their nature (at most 1000), are columns of one
    table of running totals, so that no cut is paired with a cell.
    """
    t = cell_totals(df, score, {"hits": F.col(bad).cast("long")}, cells)
    out = t.values.select(
        F.col(score).alias("threshold"),
        _least([F.coalesce(wilson(c["hits"], c["n"])[0], F.lit(0.0)) for c in t.cells]).alias("precision_lower"),
        _least([c["hits"] / F.nullif(c["all_hits"], F.lit(0)) for c in t.cells]).alias("recall"),
        _least([c["n"] / c["all_n"] for c in t.cells]).alias("savings"),
        sum((c["hits"] for c in t.cells), F.lit(0)).cast("long").alias("hits"),
    )
    ok = out.filter(F.col("precision_lower") >= precision)
    return ok.orderBy(F.round("recall", 9).desc(), F.round("precision_lower", 9).desc(), F.round("savings", 9).desc(), F.desc("hits"), F.desc("threshold")).limit(1)


def broad_threshold(df: DataFrame, score: str, severe: str, protected: str, cells: list[str], baseline: str, safe: float) -> DataFrame:
    """A cut under ``safe`` that in every cell dominates rejecting by ``baseline``; no row if there is none.

    In every cell: more severe rows rejected, a higher Wilson bound of their share
    among rejected severe and protected rows, a higher bound of savings, and no fewer
    protected rows kept. Of those cuts the best by the worst cell's severe recall and
    precision bound, severe rows rejected, the worst cell's savings, and the lower cut.
    """
    b = F.coalesce(F.col(baseline), F.lit(False))
    flags = {"severe": F.coalesce(F.col(severe), F.lit(False)), "protected": F.coalesce(F.col(protected), F.lit(False))}
    base = {"b_n": b.cast("long"), **{f"b_{k}": (b & v).cast("long") for k, v in flags.items()}}
    t = cell_totals(df, score, {k: v.cast("long") for k, v in flags.items()}, cells, base)
    low = lambda k, n: F.coalesce(wilson(k, n)[0], F.lit(0.0))
    better = F.lit(True)
    for c in t.cells:
        better = better & (c["severe"] > c["b_severe"]) & (c["protected"] <= c["b_protected"]) & (low(c["n"], c["all_n"]) > low(c["b_n"], c["all_n"]))
        better = better & (low(c["severe"], c["severe"] + c["protected"]) > low(c["b_severe"], c["b_severe"] + c["b_protected"]))
    out = t.values.filter(F.col(score) < safe).filter(better).select(
        F.col(score).alias("threshold"),
        _least([c["severe"] / F.nullif(c["all_severe"], F.lit(0)) for c in t.cells]).alias("recall"),
        _least([low(c["severe"], c["severe"] + c["protected"]) for c in t.cells]).alias("precision_lower"),
        _least([low(c["n"], c["all_n"]) for c in t.cells]).alias("savings_lower"),
        sum((c["severe"] for c in t.cells), F.lit(0)).cast("long").alias("severe"),
    )
    order = [F.round("recall", 9).desc(), F.round("precision_lower", 9).desc(), F.desc("severe"), F.round("savings_lower", 9).desc(), F.asc("threshold")]
    return out.orderBy(*order).limit(1)


def _least(columns: list) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


class CellTotals(NamedTuple):
    """``values``: a row per value; ``cells``: each cell's columns of it: n, the totals, ``all_`` of both, and the extra sums."""

    values: DataFrame
    cells: list


def cell_totals(df: DataFrame, score: str, totals: dict[str, Column], cells: list[str], extra: dict[str, Column] | None = None) -> CellTotals:
    """Running totals from the highest score down, in every cell at every value of the table; extra sums are whole."""
    df = df.filter(F.col(score).isNotNull())
    names = df.select(*cells).distinct().orderBy(*cells).limit(1001).collect()
    if len(names) > 1000:
        raise ValueError("more than 1000 cells")
    inside = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in cells]) for r in names]
    sums, whole, out = {}, [], []
    for i, x in enumerate(inside):
        mine = {"n": x.cast("long"), **{k: F.when(x, v).otherwise(0) for k, v in totals.items()}}
        sums |= {f"{k}_{i}": v for k, v in mine.items()}
        whole += [F.sum(v).alias(f"_all_{k}_{i}") for k, v in mine.items()]
        whole += [F.sum(F.when(x, v).otherwise(0)).alias(f"_{k}_{i}") for k, v in (extra or {}).items()]
        own = {k: F.col(f"cum_{k}_{i}") for k in mine} | {f"all_{k}": F.col(f"_all_{k}_{i}") for k in mine}
        out.append(own | {k: F.col(f"_{k}_{i}") for k in extra or {}})
    run = running_totals(df, score, sums, descending=True)
    return CellTotals(run.join(F.broadcast(df.agg(*whole))) if names else run.limit(0), out)


def leak_level_a(df: DataFrame, feature: str, label: str, chance: float = -6.0) -> DataFrame:
    """One row: share of rows at values with one label, the longest pure region at either end, its log10 chance.

    Missing values sort lowest. The verdict is BLOCK if a pure end is less likely than
    the bound by chance or every value has one label, else PASS.
    """
    low = F.lit(-1e18)
    d = df.select(F.coalesce(F.col(feature).cast("double"), low).alias("v"), F.col(label).cast("long").alias("y"))
    up = running_totals(d, "v", {"pos": F.col("y")})
    t = up.agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"), F.count("*").alias("values"))
    up = up.join(F.broadcast(t))
    pure = (F.col("pos") == 0) | (F.col("pos") == F.col("n"))
    end = F.lit(0)
    for n, p in (
        (F.col("cum_n"), F.col("cum_pos")),
        (F.col("_n") - F.col("cum_n") + F.col("n"), F.col("_p") - F.col("cum_pos") + F.col("pos")),
    ):
        end = F.greatest(end, F.when((p == 0) | (p == n), n).otherwise(0))
    out = up.agg(
        F.max("_n").alias("n"),
        F.max("_p").alias("p"),
        F.max("values").alias("values"),
        F.sum(F.when(pure, F.col("n")).otherwise(0)).alias("_pure"),
        F.max(end).alias("pure_end"),
    )
    share = F.greatest(F.col("p"), F.col("n") - F.col("p")) / F.col("n")
    out = out.select("n", "values", (F.col("_pure") / F.col("n")).alias("determined"), "pure_end", (F.col("pure_end") * F.log10(share)).alias("log10_chance"))
    return out.withColumn("verdict", F.when((F.col("log10_chance") < chance) | (F.col("determined") == 1), "BLOCK").otherwise("PASS"))


def benjamini_hochberg(df: DataFrame, p: str, identity: str) -> DataFrame:
    """``df``'s rows that have a p-value, with ``q_value``: the least of p n / rank over it and all larger p-values, at most 1.

    Ranks come from running totals (tests of one p-value share the last rank of them)
    and the least of what follows from ranges, so a table of any number of tests is
    many tasks. ``identity`` is not needed to break ties.
    """
    run = running_totals(df, p, {}).select(F.col(p).alias("_p"), "cum_n")
    total = run.agg(F.max("cum_n").alias("_n"))
    raw = run.join(F.broadcast(total)).select("_p", (F.col("_p") * F.col("_n") / F.col("cum_n")).alias("_raw"))
    ranged = with_range(written(raw, "q-values"), "_p", [])
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    after = ranged.groupBy("_range").agg(F.min("_raw").alias("_least")).select("_range", F.min("_least").over(later).alias("_after"))
    inside = F.min("_raw").over(Window.partitionBy("_range").orderBy(F.desc("_p")))
    q = ranged.withColumn("_q", inside).join(F.broadcast(after), "_range").select("_p", F.least("_q", "_after", F.lit(1.0)).alias("q_value"))
    return df.join(q, F.col(p) == F.col("_p")).drop("_p")


def frontier(df: DataFrame, score: str, good: str, targets: list[float]) -> DataFrame:
    """Per target retention of good rows: the cut under which (strictly) rows are rejected, and what that costs.

    The cut is the good rows' order statistic at floor((1 - t) n + 1e-12), counted
    from 0; with a budget of 0 nothing is rejected (cut NULL).
    """
    g = df.filter(F.col(good) & F.col(score).isNotNull())
    run = running_totals(g, score, {})
    total = g.count()
    wanted = [(t, int((1 - t) * total + 1e-12)) for t in targets]
    ask = df.sparkSession.createDataFrame(wanted, "target double, k long")  # as many rows as targets
    cuts = run.join(F.broadcast(ask), (F.col("cum_n") > F.col("k")) & (F.col("k") > 0)).groupBy("target", "k").agg(F.min(score).alias("cut"))
    cuts = ask.join(cuts.select("target", "cut"), "target", "left")
    sums = [F.sum((F.col(score) < F.col("cut")).cast("long")).alias("rejected"), F.sum((F.col(good) & (F.col(score) < F.col("cut"))).cast("long")).alias("good_rejected")]
    return df.filter(F.col(score).isNotNull()).join(F.broadcast(cuts)).groupBy("target", "cut").agg(*[F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, ("rejected", "good_rejected"))])


def queue_sweep(df: DataFrame, score: str, good: str, cuts: list[float]) -> DataFrame:
    """Per cut: rows kept (score at or over it), good rows kept; one pass."""
    aggs = []
    for i, x in enumerate(cuts):
        aggs += [F.sum((F.col(score) >= x).cast("long")).alias(f"k{i}"), F.sum(((F.col(score) >= x) & F.col(good)).cast("long")).alias(f"g{i}")]
    rows = F.array(*[F.struct(F.lit(float(x)).alias("cut"), F.col(f"k{i}").alias("kept"), F.col(f"g{i}").alias("good_kept")) for i, x in enumerate(cuts)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def top_fraction(df: DataFrame, score: str, identity: str, fraction: float) -> DataFrame:
    """The ceil(f n) rows of the highest score, ties by identity; only the rows at the cut are ordered."""
    some = df.filter(F.col(score).isNotNull())
    n = some.count()
    k = -(-int(round(n * fraction * 1e9)) // 10**9)
    run = running_totals(some, score, {}, descending=True)
    # The value at which the k-th row lies, and how many rows are over it: one row.
    cut = run.filter((F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k)).select(score, (F.col("cum_n") - F.col("n")).alias("over")).first()
    if cut is None:
        return some if k > 0 else some.limit(0)
    ties = some.filter(F.col(score) == F.lit(cut[0])).orderBy(identity).limit(k - cut[1])
    return some.filter(F.col(score) > F.lit(cut[0])).union(ties)


def top_rows(df: DataFrame, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows by (column, descending) in turn, nulls last: a report of bounded length."""
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]).limit(n)


def seeded_sample(df: DataFrame, identity: str, n: int, seed: int) -> DataFrame:
    """n rows by the order of md5(seed:identity): the same rows wherever they lie."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string")).cast("binary"))
    return df.orderBy(h, identity).limit(n)


def first_qualifying(df: DataFrame, ok: Column, order: list[str], n: int) -> DataFrame:
    """The first n rows that qualify, by an order that ends in a unique column."""
    return df.filter(F.coalesce(ok, F.lit(False))).orderBy(*order).limit(n)
