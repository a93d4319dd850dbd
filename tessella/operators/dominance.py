"""Sums over the rows of a group that lie under others in two numbers at once, without making a pair.

Points and questions are dealt twice. By the first number in ranges: a range's task
answers for its own points. By the second number in ranges: a range's task answers
for points of lower ranges of the first. Points in lower ranges of both come from a
table of sums by range and range. Both tasks sort and merge, so a group of n rows
costs n log n and is as many tasks as it has ranges. Bounds are quantiles of the
group's points; equal points are one with a count, and points that share a number lie in one range of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import ship, written

SPAN = 65_536  # points of a group in a range, about


def below(points_at: np.ndarray, points_n: np.ndarray, points_y: np.ndarray, asked_at: np.ndarray, asked_y: np.ndarray) -> np.ndarray:
    """For each question the sum of n over points with at < its at and y < its y; ranks by bits of y, a pass a bit."""
    out = np.zeros(len(asked_at), np.int64)
    if not len(points_at) or not len(asked_at):
        return out
    values = np.unique(points_y)
    rank, asked = np.searchsorted(values, points_y), np.searchsorted(values, asked_y)
    # All in one order of the first number: questions before points of an equal one.
    at, question = np.concatenate([asked_at, points_at]), np.concatenate([np.ones(len(asked_at), bool), np.zeros(len(points_at), bool)])
    order = np.lexsort((~question, at))
    y = np.concatenate([asked, rank])[order]
    n = np.where(question, 0, np.concatenate([np.zeros(len(asked_at), np.int64), points_n]))[order]
    asks, bits = question[order], int(len(values)).bit_length()
    got = np.zeros(len(y), np.int64)
    index = np.arange(len(y))
    for bit in range(bits - 1, -1, -1):
        # Within rows of equal higher bits, a question whose bit is 1 lies over all points before it whose bit is 0.
        one = (y >> bit & 1).astype(bool)
        low = np.cumsum(np.where(one, 0, n))
        top = y >> (bit + 1)
        first = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(top) else np.zeros(0, np.int64)
        base = np.repeat(np.append(0, low)[first], np.diff(np.append(first, len(top))))
        hit = asks & one
        got[index[hit]] += (low - base)[hit]
        # Stable: the next bit's rows lie together, still in the order of the first number.
        step = np.argsort(y >> bit, kind="stable")
        y, n, asks, index = y[step], n[step], asks[step], index[step]
    placed = np.zeros(len(order), np.int64)
    placed[order] = got
    return placed[: len(asked_at)]


def _answers(own: str, by: list[str]):
    """Sums by tag of one range's questions; dealt by the second number, of points whose first range is lower."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        n = col("n")
        point, x, y = n > 0, col("x") if own == "x" else col("rx").astype(float), col("y")
        q = ~point
        found = below(x[point], n[point], y[point], x[q], y[q])
        tag = col("tag")[q]
        tags = np.unique(tag)
        sums = np.zeros(len(tags), np.int64)
        np.add.at(sums, np.searchsorted(tags, tag), found)
        keys = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(tags), np.int64))) for c in by]
        return pa.table([*keys, pa.array(tags, pa.int32()), pa.array(sums)], [*by, "tag", "m"])

    return run


def _grid(by: list[str]):
    """Per range and range with questions: the points in lower ranges of both. A group has as many rows as ranges of both at most."""

    def run(table: pa.Table) -> pa.Table:
        rx, ry, n, asks = (table.column(c).to_numpy() for c in ("rx", "ry", "n", "asks"))
        sums = np.zeros((rx.max() + 2, ry.max() + 2), np.int64)
        np.add.at(sums, (rx + 1, ry + 1), n)
        sums = sums.cumsum(0).cumsum(1)
        some = np.flatnonzero(asks)
        keys = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(some), np.int64))) for c in by]
        values = [pa.array(rx[some]), pa.array(ry[some]), pa.array(sums[rx[some], ry[some]])]
        return pa.table([*keys, *values], [*by, "rx", "ry", "m"])

    return run


def dominated(points: DataFrame, asked: DataFrame, by: list[str], span: int | None = None) -> DataFrame:
    """(by, tag, m): over the questions (by, tag, x, y) of a group and tag, the sum of n of its points (by, x, y, n) with smaller x and y.

    Groups without a question have no row; keys in ``by`` are not null. A range has
    about ``span`` points.
    """
    ship(points.sparkSession)
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    most = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = lambda c: F.percentile_approx(c, [i / most for i in range(1, most)], 100 * most)
    parts = F.least(F.lit(most), F.ceil(F.count("*") / (span or SPAN))).cast("int")
    bounds = points.groupBy(*by).agg(marks("x").alias("_bx"), marks("y").alias("_by"), parts.alias("_parts"))
    few = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.get(c, (i * most / F.col("_parts")).cast("int") - 1)))
    bounds = bounds.withColumns({c: F.when(F.col("_parts") > 1, few(F.col(c))).otherwise(F.array().cast("array<double>")) for c in ("_bx", "_by")})
    p = points.select(*by, F.lit(0).alias("tag"), "x", "y", F.col("n").cast("long").alias("n"))
    both = p.unionByName(asked.select(*by, F.col("tag").cast("int").alias("tag"), "x", "y", F.lit(0).cast("long").alias("n"))).join(bounds, by)
    rank = lambda v, b: F.size(F.filter(b, lambda t: t <= F.col(v)))
    both = both.select(*by, "tag", "x", "y", "n", rank("x", F.col("_bx")).alias("rx"), rank("y", F.col("_by")).alias("ry"), (F.col("_parts") > 1).alias("several"))
    both = written(both, "dominance")
    out = both.drop("several", "ry").groupBy(*by, "rx").applyInArrow(_answers("x", by), f"{kinds}, tag int, m long")
    split = both.filter("several").drop("several")
    out = out.unionByName(split.groupBy(*by, "ry").applyInArrow(_answers("y", by), f"{kinds}, tag int, m long"))
    cells = split.groupBy(*by, "rx", "ry").agg(F.sum("n").alias("n"), F.max(F.col("n") == 0).alias("asks"))
    cells = cells.groupBy(*by).applyInArrow(_grid(by), f"{kinds}, rx int, ry int, m long")
    asks = split.filter("n = 0").groupBy(*by, "rx", "ry", "tag").agg(F.count("*").alias("q"))
    out = out.unionByName(asks.join(cells, [*by, "rx", "ry"]).select(*by, "tag", (F.col("q") * F.col("m")).alias("m")))
    return out.groupBy(*by, "tag").agg(F.sum("m").alias("m"))
