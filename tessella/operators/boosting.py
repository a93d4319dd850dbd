"""Boosted histogram trees over grouped folds, and the joint ceiling of a set of features.

Features are cut into bins once (quantiles of all rows, label-free); rows of equal
bins, fold and label sums are one with a count. A tree grows level by level, and a
level is one grouped aggregate for the models of all folds at once: sums of
gradients, Hessians and rows by (model, node, feature, bin). Only these sums, which
hang on folds, nodes, features and bins alone, reach the driver, where the splits
are taken from their running sums; a tree goes back as expressions over the bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.cells import cell
from tessella.operators.quantiles import quantile_lists
from tessella.sources.scratch import written


@dataclass(frozen=True)
class Settings:
    rounds: int = 120
    depth: int = 4
    rate: float = 0.1
    leaf: int = 20  # least rows on each side of a split
    bins: int = 255
    penalty: float = 0.0
    least_hessian: float = 1e-3


@dataclass
class Split:
    feature: int
    bin: int  # rows of this bin and lower ones go left
    missing_left: bool


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> tuple[float, Split] | None:
    """The split of the largest gain from sums by (feature, bin); the last bin holds missing values.

    Of equal gains the first feature, then missing values to the right, then the lowest bin.
    """
    total = g.sum(1)[:, None], h.sum(1)[:, None], n.sum(1)[:, None]
    value = lambda a, b: a * a / np.maximum(b + s.penalty, 1e-300)
    best = None
    for missing_left in (False, True):
        left = [np.cumsum(x[:, :-1], 1) + (x[:, -1:] if missing_left else 0) for x in (g, h, n)]
        right = [t - x for t, x in zip(total, left)]
        ok = (left[2] >= s.leaf) & (right[2] >= s.leaf) & (left[1] >= s.least_hessian) & (right[1] >= s.least_hessian)
        gain = np.where(ok, value(left[0], left[1]) + value(right[0], right[1]) - value(*total[:2]), -np.inf)
        gain = np.round(gain, 9)
        i = int(np.argmax(gain))
        f, b = divmod(i, gain.shape[1])
        if gain[f, b] > 1e-9 and (best is None or (gain[f, b], -f, -missing_left, -b) > best[0]):
            best = (gain[f, b], -f, -missing_left, -b), Split(f, b, missing_left)
    return (float(best[0][0]), best[1]) if best else None


def leaf_value(g: float, h: float, s: Settings) -> float:
    return -s.rate * g / (h + s.penalty) if h + s.penalty > 0 else 0.0


def _binned(df: DataFrame, features: list[str], label: str, fold: Column, s: Settings) -> tuple[DataFrame, int]:
    """(fold, bins, n, p): equal rows counted together; bins 0.. and ``most`` for a missing value."""
    edges = quantile_lists(df, features, [i / s.bins for i in range(1, s.bins)])
    cut = {f: sorted(set(edges[f] or [])) for f in features}
    most = max([len(c) for c in cut.values()], default=0) + 1
    # A value at an edge lies in the bin under it.
    bin_of = lambda f: F.coalesce((cell(F.col(f"`{f}`"), cut[f]) / 2).cast("int"), F.lit(most))
    rows = df.filter(F.col(label).isNotNull()).select(fold.cast("int").alias("fold"), F.array(*[bin_of(f) for f in features]).alias("bins"), F.col(label).cast("long").alias("y"))
    rows = rows.filter("fold is not null").groupBy("fold", "bins").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return rows, most + 1


def _goes_left(split: Split, missing: int) -> Column:
    b = F.get("bins", F.lit(split.feature))
    return F.when(b == missing, F.lit(split.missing_left)).otherwise(b <= split.bin)


def _node(tree: dict[int, Split], at: int, missing: int, stop: int) -> Column:
    """The number of the node (root 1, children 2 i and 2 i + 1) that a row reaches in at most ``stop`` levels."""
    if at not in tree or stop == 0:
        return F.lit(at)
    return F.when(_goes_left(tree[at], missing), _node(tree, 2 * at, missing, stop - 1)).otherwise(_node(tree, 2 * at + 1, missing, stop - 1))


def fit_and_predict(df: DataFrame, features: list[str], label: str, fold: Column, folds: int, s: Settings = Settings()) -> DataFrame:
    """(fold, bins, n, p, score): log-odds of each row by the model of the other folds; rows of equal bins are one with counts.

    Labels are 0 or 1. The starting score is the log-odds of the training rows.
    """
    rows, width = _binned(df, features, label, fold, s)
    rows, missing = written(rows, "boosting-rows"), width - 1
    base = {r["fold"]: (r["n"], r["p"]) for r in rows.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()}
    n_all, p_all = (sum(x[i] for x in base.values()) for i in (0, 1))
    start = []
    for k in range(folds):
        n, p = n_all - base.get(k, (0, 0))[0], p_all - base.get(k, (0, 0))[1]
        share = min(max(p / n if n else 0.5, 1e-12), 1 - 1e-12)
        start.append(float(np.log(share / (1 - share))))
    scored = rows.withColumn("raw", F.array(*[F.lit(x) for x in start]))
    for _ in range(s.rounds):
        trees: list[dict[int, Split]] = [{} for _ in range(folds)]
        sums: dict[tuple[int, int], tuple[float, float]] = {}
        alive = {(k, 1) for k in range(folds)}
        for level in range(s.depth + 1):
            # Rows of the fold k are not the model k's; a row has one entry a model it trains.
            models = F.array(*[F.when(F.col("fold") != k, F.struct(F.lit(k).alias("k"), F.get("raw", F.lit(k)).alias("raw"), _node(trees[k], 1, missing, level).alias("node"))) for k in range(folds)])
            own = scored.select("bins", "n", "p", F.explode(F.filter(models, lambda x: x.isNotNull())).alias("m"))
            share = 1 / (1 + F.exp(-F.col("m.raw")))
            own = own.select("bins", "n", F.col("m.k").alias("k"), F.col("m.node").alias("node"), (F.col("n") * share - F.col("p")).alias("g"), (F.col("n") * share * (1 - share)).alias("h"))
            own = own.filter(F.col("node") >= 1 << level)
            if level == s.depth:  # leaves of full depth need no bins
                for r in own.groupBy("k", "node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                    sums[r["k"], r["node"]] = (r["g"], r["h"])
                break
            flat = own.select("k", "node", "n", "g", "h", F.posexplode("bins").alias("f", "b"))
            found = flat.groupBy("k", "node", "f", "b").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            grid: dict[tuple[int, int], np.ndarray] = {}
            for r in found:
                grid.setdefault((r["k"], r["node"]), np.zeros((3, len(features), width)))[:, r["f"], r["b"]] = r["g"], r["h"], r["n"]
            grown = set()
            for (k, node), x in grid.items():
                sums[k, node] = (float(x[0, 0].sum()), float(x[1, 0].sum()))
                if (k, node) in alive and (got := best_split(*x, s)):
                    trees[k][node] = got[1]
                    grown |= {(k, 2 * node), (k, 2 * node + 1)}
            alive = grown
            if not alive:
                break
        values = [_leaf_values(trees[k], {n: v for (m, n), v in sums.items() if m == k}, 1, missing, s) for k in range(folds)]
        scored = written(scored.withColumn("raw", F.array(*[F.get("raw", F.lit(k)) + v for k, v in enumerate(values)])), "boosting-scores")
    return scored.select("fold", "bins", "n", "p", F.get("raw", F.col("fold")).alias("score"))


def _leaf_values(tree: dict[int, Split], sums: dict, at: int, missing: int, s: Settings) -> Column:
    if at not in tree:
        return F.lit(leaf_value(*sums.get(at, (0.0, 0.0)), s))
    return F.when(_goes_left(tree[at], missing), _leaf_values(tree, sums, 2 * at, missing, s)).otherwise(_leaf_values(tree, sums, 2 * at + 1, missing, s))


def joint_ceiling(df: DataFrame, features: list[str], label: str, fold: Column, folds: int, s: Settings = Settings()) -> DataFrame:
    """One row: features, accuracy on held-out folds, that of the training majority, and the gain; means over folds.

    How much of the label the features tell together, which each alone may not.
    ``fold`` (0 to folds - 1) must keep rows of one group together.
    """
    p = fit_and_predict(df, features, label, fold, folds, s)
    per = p.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.when(F.col("score") > 0, F.col("p")).otherwise(F.col("n") - F.col("p"))).alias("right"))
    total = per.agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    one = 2 * (F.col("_p") - F.col("p")) >= F.col("_n") - F.col("n")
    per = per.join(F.broadcast(total)).select((F.col("right") / F.col("n")).alias("a"), (F.when(one, F.col("p")).otherwise(F.col("n") - F.col("p")) / F.col("n")).alias("m"))
    out = per.agg(F.avg("a").alias("cv_accuracy"), F.avg("m").alias("cv_majority"))
    return out.select(F.lit(len(features)).alias("features"), "cv_accuracy", "cv_majority", (F.col("cv_accuracy") - F.col("cv_majority")).alias("cv_gain"))
