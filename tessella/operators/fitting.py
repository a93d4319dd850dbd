"""Pairwise logistic scores by Newton steps whose sums Spark makes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import manyfits
from tessella.operators.quantiles import quantile_lists
from tessella.operators.splits import crc_fold


@dataclass(frozen=True)
class Scaler:
    """Median imputation and standardisation frozen on one split (sample deviation)."""

    median: dict
    mean: dict
    deviation: dict

    def column(self, f: str) -> Column:
        return (F.coalesce(F.col(f), F.lit(self.median[f])) - self.mean[f]) / (self.deviation[f] or 1.0)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: self.column(f) for f in self.median})


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    med = {f: 0.0 if v is None else v[0] for f, v in quantile_lists(df, features, [0.5]).items()}
    filled = [F.coalesce(F.col(f), F.lit(med[f])) for f in features]
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(filled)]).first()
    return Scaler(med, {f: row[f"m{i}"] for i, f in enumerate(features)}, {f: row[f"s{i}"] or 1.0 for i, f in enumerate(features)})


def newton_logistic(df: DataFrame, features: list[str], label: str, weight: str, l2: float = 1e-6, steps: int = 25, tolerance: float = 1e-9) -> np.ndarray:
    """Minimises sum w log-loss + l2/2 |b|^2 without intercept; gradient and Hessian are one aggregate a step."""
    p = len(features)
    beta = np.zeros(p)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(steps):
        z = reduce(lambda a, b: a + b, [F.col(f) * float(b) for f, b in zip(features, beta)])
        mu = 1 / (1 + F.exp(-z))
        w = F.col(weight)
        aggs = [F.sum(w * (mu - F.col(label)) * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)]
        aggs += [F.sum(w * mu * (1 - mu) * F.col(features[i]) * F.col(features[j])).alias(f"h{i}_{j}") for i, j in pairs]
        r = df.agg(*aggs).first()
        if r["g0"] is None:
            return beta
        g = np.array([r[f"g{i}"] for i in range(p)]) + l2 * beta
        h = np.zeros((p, p))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.solve(h + l2 * np.eye(p), g)
        beta = beta - step
        if float(np.abs(step).max()) < tolerance:
            break
    return beta


def fit_pair_score(df: DataFrame, group: str, identity: str, target: str, features: list[str], l2: float = 1e-6) -> tuple[Scaler, np.ndarray]:
    """Scaler and coefficients of a pairwise logistic score; pairs are made in blocks, step by step, and kept nowhere."""
    scaler = fit_scaler(df, features)
    blocks = manyfits.pair_blocks(scaler.apply(df), group, identity, target, features)
    return scaler, manyfits.fit(blocks, np.array([l2]), steps=25, tolerance=1e-9)[0]


def score(scaler: Scaler, features: list[str], beta) -> Column:
    """Higher means a lower target is expected."""
    return reduce(lambda a, b: a + b, [scaler.column(f) * float(b) for f, b in zip(features, beta)])


def forward_selection(
    df: DataFrame, group: str, identity: str, target: str, features: list[str], most: int = 8, least_gain: float = 0.002, folds: int = 3
) -> list[tuple[str, float]]:
    """(feature, cross-validated group-equal accuracy) in the order taken; groups stay whole in a fold."""
    z = fit_scaler(df, features).apply(df)
    return manyfits.forward(z, group, identity, target, features, crc_fold(group, folds), folds, most, least_gain)
