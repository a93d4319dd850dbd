"""Scalar formulas as Columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """(lower, upper) Wilson score bounds of k successes in n; NULL for n = 0."""
    k, n = _c(k).cast("double"), F.nullif(_c(n).cast("double"), F.lit(0.0))
    p, zz = k / n, z * z
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (centre - half) / (1 + zz / n), (centre + half) / (1 + zz / n)


def ionicity(delta) -> Column:
    """1 - exp(-delta^2 / 4)."""
    d = _c(delta)
    return 1 - F.exp(-0.25 * d * d)


def radius_ratio_number(ratio) -> Column:
    """Coordination number that a cation/anion radius ratio allows (fixed geometric limits)."""
    r = _c(ratio)
    # Limits of the ideal polyhedra.
    return (
        F.when(r.isNull(), None).when(r < 0.155, 2).when(r < 0.225, 3).when(r < 0.414, 4).when(r < 0.732, 6).when(r < 1.0, 8).otherwise(12)
    )


def bond_valence(distance, r0, b=0.37) -> Column:
    """exp((R0 - d) / B)."""
    return F.exp((_c(r0) - _c(distance)) / (b if not isinstance(b, str) else F.col(b)))


def hinge(c, knot: float) -> Column:
    return F.greatest(_c(c) - knot, F.lit(0.0))


def clip_scaled(c, lo: float, hi: float, rising: bool = True) -> Column:
    """(c - lo) / (hi - lo) held to 0..1; falling: one minus it."""
    x = F.least(F.greatest((_c(c) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return x if rising else 1 - x


def quantise(c, grid: int) -> Column:
    return F.rint(_c(c) * grid) / grid


def scaled_round(c, digits: int) -> Column:
    """The scaled double's nearest integer, scaled back, as DuckDB rounds; F.round takes the shortest decimal that stands for the double, so ties part."""
    return F.round(_c(c) * 10.0**digits) / 10.0**digits


def joint(kind: str, *cols) -> Column:
    """min, mean, product, geometric or harmonic of several columns."""
    cols = [_c(c) for c in cols]
    n = len(cols)
    if kind == "min":
        return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cols]), None).otherwise(F.least(*cols))
    if kind == "mean":
        return reduce(lambda a, b: a + b, cols) / n
    product = reduce(lambda a, b: a * b, cols)
    if kind == "product":
        return product
    if kind == "geometric":
        return F.when(product >= 0, F.pow(product, 1.0 / n))
    if kind == "harmonic":
        ok = reduce(lambda a, b: a & b, [c > 0 for c in cols])
        return F.when(ok, n / reduce(lambda a, b: a + b, [1 / c for c in cols]))
    raise ValueError(f"unknown kind {kind!r}")


def guarded_ratio(a, b, least: float = 1e-9) -> Column:
    """a / b, missing where b is near zero."""
    return F.when(F.abs(_c(b)) >= least, _c(a) / _c(b))


def lower_inclusive_stratum(c, cuts: list[float]) -> Column:
    """How many cuts lie under the value; -1 if it is missing."""
    c = _c(c)
    return F.when(c.isNull(), -1).otherwise(reduce(lambda a, b: a + b, [(F.lit(x) < c).cast("int") for x in cuts], F.lit(0)))


def fixed_bins(c, edges: list[float]) -> Column:
    """Index of the half-open bin (edge, next edge]; NULL outside."""
    out, c = F.lit(None).cast("int"), _c(c)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((c > a) & (c <= b), i).otherwise(out)
    return out


# Binomial tails on the driver (no scientific library is assumed).


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz); work grows as the root of a and b."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    safe = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1 / safe(1 - (a + b) * x / (a + 1))
    out, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            out *= c * d
        if abs(c * d - 1) < 1e-15 or m > 100_000:
            return min(1.0, front * out)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k)."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    return incomplete_beta(n - k, k + 1, 1 - p)


def clopper_pearson_upper(k: int, n: int, confidence: float = 0.95) -> float:
    """One-sided upper bound: the p at which P(X <= k) falls to 1 - confidence."""
    if n <= 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > 1 - confidence else (lo, mid)
    return hi


def mcnemar_exact(b: int, c: int) -> float:
    """One-sided exact p that b of b + c discordant rows favour the rule by chance."""
    n = b + c
    return 1.0 if n == 0 else 1.0 - binomial_cdf(b - 1, n, 0.5)


def mcnemar_two_sided(b: int, c: int) -> float:
    """Two-sided exact p of b and c discordant rows."""
    return 1.0 if b + c == 0 or b == c else min(1.0, 2 * binomial_cdf(min(b, c), b + c, 0.5))


def mcnemar_clustered(b: int, c: int, design_effect: float) -> tuple[float, int, int]:
    """(p, smaller side, rows) with the discordant rows shrunk by a design effect first, which is conservative."""
    n = round((b + c) / design_effect)
    if n < 1:
        return 1.0, 0, 0
    k = min(round(min(b, c) / design_effect), n // 2)
    return mcnemar_two_sided(k, n - k), k, n


def bonferroni(p: float, declared: int) -> float:
    """p times the declared size of the family, at most 1."""
    return min(1.0, p * declared)


def born_repulsion(contact, distance, power: int = 9) -> Column:
    """(contact / distance)^power."""
    return F.pow(_c(contact) / _c(distance), power)


def short_range_repulsion(contact, distance, range_: float) -> Column:
    """exp((contact - distance) / range)."""
    return F.exp((_c(contact) - _c(distance)) / range_)
