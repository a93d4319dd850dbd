"""Many pairwise logistic models at once: folds, penalties, draws and feature sets, one pass a step for all of them.

Rows of a group are dealt in parts and every two parts meet in one block, a row of
bounded size with both parts' arrays; a group of any size is many blocks. A pair is
a difference inside a block and never a row. Each model has a weight on every group
(a fold, a bootstrap count) and may leave out rows (a subsample). A step takes the
gradients, Hessians and losses of all models from one pass over the blocks; only
these sums (models x features squared) reach the driver, where the steps are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.resampling import poisson_weight
from tessella.sources.scratch import ship, written

PART = 2048  # rows of a group on one side of a block
CHUNK = 1 << 16  # pairs held at once, which a core keeps near
RANGE = 600.0  # of scores, above which a ratio of their exponentials might not be a number


class Shape(NamedTuple):
    """How many models, features and columns of members (1 for all models), and the least gap of a pair's targets; what tasks need to know."""

    models: int
    features: int
    takes: int
    gap: float


class Blocks(NamedTuple):
    """``table``: a row per two parts of a group."""

    table: DataFrame
    shape: Shape

    @property
    def models(self) -> int:
        return self.shape.models

    @property
    def features(self) -> int:
        return self.shape.features


def pair_blocks(
    df: DataFrame,
    group: str,
    identity: str,
    target: str,
    features: list[str],
    gap: float = 0.0,
    weights: list[Column] | None = None,
    members: list[Column] | None = None,
    held: list[Column] | None = None,
) -> Blocks:
    """Blocks of the pairs of one group whose identities and targets differ (targets by ``gap`` or more).

    A list has a column a model: ``weights`` of the row's group in training,
    ``members`` whether the row takes part (else all do), ``held`` the weight of the
    group where the model is judged (else that in training). Rows without group,
    identity, target or feature are left out. A pair weighs the group's weight by the
    number of the model's pairs of the group, so that groups count alike.
    """
    ship(df.sparkSession)
    weights = weights or [F.lit(1.0)]
    array = lambda cs: F.array(*[c.cast("double") for c in cs])
    takes = F.array(*[(c.cast("double") != 0).cast("tinyint") for c in members or [F.lit(1.0)]])
    d = df.dropna(subset=[group, identity, target, *features])
    row = [F.xxhash64(identity).alias("id"), F.col(target).cast("double").alias("t"), array([F.col(f) for f in features]).alias("x"), takes.alias("m")]
    d = d.select(F.col(group).alias("g"), array(weights).alias("w"), array(held or weights).alias("h"), *row)
    # Of a group as much as its blocks need stays beside them, not beside rows.
    groups = d.groupBy("g").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.first("w").alias("w"), F.first("h").alias("h"))
    d = d.drop("w", "h").join(groups.select("g", "parts"), "g").withColumn("p", F.pmod(F.col("id"), F.col("parts")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = d.select("g", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).alias("right"), "id", "t", "x", "m")
    kind = blocks.schema["g"].dataType.simpleString()
    blocks = blocks.groupBy("g", "i", "j").applyInArrow(_packed, f"g {kind}, i int, j int, left binary, other binary")
    # Small row groups, so that a reader's batch of blocks is small.
    small = {"parquet.block.size": str(16 << 20)}
    shape = Shape(len(weights), len(features), len(members or [1]), gap)
    table = written(blocks, "pair-blocks", **small)
    # How many pairs of a group each model has.
    counts = table.select("g", "left", "other").mapInArrow(_counts(shape), f"g {kind}, m int, n double")
    counts = counts.groupBy("g", "m").agg(F.sum("n").alias("n")).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("m", "n"))).alias("c"))
    share = F.zip_with(F.col("w"), F.col("c.n"), lambda w, n: F.when(n > 0, w / n).otherwise(0.0))
    groups = groups.join(counts, "g").select("g", share.alias("w"), "h", F.col("c.n").alias("n"))
    return Blocks(written(table.join(groups, "g"), "weighted-blocks", **small), shape)


def _packed(table: pa.Table) -> pa.Table:
    """A block's rows as one row with both sides' arrays, each in the order of targets; without a right side both are the left."""
    col = lambda c: table.column(c).combine_chunks()
    right, ids, t = (col(c).to_numpy(zero_copy_only=False) for c in ("right", "id", "t"))
    x, m = (col(c).flatten().to_numpy().reshape(len(ids), -1) for c in ("x", "m"))
    sides = []
    for side in (~right, right):
        at = np.flatnonzero(side)
        at = at[np.lexsort((ids[at], t[at]))]
        sides.append(b"".join(np.ascontiguousarray(v[at]).tobytes() for v in (t, ids, x, m)))
    keys = [table.column(c).slice(0, 1).combine_chunks() for c in ("g", "i", "j")]
    # A block of two parts without rows of the second has no pairs.
    if keys[1] != keys[2] and not right.any():
        sides[0] = b""
    return pa.table([*keys, *[pa.array([v], pa.binary()) for v in sides]], ["g", "i", "j", "left", "other"])


def _side(data: bytes, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(targets, ids, features, members) of one side."""
    p, width = shape.features, 16 + 8 * shape.features + shape.takes
    n = len(data) // width
    t, ids = np.frombuffer(data, "<f8", n), np.frombuffer(data, "<i8", n, 8 * n)
    x, m = np.frombuffer(data, "<f8", n * p, 16 * n), np.frombuffer(data, "i1", n * shape.takes, (16 + 8 * p) * n)
    return t, ids, x.reshape(n, p), m.reshape(n, shape.takes).astype(float)


def _each(batch: pa.RecordBatch, shape: Shape):
    """(row number, x and members of some left rows, those of the right ones, which of them are pairs, which have the lower target on the left)."""
    left, other = (batch.column(batch.schema.get_field_index(c)) for c in ("left", "other"))
    for r in range(batch.num_rows):
        a, b = left[r].as_py(), other[r].as_py()
        t, ids, x, m = _side(a, shape)
        u, jds, v, k = _side(b, shape) if b else (t, ids, x, m)
        at = 0
        while at < len(t):
            start = 0 if b else at  # inside a part each pair once
            end = at + max(1, CHUNK // max(1, len(u) - start))
            gap = t[at:end, None] - u[start:]
            ok = (gap != 0) & (ids[at:end, None] != jds[start:])
            if shape.gap > 0:
                ok &= np.abs(gap) >= shape.gap
            if not b:
                ok &= np.arange(len(t))[at:end, None] < np.arange(start, len(u))
            if ok.any():
                yield r, x[at:end], m[at:end], v[start:], k[start:], ok, gap < 0
            at = end


def _scores(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Sums feature by feature, so that equal rows have equal scores."""
    out = np.zeros(len(x))
    for f in np.flatnonzero(beta):
        out += x[:, f] * beta[f]
    return out


def _members(m: np.ndarray, k: int) -> np.ndarray:
    return m[:, k if m.shape[1] > 1 else 0]


def _lists(batch: pa.RecordBatch, name: str, r: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).slice(r, 1).flatten().to_numpy()


def _counts(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((batch.num_rows, shape.models))
            for r, _, m, _, k, ok, _ in _each(batch, shape):
                n[r] += (m * (ok.astype(float) @ k)).sum(0)
            groups = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), shape.models)))
            yield pa.RecordBatch.from_arrays([groups, pa.array(np.tile(np.arange(shape.models, dtype=np.int32), batch.num_rows)), pa.array(n.reshape(-1))], ["g", "m", "n"])

    return run


def _curves(s: np.ndarray, o: np.ndarray, ok: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-losses, slopes, curvatures) of the pairs of scores s and o, 0 where there is none."""
    low, high = min(s.min(), o.min()), max(s.max(), o.max())
    if high - low > RANGE:
        z = s[:, None] - o
        loss = np.logaddexp(0, z) - lower * z
        e = np.exp(-np.abs(z))
        mu = np.where(z > 0, 1, e) / (1 + e)
        curve = e / (1 + e) ** 2
    else:
        mid = (low + high) / 2
        ratio = np.exp(mid - s)[:, None] * np.exp(o - mid)
        mu = 1 + ratio
        np.reciprocal(mu, out=mu)
        ratio *= mu  # one less mu
        loss = np.where(lower, mu, ratio)
        np.log(loss, out=loss)
        np.negative(loss, out=loss)
        curve = ratio
        curve *= mu
    mu -= lower
    for v in (loss, mu, curve):
        v *= ok
    return loss, mu, curve


def step_sums(blocks: Blocks, beta: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(losses, gradients, Hessians) of the active models (else of all) at ``beta`` (model, feature), from one pass."""
    models, p = beta.shape
    width, shape = 1 + p + p * p, blocks.shape
    active = np.ones(models, bool) if active is None else active

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((models, width))
        for batch in batches:
            weight = {r: _lists(batch, "w", r) for r in range(batch.num_rows)}
            for r, x, m, v, n, ok, lower in _each(batch, shape):
                for k in np.flatnonzero(active & (weight[r] != 0)):
                    a, b = _members(m, k), _members(n, k)
                    # Rows that do not take part are left out, where they are many.
                    i, j = (np.flatnonzero(c) if c.mean() < 0.9 else slice(None) for c in (a, b))
                    xk, vk, a, b = x[i], v[j], a[i], b[j]
                    if not (len(xk) and len(vk)):
                        continue
                    loss, mu, curve = _curves(_scores(xk, beta[k]), _scores(vk, beta[k]), ok[i][:, j], lower[i][:, j])
                    cross = xk.T @ ((a[:, None] * (curve @ (b[:, None] * vk))))
                    rows, columns = a * (curve @ b), b * (a @ curve)
                    h = (xk.T * rows) @ xk + (vk.T * columns) @ vk - cross - cross.T
                    g = xk.T @ (a * (mu @ b)) - vk.T @ (b * (a @ mu))
                    sums[k] += weight[r][k] * np.concatenate([[a @ loss @ b], g, h.reshape(-1)])
        k, c = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sums[k, c])], ["k", "c", "v"])

    out = np.zeros((models, width))
    for r in blocks.table.select("w", "left", "other").mapInArrow(run, "k int, c int, v double").groupBy("k", "c").agg(F.sum("v").alias("v")).collect():
        out[r["k"], r["c"]] = r["v"]
    return out[:, 0], out[:, 1 : 1 + p], out[:, 1 + p :].reshape(models, p, p)


def _lasso_step(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: float, free: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The minimum of g d + d h d / 2 + l1 |b + d| over the free coordinates, by coordinate descent."""
    new = b.copy()
    for _ in range(rounds):
        moved = 0.0
        for i in np.flatnonzero(free):
            if h[i, i] <= 0:
                continue
            slope = g[i] + h[i] @ (new - b)
            v = new[i] - slope / h[i, i]
            v = np.sign(v) * max(abs(v) - l1 / h[i, i], 0.0)
            moved = max(moved, abs(v - new[i]))
            new[i] = v
        if moved < 1e-12:
            break
    return new


def fit(blocks: Blocks, l2: np.ndarray, l1: np.ndarray | None = None, free: np.ndarray | None = None, steps: int = 50, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients (model, feature) that minimise sum w log-loss + l2 |b|^2 / 2 + l1 |b|, without intercept.

    ``free`` (model, feature) says which coefficients may differ from 0. Newton steps,
    with coordinate descent where there is an l1 term; a step that does not lower a
    model's objective is halved.
    """
    models, p = blocks.models, blocks.features
    l1 = np.zeros(models) if l1 is None else np.asarray(l1, float)
    free = np.ones((models, p), bool) if free is None else free
    beta, before, tried = np.zeros((models, p)), np.full(models, np.inf), np.zeros((models, p))
    done = np.zeros(models, bool)
    for _ in range(steps):
        loss, g, h = step_sums(blocks, tried, ~done)
        value = loss + l2 * (tried**2).sum(1) / 2 + l1 * np.abs(tried).sum(1)
        new = tried.copy()
        for k in np.flatnonzero(~done):
            if value[k] > before[k] + 1e-12 * max(1.0, abs(before[k])):
                new[k] = (beta[k] + tried[k]) / 2
                done[k] = np.abs(new[k] - beta[k]).max(initial=0) < tolerance
                continue
            beta[k], before[k] = tried[k], value[k]
            gk, hk, f = g[k] + l2[k] * beta[k], h[k] + l2[k] * np.eye(p), free[k]
            if l1[k] > 0:
                new[k] = _lasso_step(gk, hk, beta[k], l1[k], f)
            else:
                move = np.zeros(p)
                move[f] = np.linalg.lstsq(hk[np.ix_(f, f)], gk[f], rcond=None)[0]
                new[k] = beta[k] - move
            done[k] = np.abs(new[k] - beta[k]).max(initial=0) < tolerance
            if done[k]:
                beta[k] = new[k]
        if done.all():
            break
        tried = np.where(done[:, None], beta, new)
    return beta


def accuracies(blocks: Blocks, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group-equal accuracy, weight of the groups) of each model where it is judged.

    Right is a pair whose lower target scores higher, a tie one half; NaN without a pair.
    """
    models, shape = len(beta), blocks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right, seen = np.zeros((batch.num_rows, models)), np.zeros((batch.num_rows, models))
            held = np.array([_lists(batch, "h", r) for r in range(batch.num_rows)]).reshape(batch.num_rows, models)
            for r, x, m, v, n, ok, lower in _each(batch, shape):
                for k in np.flatnonzero(held[r] > 0):
                    s, o, a, b = _scores(x, beta[k])[:, None], _scores(v, beta[k]), _members(m, k), _members(n, k)
                    hit, tie = (s > o) == lower, s == o
                    good = np.where(tie, 0.5, hit) * ok
                    right[r, k] += a @ good @ b
                    seen[r, k] += a @ ok.astype(float) @ b
            groups = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), models)))
            yield pa.RecordBatch.from_arrays(
                [groups, pa.array(np.tile(np.arange(models, dtype=np.int32), batch.num_rows)), *[pa.array(v.reshape(-1)) for v in (held, right, seen)]], ["g", "m", "h", "right", "seen"]
            )

    kind = blocks.table.schema["g"].dataType.simpleString()
    per = blocks.table.select("g", "h", "left", "other").mapInArrow(run, f"g {kind}, m int, h double, right double, seen double")
    per = per.groupBy("g", "m").agg(F.first("h").alias("h"), (F.sum("right") / F.nullif(F.sum("seen"), F.lit(0.0))).alias("a")).filter("a is not null and h > 0")
    out, weight = np.full(models, np.nan), np.zeros(models)
    for r in per.groupBy("m").agg((F.sum(F.col("h") * F.col("a")) / F.sum("h")).alias("a"), F.sum("h").alias("h")).collect():
        out[r["m"]], weight[r["m"]] = r["a"], r["h"]
    return out, weight


class Choice(NamedTuple):
    """A grid point with its inner scores, and for the outer fold the coefficients and held-out accuracy."""

    fold: int
    c: float
    terms: int
    mean: float
    spread: float
    accuracy: float
    coefficients: dict


def top_terms(beta: np.ndarray, terms: int) -> np.ndarray:
    """Which of the coefficients are among the ``terms`` largest that are not 0."""
    order = [i for i in np.argsort(-np.abs(beta), kind="stable") if abs(beta[i]) > 1e-10]
    out = np.zeros(len(beta), bool)
    out[order[:terms]] = True
    return out


def sparse_fits(blocks: Blocks, cs: np.ndarray, terms: list[int], refit_c: float = 100.0) -> dict[int, np.ndarray]:
    """Number of terms -> refitted coefficients of all models: an L1 selector with C = ``cs``, its largest terms refitted with L2.

    A model whose selector keeps nothing has NaN coefficients.
    """
    chosen = fit(blocks, np.zeros(blocks.models), 1 / cs)
    empty = np.abs(chosen).max(1) <= 1e-10
    out = {}
    for k in sorted(set(terms)):
        out[k] = fit(blocks, np.full(blocks.models, 1 / refit_c), free=np.stack([top_terms(b, k) for b in chosen]))
        out[k][empty] = np.nan
    return out


def nested_selection(df: DataFrame, group: str, identity: str, target: str, features: list[str], fold: Column, folds: int, inner: Column, inner_folds: int, cs: list[float], terms: list[int], gap: float = 0.0) -> list[Choice]:
    """Per outer fold the best (C, number of terms) by inner folds, and how it does on the outer fold.

    The best has the highest mean inner accuracy, then the least deviation, the fewest
    terms, the smallest C. All outer and inner folds and all C are fitted together:
    a step is one pass for outer x inner x C models. ``fold`` and ``inner`` keep groups whole.
    """
    keys = [(o, i, c) for o in range(folds) for i in range(inner_folds) for c in cs]
    within = lambda o, i, same: ((fold != o) & ((inner == i) if same else (inner != i))).cast("double")
    blocks = pair_blocks(df, group, identity, target, features, gap, [within(o, i, False) for o, i, _ in keys], None, [within(o, i, True) for o, i, _ in keys])
    seen: dict = {}
    for k, beta in sparse_fits(blocks, np.array([c for *_, c in keys]), terms).items():
        got, _ = accuracies(blocks, np.nan_to_num(beta))
        for (o, i, c), a, b in zip(keys, got, beta):
            if not (np.isnan(a) or np.isnan(b).any()):
                seen.setdefault((o, c, k), []).append(float(a))
    best = {}
    for o in range(folds):
        full = [(float(np.mean(a)), -float(np.std(a)), -k, -c) for (f, c, k), a in seen.items() if f == o and len(a) == inner_folds]
        if full:
            best[o] = max(full)
    if not best:
        return []
    outer = sorted(best)
    blocks = pair_blocks(df, group, identity, target, features, gap, [(fold != o).cast("double") for o in outer], None, [(fold == o).cast("double") for o in outer])
    fits = sparse_fits(blocks, np.array([-best[o][3] for o in outer]), [-best[o][2] for o in outer])
    beta = np.stack([fits[-best[o][2]][i] for i, o in enumerate(outer)])
    got, _ = accuracies(blocks, np.nan_to_num(beta))
    return [
        Choice(o, -best[o][3], -best[o][2], best[o][0], -best[o][1], float(a), {f: float(v) for f, v in zip(features, b) if v != 0})
        for o, a, b in zip(outer, got, beta)
    ]


def forward(df: DataFrame, group: str, identity: str, target: str, features: list[str], fold: Column, folds: int, most: int = 8, least_gain: float = 0.002, l2: float = 1e-6) -> list[tuple[str, float]]:
    """(feature, held-out accuracy, all groups alike) in the order taken: each step fits all remaining features in all folds together."""
    chosen: list[tuple[str, float]] = []
    while len(chosen) < min(most, len(features)):
        taken = [c for c, _ in chosen]
        rest = [f for f in features if f not in taken]
        keys = [(f, k) for f in rest for k in range(folds)]
        blocks = pair_blocks(df, group, identity, target, features, 0.0, [(fold != k).cast("double") for _, k in keys], None, [(fold == k).cast("double") for _, k in keys])
        free = np.array([[g == f or g in taken for g in features] for f, _ in keys])
        got, weight = accuracies(blocks, fit(blocks, np.full(len(keys), l2), free=free, steps=8))
        right, seen = dict.fromkeys(rest, 0.0), dict.fromkeys(rest, 0.0)
        for (f, _), a, w in zip(keys, got, weight):
            right[f], seen[f] = right[f] + (a * w if w else 0.0), seen[f] + w
        scores = {f: right[f] / seen[f] for f in rest if seen[f]}
        best = max(scores, key=lambda f: (scores[f], -features.index(f)), default=None)
        if best is None or (chosen and scores[best] - chosen[-1][1] < least_gain):
            break
        chosen.append((best, scores[best]))
    return chosen


def refits(df: DataFrame, group: str, identity: str, target: str, features: list[str], fractions: list[float] = (), draws: int = 20, bootstrap: int = 0, seed: int = 7, l2: float = 1e-6) -> list[dict]:
    """Refits of fixed terms: on subsamples of rows (by hash, without replacement) and on groups drawn with Poisson counts.

    First the fit of all rows; a draw has its coefficients, their cosine with that fit's
    and the accuracy on all pairs. All draws are fitted together.
    """
    u = lambda r: F.pmod(F.xxhash64(F.col(identity), F.lit(r), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    kinds = [("all", None, 0)] + [("subsample", f, d) for f in fractions for d in range(draws)] + [("bootstrap", None, b) for b in range(bootstrap)]
    members = [(u(n) < f).cast("double") if k == "subsample" else F.lit(1.0) for n, (k, f, _) in enumerate(kinds)]
    weights = [poisson_weight(F.col(group), F.lit(b), seed).cast("double") if k == "bootstrap" else F.lit(1.0) for k, _, b in kinds]
    blocks = pair_blocks(df, group, identity, target, features, 0.0, weights, members)
    beta = fit(blocks, np.full(len(kinds), l2))
    everything = pair_blocks(df, group, identity, target, features, 0.0, [F.lit(1.0)] * len(kinds))
    got, _ = accuracies(everything, beta)
    cosine = lambda b: float(b @ beta[0] / max(np.linalg.norm(b) * np.linalg.norm(beta[0]), 1e-300))
    return [{"kind": k, "fraction": f, "draw": d, "coefficients": b.tolist(), "cosine": cosine(b), "accuracy": float(a)} for (k, f, d), b, a in zip(kinds, beta, got)]


def paired_bootstrap(per_group: DataFrame, group: str, a: str, b: str, replicates: int = 2000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row (difference, lower, upper, groups): the mean of a - b over groups with both, groups drawn with Poisson counts."""
    both = per_group.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(group, (F.col(a) - F.col(b)).alias("_d"))
    whole = both.agg(F.avg("_d").alias("difference"), F.count("*").alias("groups"))
    drawn = both.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", poisson_weight(F.col(group), F.col("_r"), seed))
    reps = drawn.groupBy("_r").agg((F.sum(F.col("_d") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_v"))
    lo = (1 - level) / 2
    ci = reps.agg(F.percentile("_v", [lo, 1 - lo]).alias("_q"))
    return whole.join(F.broadcast(ci)).select("difference", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"), "groups")
