"""Candidate rules from quantiles of a reference population, and searches over them.

Candidates are data (``Candidate``). Any number of them is judged from one histogram
of cells a table (``cells.rule_rates``); searches loop on the driver over outcomes
packed into bits (``masks``), one scan a step, and hold only candidates and rates there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.cells import rule_rates
from tessella.operators.masks import Bits, joint_counts, pack
from tessella.operators.quantiles import quantile_lists

BATCH = 300
#: Tail shares at which thresholds are taken.
ALPHAS = (0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10)
CENTRES = (0.99, 0.98, 0.97, 0.95, 0.90)
GUARD_QUANTILES = (0.25, 0.5, 0.75)


@dataclass(frozen=True)
class Candidate:
    """``side`` hi: feature <= upper; lo: feature >= lower; band: between. A guard makes it an implication."""

    feature: str
    side: str
    lower: float | None = None
    upper: float | None = None
    guard: str | None = None
    guard_side: str | None = None
    guard_threshold: float | None = None
    rates: dict = field(default_factory=dict, compare=False, hash=False)

    def passes(self) -> Column:
        v = F.col(self.feature)
        ok = F.lit(True)
        if self.lower is not None:
            ok = ok & (v >= self.lower)
        if self.upper is not None:
            ok = ok & (v <= self.upper)
        ok = F.coalesce(ok, F.lit(True))
        if self.guard is None:
            return ok
        g = F.col(self.guard)
        on = g > self.guard_threshold if self.guard_side == "hi" else g <= self.guard_threshold
        return F.coalesce(~on, F.lit(True)) | ok

    def applies(self) -> Column:
        g = F.col(self.guard)
        return g > self.guard_threshold if self.guard_side == "hi" else g <= self.guard_threshold

    @property
    def key(self) -> tuple:
        return (self.feature, self.side, self.lower, self.upper, self.guard, self.guard_side, self.guard_threshold)


def evaluate(df: DataFrame, expressions: list[Column]) -> list:
    """The values of aggregate expressions over the table, in batches."""
    out: list = []
    for i in range(0, len(expressions), BATCH):
        some = expressions[i : i + BATCH]
        out += list(df.agg(*[e.alias(f"x{j}") for j, e in enumerate(some)]).first())
    return out


def evaluate_by(df: DataFrame, by: str, expressions: list[Column]) -> dict:
    """Group -> the values of aggregate expressions over its rows; one grouped aggregate a batch, whatever the number of groups."""
    out: dict = {}
    for i in range(0, len(expressions), BATCH):
        some = expressions[i : i + BATCH]
        for r in df.groupBy(F.col(by).alias("_by")).agg(*[e.alias(f"x{j}") for j, e in enumerate(some)]).collect():
            out.setdefault(r["_by"], []).extend(r[f"x{j}"] for j in range(len(some)))
    return out


def distinct_by_effect(tables: list[DataFrame], candidates: list[Candidate], identity: str) -> list[Candidate]:
    """The first of the candidates that pass the same rows of every table.

    Masks are compared by the number of rows and two exclusive-or sums of 64-bit hashes
    of the rows that pass, so that none is stored or moved.
    """
    keys: list[tuple] = [()] * len(candidates)
    for df in tables:
        h = [F.xxhash64(identity, F.lit(seed)) for seed in (1, 2)]
        marks = [x for c in candidates for x in (F.count_if(c.passes()), *[F.bit_xor(F.when(c.passes(), y)) for y in h])]
        got = evaluate(df, marks)
        keys = [(*k, *got[3 * i : 3 * i + 3]) for i, k in enumerate(keys)]
    first: dict = {}
    for k, c in zip(keys, candidates):
        first.setdefault(k, c)
    return list(first.values())


def quantiles(df: DataFrame, features: list[str], qs: list[float]) -> dict[str, list | None]:
    return quantile_lists(df, features, list(qs)) if features else {}


def eligible_features(real: DataFrame, bad: DataFrame, features: list[str], least: float, exclude: set[str] = frozenset()) -> list[str]:
    """Features of enough coverage on both sides that are not constant on the reference."""
    features = [f for f in features if f not in exclude]
    share = lambda f: F.avg(F.col(f).isNotNull().cast("double"))
    r = evaluate(real, [x for f in features for x in (share(f), F.min(f) < F.max(f))])
    b = evaluate(bad, [share(f) for f in features])
    return [f for i, f in enumerate(features) if (r[2 * i] or 0) >= least and r[2 * i + 1] and (b[i] or 0) >= least - 0.05]


def one_sided(real: DataFrame, features: list[str], alphas=ALPHAS) -> list[Candidate]:
    """Thresholds fitted on the reference alone."""
    qs = sorted({*alphas, *[1 - a for a in alphas]})
    out = []
    for f, v in quantiles(real, features, qs).items():
        if v:
            at = dict(zip(qs, v))
            out += [Candidate(f, "hi", upper=at[1 - a]) for a in alphas] + [Candidate(f, "lo", lower=at[a]) for a in alphas]
    return distinct(out)


def bands(real: DataFrame, features: list[str], centres=CENTRES) -> list[Candidate]:
    qs = sorted({q for c in centres for q in ((1 - c) / 2, 1 - (1 - c) / 2)})
    out = []
    for f, v in quantiles(real, features, qs).items():
        if v:
            at = dict(zip(qs, v))
            out += [Candidate(f, "band", at[(1 - c) / 2], at[1 - (1 - c) / 2]) for c in centres]
    return distinct(out)


def guarded(
    real: DataFrame, targets: list[Candidate], guards: list[str], qs=GUARD_QUANTILES, applicable=(0.1, 0.9), bad: DataFrame | None = None, best: int | None = None, identity: str | None = None
) -> list[Candidate]:
    """Each target under each guard threshold and side that applies to a middle share of the reference.

    With ``bad``, targets are taken by their rejection of its rows, most first (then
    satisfaction and key), and of those only ``best`` if given; with ``identity``, of
    candidates that pass the same rows of both tables only the first stays.
    """
    if bad is not None:
        targets = judge(real, bad, targets)[:best]
    found = [
        (g, side, t)
        for g, v in quantiles(real, guards, list(qs)).items()
        for t in dict.fromkeys(v or [])
        for side in ("hi", "lo")
    ]
    probe = [Candidate("", "hi", guard=g, guard_side=s, guard_threshold=t) for g, s, t in found]
    shares = evaluate(real, [F.avg(F.coalesce(p.applies(), F.lit(False)).cast("double")) for p in probe])
    use = [x for x, s in zip(found, shares) if s is not None and applicable[0] < s < applicable[1]]
    found = distinct([Candidate(c.feature, c.side, c.lower, c.upper, g, s, t) for c in targets for g, s, t in use if g != c.feature])
    return distinct_by_effect([real] if bad is None else [real, bad], found, identity) if identity and found else found


def distinct(candidates: list[Candidate]) -> list[Candidate]:
    return list({c.key: c for c in candidates}.values())


def judge(real: DataFrame, bad: DataFrame, candidates: list[Candidate], satisfaction: float = 0.0, rejection: float = 0.0) -> list[Candidate]:
    """The candidates that pass both gates, with their rates, best rejection first; one scan a table, however many they are."""
    if not candidates:
        return []
    rules = catalogue(real.sparkSession, candidates).drop("satisfaction", "rejection")
    rates = {tuple(r)[:7]: (r["satisfaction"] or 0.0, r["rejection"] or 0.0) for r in rule_rates(real, bad, rules.distinct()).collect()}
    out = []
    for c in candidates:
        a, b = rates[c.key]
        if a >= satisfaction and b >= rejection:
            out.append(Candidate(*c.key, rates={"satisfaction": a, "rejection": b}))
    return sorted(out, key=lambda c: (-c.rates["rejection"], -c.rates["satisfaction"], str(c.key)))


def catalogue(spark, candidates: list[Candidate]) -> DataFrame:
    rows = [(*c.key, c.rates.get("satisfaction"), c.rates.get("rejection")) for c in candidates]
    schema = "feature string, side string, lower double, upper double, guard string, guard_side string, guard_threshold double, satisfaction double, rejection double"
    return spark.createDataFrame(rows, schema)


def all_pass(laws: list[Candidate]) -> Column:
    return reduce(lambda a, b: a & b, [c.passes() for c in laws], F.lit(True))


def greedy(
    real: DataFrame,
    bad: DataFrame,
    candidates: list[Candidate],
    floor: float = 0.81,
    steps: int = 4,
    least_gain: float = 0.005,
    killed: DataFrame | None = None,
) -> list[tuple[Candidate, float, float]]:
    """(law, joint satisfaction, joint exclusion) step by step.

    Each step takes the law with the largest gain that keeps the joint satisfaction
    at the floor. With ``killed`` (good rows that must not be lost) the gain is
    exclusion of bad rows minus that of those. Outcomes are packed into bits once a
    table; a step is one scan of those.
    """
    passes = [c.passes() for c in candidates]
    good, wrong, lost_of = pack(real, passes), pack(bad, passes), pack(killed, passes) if killed is not None else None
    path, laws, joint, lost = [], (), 0.0, 0.0
    for _ in range(steps if candidates else 0):
        s, e = _shares(good, laws), [1 - x for x in _shares(wrong, laws)]
        k = [1 - x for x in _shares(lost_of, laws)] if lost_of else [0.0] * len(e)
        best = None
        for i, (c, a, b, d) in enumerate(zip(candidates, s, e, k)):
            gain = (b - joint) - (d - lost)
            if good.totals and a >= floor and c not in [candidates[j] for j in laws] and (best is None or (round(gain, 12), round(a, 12)) > (round(best[0], 12), round(best[2], 12))):
                best = (gain, i, a, b, d)
        if best is None or best[0] < least_gain:
            break
        _, i, a, joint, lost = best
        laws = (*laws, i)
        path.append((candidates[i], a, joint))
    return path


def _shares(bits: Bits, laws: tuple[int, ...]) -> list[float]:
    """Of each rule the share of rows that pass it and all of ``laws``; 1 for an empty table."""
    n = sum(bits.totals.values())
    return [x / n for x in sum(joint_counts(bits, [laws]).values())[0].tolist()] if n else [1.0] * bits.rules


def pareto_beam(
    real: DataFrame,
    bad: DataFrame,
    candidates: list[Candidate],
    kind: str,
    width: int = 8,
    depth: int = 3,
    floor: float = 0.9,
    stratum: str | None = None,
    stratum_floor: float = 0.0,
    least_gain: float = 0.0,
) -> list[dict]:
    """Rule sets found by a beam: half the width by rejection + half the least rejection of a kind, the rest by
    rejection per lost satisfaction. A feature is used once, candidates are added in index order; floors hold
    overall and, if asked, in every stratum of the reference."""
    passes = [c.passes() for c in candidates]
    good, wrong = pack(real, passes, F.col(stratum) if stratum else None), pack(bad, passes, F.col(kind))
    n_good, n_wrong = sum(good.totals.values()), sum(wrong.totals.values())
    floors = [k for k in good.totals if stratum and k is not None]
    beam: list[dict] = [{"laws": (), "satisfaction": 1.0, "rejection": 0.0}]
    kept: list[dict] = []
    for _ in range(depth if n_good and n_wrong else 0):
        sets = [d["laws"] for d in beam]
        g, w = joint_counts(good, sets), joint_counts(wrong, sets)
        all_good, all_wrong = sum(g.values()), sum(w.values())
        new = []
        for n, d in enumerate(beam):
            used = {candidates[j].feature for j in d["laws"]}
            for i in range((d["laws"][-1] + 1) if d["laws"] else 0, len(candidates)):
                if candidates[i].feature in used:
                    continue
                satisfaction, rejection = float(all_good[n, i] / n_good), float((n_wrong - all_wrong[n, i]) / n_wrong)
                if satisfaction < floor or any(g[k][n, i] / good.totals[k] < stratum_floor for k in floors) or rejection - d["rejection"] < least_gain:
                    continue
                worst = min((float((m - w[k][n, i]) / m) for k, m in wrong.totals.items() if k is not None), default=0.0)
                new.append({"laws": (*d["laws"], i), "satisfaction": satisfaction, "rejection": rejection, "worst_kind": worst})
        a = sorted(new, key=lambda d: (-round(d["rejection"] + 0.5 * d["worst_kind"], 12), d["laws"]))
        b = sorted(new, key=lambda d: (-round(d["rejection"] / max(1e-9, 1 - d["satisfaction"] + 1e-6), 9), d["laws"]))
        beam = list({d["laws"]: d for d in [*a[: width // 2], *b]}.values())[:width]
        kept += beam
        if not beam:
            break
    # the non-dominated sets
    return [
        d
        for d in kept
        if not any(
            (e["satisfaction"] >= d["satisfaction"] and e["rejection"] >= d["rejection"])
            and (e["satisfaction"] > d["satisfaction"] or e["rejection"] > d["rejection"])
            for e in kept
        )
    ]


def leave_one_kind_out(real: DataFrame, bad: DataFrame, kind: str, candidates: list[Candidate], **greedy_args) -> list[dict]:
    """For each kind: laws found without it, and how well they reject it."""
    out = []
    for k in sorted(r[0] for r in bad.select(kind).distinct().collect()):
        path = greedy(real, bad.filter(F.col(kind) != k), candidates, **greedy_args)
        held = evaluate(bad.filter(F.col(kind) == k), [F.avg((~all_pass([p[0] for p in path])).cast("double"))])[0]
        out.append({"kind": k, "laws": len(path), "held_out_rejection": held})
    return out


def interaction_features(features: list[str], least: float = 1e-9) -> dict[str, Column]:
    """Products and zero-guarded ratios of all pairs."""
    out = {}
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            out[f"{a}__x__{b}"] = F.col(a) * F.col(b)
            out[f"{a}__over__{b}"] = F.when(F.abs(b) >= least, F.col(a) / F.col(b))
    return out


def majority_body_rules(df: DataFrame, feature: str, label: str, thresholds: list[float], support: float = 0.005) -> DataFrame:
    """(threshold, op, n, body, hits): the most frequent class (the lowest of equals) in each one-sided region."""
    regions = F.array(
        *[F.when(F.col(feature) <= t, F.struct(F.lit(float(t)).alias("threshold"), F.lit("<=").alias("op"))) for t in thresholds],
        *[F.when(F.col(feature) > t, F.struct(F.lit(float(t)).alias("threshold"), F.lit(">").alias("op"))) for t in thresholds],
    )
    # Classes are counted per feature value before they meet the thresholds.
    by = df.groupBy(feature, label).agg(F.count("*").alias("m"))
    total = df.agg(F.count("*").alias("_n"))
    hit = by.select(label, "m", F.explode(F.filter(regions, lambda x: x.isNotNull())).alias("r")).groupBy("r", label).agg(F.sum("m").alias("m"))
    best = hit.groupBy("r").agg(F.sum("m").alias("n"), F.max(F.struct(F.col("m"), (-F.col(label).cast("long")).alias("neg"))).alias("b"))
    out = best.join(F.broadcast(total)).filter(F.col("n") >= support * F.col("_n"))
    return out.select("r.threshold", "r.op", "n", (-F.col("b.neg")).alias("body"), F.col("b.m").alias("hits"))
