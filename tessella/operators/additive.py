"""Search for sparse additive scores: single terms, then pairs and triples of the best, with weights from a grid.

A candidate's score is the weighted sum of its terms' risks, missing where any is
missing. All candidates of a stage are judged together: scores are stacked under the
candidate's number and one running total keyed by it gives every candidate's rows,
severe and protected rows at or over every cut, hence its AUC and its best cut. Only
a row a candidate reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import wilson
from tessella.operators.running import running_totals

BATCH = 500  # candidates stacked in one pass


@dataclass(frozen=True)
class Term:
    """``risk``: higher is worse, NULL without support; terms of one ``group`` measure alike."""

    id: str
    group: str
    risk: Column


@dataclass(frozen=True)
class Found:
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    auc: float | None
    threshold: float | None
    rejected: int
    severe: int
    precision_lower: float
    protected_kept_lower: float
    coverage: float

    @property
    def key(self) -> str:
        return "+".join(f"{w:g}*{t}" for t, w in zip(self.terms, self.weights))

    def rank(self) -> tuple:
        """What is better comes first; of equals the smaller formula."""
        cut = self.threshold is not None
        return (-cut, -self.severe if cut else 0, -round(self.precision_lower, 9), -round(self.auc if self.auc is not None else -1.0, 9), len(self.terms), self.key)


def judge_scores(df: DataFrame, terms: list[Term], specs: list[tuple[tuple[int, ...], tuple[float, ...]]], severe: Column, protected: Column, precision: float, kept: float) -> list[Found]:
    """Every candidate's AUC (severe over protected rows, ties one half) and best admissible cut.

    Rows at or over a cut are rejected. A cut is admissible if the Wilson bounds of
    severe among rejected severe and protected rows, and of protected rows kept, reach
    ``precision`` and ``kept``; the best rejects most severe rows, then has the higher
    precision bound, then the higher cut.
    """
    used = sorted({i for s, _ in specs for i in s})
    risk = {i: f"r{i}" for i in used}
    rows = df.select(*[terms[i].risk.cast("double").alias(risk[i]) for i in used], F.coalesce(severe, F.lit(False)).cast("long").alias("s"), F.coalesce(protected, F.lit(False)).cast("long").alias("p"))
    total = rows.agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))).first()
    out: list[Found] = []
    for a in range(0, len(specs), BATCH):
        some = specs[a : a + BATCH]
        value = lambda s, w: sum((F.col(risk[i]) * float(x) for i, x in zip(s[1:], w[1:])), F.col(risk[s[0]]) * float(w[0]))
        stacked = F.explode(F.array(*[F.struct(F.lit(a + k).alias("k"), value(s, w).alias("v")) for k, (s, w) in enumerate(some)])).alias("x")
        long = rows.select("s", "p", stacked).select("s", "p", "x.k", "x.v")
        run = running_totals(long, "v", {"s": F.col("s"), "p": F.col("p")}, ["k"], descending=True)
        # A severe row loses to the protected rows over it, and by half to those at its score.
        per = run.groupBy("k").agg(
            F.sum("n").alias("n"),
            F.sum("s").alias("ts"),
            F.sum("p").alias("tp"),
            F.sum(F.col("s") * (F.col("cum_p") - F.col("p") / 2)).alias("lost"),
        )
        low = wilson("cum_s", F.col("cum_s") + F.col("cum_p"))[0]
        saved = wilson(F.lit(total[2]) - F.col("cum_p"), F.lit(total[2]))[0]
        cuts = run.withColumns({"low": F.coalesce(low, F.lit(0.0)), "saved": F.coalesce(saved, F.lit(1.0))}).filter((F.col("low") >= precision) & (F.col("saved") >= kept) & (F.col("cum_s") > 0))
        order = F.struct("cum_s", F.round("low", 9).alias("r"), F.col("v"), "cum_n", "low", "saved")
        best = cuts.groupBy("k").agg(F.max(order).alias("b"))
        for r in per.join(best, "k", "left").collect():
            s, w = specs[r["k"]]
            both, b = r["ts"] * r["tp"], r["b"]
            auc = 1 - r["lost"] / both if both else None
            ids = tuple(terms[i].id for i in s)
            cut = (b["v"], b["cum_n"], b["cum_s"], b["low"], b["saved"]) if b else (None, 0, 0, 0.0, 1.0)
            out.append(Found(ids, tuple(w), auc, *cut, r["n"] / total[0]))
    return out


def shortlist(terms: list[Term], singles: list[Found], most: int, per_group: int) -> list[int]:
    """Terms by AUC (ties by id), at most ``per_group`` of a group."""
    at = {t.id: i for i, t in enumerate(terms)}
    taken, out = {}, []
    for f in sorted(singles, key=lambda f: (-round(f.auc if f.auc is not None else -1.0, 9), f.terms[0])):
        i = at[f.terms[0]]
        if taken.get(terms[i].group, 0) < per_group and len(out) < most:
            taken[terms[i].group] = taken.get(terms[i].group, 0) + 1
            out.append(i)
    return out


def search(
    df: DataFrame,
    terms: list[Term],
    severe: Column,
    protected: Column,
    precision: float = 0.5,
    kept: float = 0.5,
    weights: tuple[float, ...] = (0.5, 1.0, 2.0),
    pairs: int = 8,
    triples: int = 4,
    per_group: int = 2,
) -> list[Found]:
    """All candidates judged, best first. Stages: every term alone; pairs of the ``pairs`` best terms; triples of the ``triples`` best.

    The first term of a candidate (in the order of ids) has weight 1, the others one
    of ``weights`` each.
    """
    terms = sorted(terms, key=lambda t: t.id)
    if len({t.id for t in terms}) != len(terms):
        raise ValueError("terms with one id")
    singles = judge_scores(df, terms, [((i,), (1.0,)) for i in range(len(terms))], severe, protected, precision, kept)
    short = shortlist(terms, singles, max(pairs, triples), per_group)
    specs = [(s, (1.0, w)) for s in combinations(sorted(short[:pairs]), 2) for w in weights]
    specs += [(s, (1.0, *w)) for s in combinations(sorted(short[:triples]), 3) for w in product(weights, repeat=2)]
    found = singles + (judge_scores(df, terms, specs, severe, protected, precision, kept) if specs else [])
    return sorted(found, key=Found.rank)
