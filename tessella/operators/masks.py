"""Outcomes of many rules packed into bits once, and searches over sets of rules on them.

Each row becomes 64-bit words, a bit a rule that it fails, and rows of equal words
and group are one with a count. The joint passes of every set of a search's frontier
with every further rule are then one matrix product a batch of words: one scan a
level, for all sets, all rules, all kinds and all floors. Only counts (sets x rules x
groups, bounded by the search's parameters) come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import ship, written

WORD = 64


class Bits(NamedTuple):
    """``table``: words w0, w1, ..., ``by`` and ``n``; ``rules``: how many."""

    table: DataFrame
    rules: int
    totals: dict  # by -> rows


def _word(rules: list[Column]) -> Column:
    bits = [F.when(ok, F.lit(0)).otherwise(F.lit(1 << i if i < WORD - 1 else -(1 << i))).cast("long") for i, ok in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def pack(df: DataFrame, rules: list[Column], by: Column | None = None) -> Bits:
    """Rows of equal outcomes and group counted together; a rule that is NULL fails."""
    words = [_word(rules[i : i + WORD]).alias(f"w{i // WORD}") for i in range(0, len(rules), WORD)]
    by = F.lit(None).cast("string") if by is None else by
    table = df.select(*words, by.alias("by")).groupBy(*[f"w{i}" for i in range(len(words))], "by").agg(F.count("*").alias("n"))
    table = written(table, "rule-bits")
    totals = {r["by"]: r["n"] for r in table.groupBy("by").agg(F.sum("n").alias("n")).collect()}
    return Bits(table, len(rules), totals)


def joint_counts(bits: Bits, sets: list[tuple[int, ...]]) -> dict:
    """Group -> counts[set, rule]: rows that pass all rules of the set and the rule."""
    ship(bits.table.sparkSession)
    words, rules = -(-bits.rules // WORD), bits.rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            raw = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(words)], 1)
            passes = np.unpackbits(raw.view(np.uint8).reshape(len(raw), -1), axis=1, count=rules, bitorder="little") == 0
            n, groups = batch.column(words + 1).to_numpy().astype(float), batch.column(words).dictionary_encode()
            of, names = groups.indices.fill_null(-1).to_numpy(), groups.dictionary.to_pylist()
            for g in np.unique(of).tolist():
                own = of == g
                p = passes[own]
                state = np.stack([p[:, list(s)].all(1) for s in sets], 1) * n[own][:, None]
                name = names[g] if g >= 0 else None
                sums[name] = sums.get(name, 0) + state.T @ p.astype(float)
        for name, total in sums.items():
            s, r = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(s), kind), pa.array(s, pa.int32()), pa.array(r, pa.int32()), pa.array(total[s, r].astype(np.int64))], ["by", "s", "r", "n"]
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(bits.table.schema["by"].dataType)
    found = bits.table.mapInArrow(run, f"by {bits.table.schema['by'].dataType.simpleString()}, s int, r int, n long")
    out = {k: np.zeros((len(sets), rules), np.int64) for k in bits.totals}
    for r in found.groupBy("by", "s", "r").agg(F.sum("n").alias("n")).collect():
        out[r["by"]][r["s"], r["r"]] = r["n"]
    return out


def robust_beam(
    real: DataFrame,
    bad: DataFrame,
    rules: list,
    kind: str,
    floor: float,
    strata: dict[str, Column] | None = None,
    floors: dict[str, float] | None = None,
    width: int = 96,
    most: int = 12,
    least_gain: float = 0.0015,
) -> dict | None:
    """The set of rules that rejects the worst kind best, under floors of satisfaction that hold in every stratum.

    A set grows by rules of later index and unused feature, if its satisfaction stays
    at the floor overall and at each stratum's own and it rejects more than
    ``least_gain`` more. Half the width goes to the sets of the best least rejection
    of a kind (then rejection, satisfaction, fewer rules, smaller indices), the rest
    to those of the best least rejection and rejection per lost satisfaction. Strata
    may overlap (at most 62). The best set ever in the beam is returned, None if none.
    """
    strata, floors = strata or {}, floors or {}
    if set(strata) != set(floors):
        raise ValueError("strata and floors must have the same names")
    names = sorted(strata)
    member = reduce(lambda a, b: a.bitwiseOR(b), [F.when(strata[n], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, n in enumerate(names)], F.lit(0).cast("long"))
    passes = [c.passes() for c in rules]
    good, wrong = pack(real, passes, member), pack(bad, passes, F.col(kind))
    inside = {n: [k for k in good.totals if k >> i & 1] for i, n in enumerate(names)}
    if any(not ks for ks in inside.values()):
        raise ValueError("a stratum without rows")
    n_good, n_wrong = sum(good.totals.values()), sum(wrong.totals.values())
    of_kind = {k: n for k, n in wrong.totals.items() if k is not None}
    frontier = [{"laws": (), "satisfaction": 1.0, "rejection": 0.0, "worst_kind": 0.0, "passed": 1.0}]
    best = None
    first = lambda d: (d["worst_kind"], d["rejection"], d["satisfaction"], -len(d["laws"]), tuple(-i for i in d["laws"]))
    second = lambda d: (d["worst_kind"], d["rejection"] / max(1 - d["satisfaction"], 1e-8), d["rejection"], d["satisfaction"], tuple(-i for i in d["laws"]))
    for _ in range(most):
        sets = [d["laws"] for d in frontier]
        g, w = joint_counts(good, sets), joint_counts(wrong, sets)
        kept_good, kept_wrong = sum(g.values()), sum(w.values())
        new = []
        for s, d in enumerate(frontier):
            used = {rules[i].feature for i in d["laws"]}
            for i in range(d["laws"][-1] + 1 if d["laws"] else 0, len(rules)):
                if rules[i].feature in used or kept_good[s, i] / n_good < floor:
                    continue
                if any(sum(g[k][s, i] for k in ks) / sum(good.totals[k] for k in ks) < floors[n] for n, ks in inside.items()):
                    continue
                passed = kept_wrong[s, i] / n_wrong
                if d["passed"] - passed <= least_gain:
                    continue
                worst = min(((n - w[k][s, i]) / n for k, n in of_kind.items()), default=0.0)
                rejection = (n_wrong - kept_wrong[s, i]) / n_wrong
                new.append({"laws": (*d["laws"], i), "satisfaction": kept_good[s, i] / n_good, "rejection": rejection, "worst_kind": worst, "passed": passed})
        if not new:
            break
        a = sorted(new, key=first, reverse=True)[: max(width // 2, 1)]
        taken = {d["laws"] for d in a}
        b = [d for d in sorted(new, key=second, reverse=True)[:width] if d["laws"] not in taken]
        frontier = a + b[: max(width - len(a), 0)]
        best = max([*frontier, *([best] if best else [])], key=first)
    return best
