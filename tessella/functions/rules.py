"""Rules as data, compiled to one Column under an explicit missing-value mode.

Modes
-----
``fail_open``     a missing guard or target satisfies the rule
``three_valued``  a missing guard or target makes the rule NULL (Kleene logic)
``nan_violates``  a missing target violates the rule; a missing guard satisfies it
The verdict mode has strings: ``pass``, ``fail``, ``not triggered``, ``no verdict``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("fail_open", "three_valued", "nan_violates")


@dataclass(frozen=True)
class Rule:
    """``guard => feature op threshold``; ``op`` is one of le, ge, lt, gt, band."""

    name: str
    feature: str
    op: str
    threshold: float
    upper: float | None = None
    guard_feature: str | None = None
    guard_op: str | None = None
    guard_threshold: float | None = None
    mechanism: str | None = None


def _compare(c: Column, op: str, lo: float, hi: float | None = None) -> Column:
    if op == "band":
        return (c >= F.lit(lo)) & (c <= F.lit(hi))
    return {"le": c <= lo, "ge": c >= lo, "lt": c < lo, "gt": c > lo}[op]


def target(rule: Rule) -> Column:
    return _compare(F.col(rule.feature), rule.op, rule.threshold, rule.upper)


def guard(rule: Rule) -> Column | None:
    if rule.guard_feature is None:
        return None
    return _compare(F.col(rule.guard_feature), rule.guard_op, rule.guard_threshold)


def compile_rule(rule: Rule, mode: str = "fail_open") -> Column:
    """The rule as a boolean Column (features must be cleaned: NULL = missing)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    hit, on = target(rule), guard(rule)
    if mode == "three_valued":
        return hit if on is None else F.when(on.isNull(), F.lit(None)).when(~on, F.lit(True)).otherwise(hit)
    met = F.coalesce(hit, F.lit(mode == "fail_open"))
    return met if on is None else F.coalesce(~on, F.lit(True)) | met


def compile_rules(rules: list[Rule], mode: str = "fail_open") -> Column:
    """AND over the rules; under three_valued, false beats unknown beats true."""
    return reduce(lambda a, b: a & b, [compile_rule(r, mode) for r in rules], F.lit(True))


def verdict(rule: Rule) -> Column:
    hit, on = target(rule), guard(rule)
    out = F.when(hit.isNull(), "no verdict").when(hit, "pass").otherwise("fail")
    if on is None:
        return out
    return F.when(on.isNull(), "no verdict").when(~on, "not triggered").otherwise(out)


def set_verdict(rules: list[Rule]) -> Column:
    """``implausible`` if any rule fails, else ``no verdict`` if any is unknown, else ``plausible``."""
    all_ = compile_rules(rules, "three_valued")
    return F.when(all_.isNull(), "no verdict").when(all_, "plausible").otherwise("implausible")


def failed_names(rules: list[Rule]) -> Column:
    """Sorted names of the failing rules, as an array."""
    marks = F.array(*[F.when(verdict(r) == "fail", F.lit(r.name)) for r in rules])
    return F.array_sort(F.filter(marks, lambda x: x.isNotNull()))


def failed_mechanisms(rules: list[Rule]) -> Column:
    marks = F.array(*[F.when(verdict(r) == "fail", F.lit(r.mechanism)) for r in rules])
    return F.array_sort(F.array_distinct(F.filter(marks, lambda x: x.isNotNull())))
