"""Law sets as JSON text: written once, applied without a refit, with a line of explanation per law."""

from __future__ import annotations

import json
from dataclasses import asdict, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.rules import Rule, compile_rules, guard, target

FORMAT = 1
MARKS = {"pass": "+", "fail": "x", "not triggered": "-", "no verdict": "?"}


def dumps(rules: list[Rule], **about) -> str:
    """The laws with every digit of their thresholds; ``about`` is kept beside them."""
    laws = [{k: v for k, v in asdict(r).items() if v is not None} for r in rules]
    return json.dumps({"format": FORMAT, "about": about, "laws": laws}, sort_keys=True)


def loads(text: str) -> list[Rule]:
    """The laws of a text; an error on an unknown format, field or operator, or a guard that is not whole."""
    d = json.loads(text)
    if d.get("format") != FORMAT:
        raise ValueError(f"law set format {d.get('format')!r}; {FORMAT} is known")
    known = {f.name for f in fields(Rule)}
    out = []
    for law in d["laws"]:
        if more := set(law) - known:
            raise ValueError(f"unknown fields {sorted(more)} of a law")
        r = Rule(**law)
        if r.op not in ("le", "ge", "lt", "gt", "band") or (r.op == "band") != (r.upper is not None):
            raise ValueError(f"law {r.name!r}: operator {r.op!r}")
        if len({x is None for x in (r.guard_feature, r.guard_op, r.guard_threshold)}) != 1:
            raise ValueError(f"law {r.name!r}: a guard has a feature, an operator and a threshold")
        out.append(r)
    return out


def apply(text: str, mode: str = "fail_open") -> Column:
    return compile_rules(loads(text), mode)


def explained(rules: list[Rule]) -> Column:
    """array<struct<law, state, value, threshold, line>>, a line per law in their order.

    The state of a law: ``pass``, ``fail``, ``not triggered`` (its guard is not met) or
    ``no verdict`` (its guard or its target is missing).
    """
    out = []
    for r in rules:
        hit, on, value = target(r), guard(r), F.col(r.feature).cast("double")
        state = F.when(hit.isNull(), "no verdict").when(hit, "pass").otherwise("fail")
        said = F.when(value.isNull(), f"{r.feature} is missing").otherwise(F.format_string(f"{r.feature} = %.4f", value))
        if on is not None:
            state = F.when(on.isNull(), "no verdict").when(~on, "not triggered").otherwise(state)
            held = F.col(r.guard_feature).cast("double")
            said = F.when(on.isNull(), f"premise {r.guard_feature} is missing").when(~on, F.format_string(f"premise not met ({r.guard_feature}=%.3f)", held)).otherwise(said)
        mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[state]
        out.append(
            F.struct(F.lit(r.name).alias("law"), state.alias("state"), value.alias("value"), F.lit(float(r.threshold)).alias("threshold"), F.concat_ws(" ", mark, F.lit(r.name + ":"), said).alias("line"))
        )
    return F.array(*out)
