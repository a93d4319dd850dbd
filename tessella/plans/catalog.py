"""The registered queries: name -> (Spark plan, DuckDB SQL)."""

from __future__ import annotations

from tessella.plans import kept, mined, modelled, ranked, rated, scored, shaped
from tessella.plans.registry import QUERIES, SQL

MODULES = (rated, shaped, ranked, scored, mined, kept, modelled)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
