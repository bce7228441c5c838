"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from quantloom.plans import q_analysts, q_facts, q_factors, q_more, q_providers, q_risk, q_signals, q_windows

_PARTS = (q_windows, q_risk, q_signals, q_factors, q_analysts, q_facts, q_more, q_providers)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
