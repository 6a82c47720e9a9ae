"""Registered queries of the reference's operators, and their SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import calls, features, sequences

    return calls.QUERIES | sequences.QUERIES | features.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import calls, features, sequences

    return calls.SQL | sequences.SQL | features.SQL
