"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from functools import partial

from tidemark.plans import dialect, domain, engine, evaluation, extras, ranked, relational, windowed  # noqa: F401  extras and ranked register their queries

TEXTS = relational.SQL | windowed.SQL | evaluation.SQL


def queries() -> dict:
    return {name: partial(domain.sql, query=q) for name, q in TEXTS.items()} | engine.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: dialect.check_text(q) for name, q in TEXTS.items()} | engine.ORACLES
