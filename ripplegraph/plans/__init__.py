"""Queries over the operators, and their SQL."""

from __future__ import annotations


def _load():
    from . import behavior, context, core, encode, lookups, models, review, sources, surfaces  # noqa: F401  each registers its queries with core

    return core


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLE_SQL)
