"""All registered queries of the analytics engine, and their SQL."""

from __future__ import annotations

from .plans import algorithms, models, primitives, relations, scalars, service  # noqa: F401  these register queries
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
