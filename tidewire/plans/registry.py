"""A query and its DuckDB SQL, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import STAR_SQL, TEXT_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fixture: str | None = "star") -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir); ``sql`` follows the fixture's common table expressions."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            head = {"star": STAR_SQL, "text": TEXT_SQL, "both": f"{STAR_SQL}, {TEXT_SQL}", None: ""}[fixture].strip()
            if not head:
                ORACLES[name] = body
            elif body.upper().startswith("WITH RECURSIVE "):
                ORACLES[name] = f"WITH RECURSIVE {head}, {body[15:]}"
            elif body.upper().startswith("WITH "):
                ORACLES[name] = f"WITH {head}, {body[5:]}"
            else:
                ORACLES[name] = f"WITH {head} {body}"
        return f

    return put
