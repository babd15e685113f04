"""Queries with their SQL for DuckDB."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir); sql may use the tables of binding.SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            from .binding import SQL

            ORACLES[name] = f"{SQL}\n{sql.strip()}"
        return f

    return put
