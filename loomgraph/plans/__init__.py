"""Query plans over the graph."""

from __future__ import annotations


def _load():
    from . import catalog, coverage, crosslang, cypher_queries, extraction, live, quality, resolution, streams, workings  # noqa: F401
    from .registry import ORACLES, QUERIES

    return QUERIES, ORACLES


def queries() -> dict:
    return dict(_load()[0])


def oracles() -> dict[str, str]:
    return dict(_load()[1])
