"""Queries for tools: text in, JSON out, with a time limit."""

from __future__ import annotations

import threading
import uuid

from ..graph import Graph
from .reports import render_text

TIMEOUT = 30.0


def run_cypher(g: Graph, query: str, timeout: float = TIMEOUT, **params) -> dict:
    """query, result (lines of values) and resultCount (its lines that aren't blank); error where it fails or takes too long.

    A query that takes too long is interrupted by its tag, so its tasks stop too.
    """
    spark, tag = g.spark, f"cypher-{uuid.uuid4().hex[:12]}"
    late = threading.Event()

    def stop():
        late.set()
        spark.interruptTag(tag)

    timer = threading.Timer(timeout, stop)
    spark.addTag(tag)
    timer.start()
    try:
        text = render_text(g.cypher(query, **params))
        return {"query": query, "result": text, "resultCount": sum(bool(x.strip()) for x in text.splitlines())}
    except Exception as e:  # noqa: BLE001  the caller gets the reason as data
        return {"query": query, "error": f"stopped after {timeout:g} s" if late.is_set() else str(e).split("\n")[0]}
    finally:
        timer.cancel()
        spark.removeTag(tag)
