"""What a graph holds, as tables and JSON."""

from __future__ import annotations

import json

from ..graph import Graph
from ..schema import EDGE_TYPES, LABELS, NODE_DDL, _columns, connections


def show_tables(g: Graph):
    """(name, type) of node and relationship tables."""
    rows = [(x, "NODE") for x in LABELS] + [(x, "REL") for x in EDGE_TYPES]
    return g.spark.createDataFrame(rows, "name string, type string")


def table_info(g: Graph, name: str):
    """(property, type) of a table."""
    if name in EDGE_TYPES:
        rows = [(p, "DOUBLE" if p == "confidence_score" else "BOOLEAN" if p == "is_required" else "STRING") for p in EDGE_TYPES[name][1]]
    else:
        rows = [(n, t.replace(";", ",").upper()) for n, t in _columns(NODE_DDL) if n != "label"]
    return g.spark.createDataFrame(rows, "property string, type string")


def show_connection(g: Graph, name: str):
    """(source, target): every allowed pair of a relationship, not the first alone."""
    return g.spark.createDataFrame(connections(name), "source string, target string")


def schema_json() -> str:
    nodes = [{"label": x, "properties": [{"name": n, "type": t.replace(";", ",")} for n, t in _columns(NODE_DDL) if n != "label"]} for x in LABELS]
    edges = [{"type": t, "connections": [{"from": s, "to": e} for s, e in connections(t)], "properties": list(props)} for t, (_, props) in EDGE_TYPES.items()]
    return json.dumps({"nodes": nodes, "relationships": edges}, indent=2)
