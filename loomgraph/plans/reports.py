"""Results as text, JSON and HTML."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render_text(df: DataFrame) -> str:
    """Rows as lines of values between tabs and bars, without a header; for results that a person reads."""
    return "".join("\t|\t".join("" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in row) + "\n" for row in df.toLocalIterator())


def json_report(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def html_report(df: DataFrame, title: str) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in row) + "</tr>" for row in df.toLocalIterator())
    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>"
