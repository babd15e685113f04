"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(*parts: Column) -> Column:
    """16 hexadecimal digits of SHA-256 over the parts; one recipe for every language."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext == ".go", "go").when(ext == ".py", "python").when(ext.isin(".ts", ".tsx"), "typescript").when(ext.isin(".js", ".jsx"), "javascript")
    )


def contains_word(text: Column, word: str) -> Column:
    """At the start or the end."""
    return text.startswith(word) | text.endswith(word)


def url_path(url: Column) -> Column:
    """Scheme, host, query and fragment taken off; / if nothing is left."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, null for nothing of nothing; scaled first, so that halves are exact."""
    return F.round(F.try_divide(part.cast("double") * 10000.0, whole.cast("double"))) / 100.0


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def is_test_path(path: Column) -> Column:
    """Test files by their paths, per language."""
    base = basename(path)
    return (
        base.endswith("_test.go")
        | (base.rlike(r"^test_.*\.py$") | base.rlike(r"_test\.py$"))
        | base.rlike(r"\.(test|spec)\.[jt]sx?$")
        | path.rlike(r"(^|/)(tests?|__tests__|spec)/")
    )
