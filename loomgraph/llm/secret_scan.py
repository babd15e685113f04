"""Secret scan over a trigram inverted index. DataFrame operations only.

Each rule's regular expression is turned, when the plan is built, into a
Boolean query over trigrams that every match must contain. The index holds
postings (trigram, row) of the trigrams that some rule asks for; postings
are intersected by row, and only rows that satisfy a rule's query are
verified with its expression. A rule without mandatory trigrams scans all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, stage, text_col

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as parser

#: Alternatives that are kept apart while a regular expression is read.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """pattern: as the rule is stated. scan: an expression with the same accepted matches that fails early, if there is one.
    least: characters that the match, or the group named, has at least."""

    name: str
    pattern: str
    least: int
    group: int = 0
    scan: str | None = None


#: The kinds in their order.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12, group=2),
    # A run that is too short is dropped, and what follows its start inside the run is shorter still: the bound can go into the expression.
    Rule("access", r"AKIA[A-Z0-9]+", 18, scan=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 16, scan=r"[0-9a-f]{16,}"),
)


def _strings(item) -> set[str] | None:
    """All strings that a parsed item can match, or None if there are too many."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if any(o is not sre.LITERAL for o, _ in arg):
            return None
        return {chr(a).lower() for _, a in arg}
    if op is sre.SUBPATTERN:
        return _all_strings(arg[-1])
    if op is sre.BRANCH:
        parts = [_all_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = _all_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _all_strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        one = _strings(item)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query_of(strings: set[str]) -> frozenset[frozenset[str]] | None:
    """OR of ANDs of trigrams, with weaker alternatives absorbing stronger ones; None: no demand."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(a for a in sets if not any(b < a for b in sets))


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """The demands that every match fulfils (all of them), each an OR of ANDs of lower-case trigrams; [] if there is none."""
    demands, run = [], {""}

    def flush():
        if (q := _query_of(run)) is not None:
            demands.append(q)

    def flat(items):
        for op, arg in items:
            if op is sre.SUBPATTERN and _all_strings(arg[-1]) is None:
                yield from flat(arg[-1])
            else:
                yield op, arg

    for item in flat(parser.parse(pattern)):
        one = _strings(item)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
        else:
            flush()
            run = one if one is not None else {""}
    flush()
    return demands


#: What a row is told by in the index: rows of one id and one text have the same spans.
ROW = ["doc_id", "_row"]


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, _row) of the given lower-case trigrams over the whole texts of rows(doc_id, _row, _text)."""
    low = rows.select(*ROW, F.lower("_text").alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(*ROW, F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, list]) -> DataFrame:
    """(doc_id, _row, a flag for each rule): postings intersected by row; a row that no rule wants is left out."""
    names = sorted({t for q in queries.values() for d in q for a in d for t in a})
    has = postings.groupBy(*ROW).agg(*[F.bool_or(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(names)])
    at = {t: F.col(f"t{i}") for i, t in enumerate(names)}
    every = lambda xs: reduce(lambda a, b: a & b, xs)
    some = lambda xs: reduce(lambda a, b: a | b, xs)
    flags = {n: every([some([every([at[t] for t in sorted(a)]) for a in sorted(d, key=sorted)]) for d in q]) for n, q in queries.items() if q}
    return has.where(some(list(flags.values()))).select(*ROW, *[c.alias(f"_{n}") for n, c in flags.items()])


#: Cut mark and its stand-in where a text has it; no rule's expression takes either, and each is one code point.
MARK, OTHER = "\ue000", "\ue001"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Accepted matches as array<struct<start, kind, end>>, in code points; leftmost, not overlapping."""
    marked = F.regexp_replace(F.translate(text, MARK, OTHER), rule.scan or rule.pattern, f"{MARK}$0{MARK}")
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("out"))

    def step(acc, x):
        end = acc["pos"] + F.length(x)
        kept = F.length(F.regexp_extract(x, rule.pattern, rule.group) if rule.group else x) >= rule.least
        one = F.array(F.struct(acc["pos"].alias("start"), F.lit(rank).alias("kind"), end.alias("end")))
        return F.struct(end.alias("pos"), (~acc["hit"]).alias("hit"), F.when(acc["hit"] & kept, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(F.contains(marked, F.lit(MARK)), F.aggregate(F.split(marked, MARK, -1), zero, step, lambda acc: acc["out"])).otherwise(zero["out"])


def scan(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id and, for each rule, the array of its spans.

    Rules with a trigram query are verified in the rows that the index gives,
    and only their texts are moved; the others run over all texts where they
    are read. Null text is an empty one and has no spans; an empty table gives
    no rows; a null or repeated doc_id keeps every row. Other columns are not read.
    """
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for d in q for a in d for t in a})
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col().alias("_text")).withColumn("_row", F.xxhash64("_text"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = {r.name: spans(F.col("_text"), r, k) for k, r in enumerate(rules)}
    out = rows.select(*ROW, *[found[r.name].alias(r.name) for r in rules if not queries[r.name]])
    asked = [r.name for r in rules if queries[r.name]]
    if asked:
        both = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash"))
        # written first, so that its size is known before any text moves
        chosen = stage(candidates(build_index(rows, trigrams), queries).withColumnsRenamed({"doc_id": "_id", "_row": "_hash"}), "candidates")
        chosen = F.broadcast(chosen) if chosen.count() * 32 <= MOST_BROADCAST else chosen
        seen = rows.join(chosen, both).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_hash"), *[F.when(F.col(f"_{n}"), found[n]).otherwise(none).alias(n) for n in asked])
        seen = seen.dropDuplicates(["_id", "_hash"])
        out = out.join(seen, both, "left").withColumns({n: F.coalesce(n, none) for n in asked})
    return out.select("doc_id", *[r.name for r in rules])


def render(parts: list[Column], names: list[str]) -> Column:
    """kind:start:end by start, then kind, joined with commas."""
    label = F.array(*[F.lit(n) for n in names])
    one = lambda s: F.concat_ws(":", F.element_at(label, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), one), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of spans by rule, their hash and their list, for each row of docs; nulls, repeats and empty tables as in scan()."""
    found = scan(docs)
    joined = render([F.col(r.name) for r in RULES], [r.name for r in RULES])
    found = found.withColumn("spans", joined)
    counts = [F.size(r.name).cast("long").alias(f"n_{r.name}") for r in RULES]
    return found.select("doc_id", *counts, F.sha2(F.col("spans"), 256).alias("base_sha256"), "spans")
