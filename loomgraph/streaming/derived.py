"""Derived edges under change: how often each pair is supported is kept, and changes go through the joins with their sign.

A change of a join is (change of one side x the other side) + (one side x change
of the other), so only what meets a change is read. A pair whose support falls
to nothing goes. Tables are stored by the column that the next join asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import staged
from .store import BucketStore, latest

PAIR = "src_id string, dst_id string, n bigint"


def _counted(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0")


def _add(store: BucketStore, table: str, ddl: str, delta: DataFrame, *by: str) -> None:
    """Adds signed counts to a table that is stored by some of its columns."""
    columns = [c.strip().split(" ")[0] for c in ddl.split(",")]
    key = [c for c in columns if c != "n"]
    at = store.touched(delta, *by)
    store.put(table, _counted(store.read(table, ddl, at).select(*columns).unionByName(delta.select(*columns)), *key).select(*columns), at, *by)


def coverage_changed(store: BucketStore, tests: DataFrame, calls: DataFrame, hops: int = 3) -> None:
    """Tests and calls come and go: (src_id, dst_id, n), n being 1 for an edge that is new and -1 for one that is gone.

    Level 0 is what a test names; level k + 1 is what level k calls, with the
    number of ways. Levels are stored by what they end at, calls by the caller.
    """
    calls = staged(_counted(calls.select("src_id", "dst_id", "n"), "src_id", "dst_id"), "calls")
    delta = staged(_counted(tests.select("src_id", "dst_id", "n"), "src_id", "dst_id"), "delta")
    new = calls.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d"), F.col("n").alias("_n"))
    at = store.touched(calls, "src_id")
    _add(store, "calls", PAIR, calls, "src_id")
    for k in range(hops):
        # the old level with the new calls, the level's change with all calls
        old = store.read(f"level{k}", PAIR, at).select("src_id", "dst_id", "n").join(new, F.col("dst_id") == F.col("_s"))
        on = store.read("calls", PAIR, store.touched(delta, "dst_id")).select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d"), F.col("n").alias("_n"))
        more = old.unionByName(delta.join(on, F.col("dst_id") == F.col("_s")))
        after = staged(_counted(more.select("src_id", F.col("_d").alias("dst_id"), (F.col("n") * F.col("_n")).alias("n")), "src_id", "dst_id"), "delta")
        _add(store, f"level{k}", PAIR, delta, "dst_id")
        delta = after
    _add(store, f"level{hops}", PAIR, delta, "dst_id")


def indirect(store: BucketStore, hops: int = 3) -> DataFrame:
    """(src_id, dst_id): what tests reach by calls and don't name."""
    tests = store.read("level0", PAIR).select("src_id", "dst_id")
    reached = [store.read(f"level{k}", PAIR).select("src_id", "dst_id") for k in range(1, hops + 1)]
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    return out.distinct().join(tests, ["src_id", "dst_id"], "left_anti")


METHOD, WANTED = "struct string, method string, n bigint", "interface string, method string, n bigint"
HAVE, NEED = "struct string, interface string, n bigint", "interface string, n bigint"


def _appearing(store: BucketStore, table: str, ddl: str, delta: DataFrame, *by: str) -> DataFrame:
    """(key, n): 1 where the change makes a row appear, -1 where it makes one go; the table is changed."""
    key = [c.strip().split(" ")[0] for c in ddl.split(",")][:-1]
    delta = staged(_counted(delta.select(*key, "n"), *key), "delta")
    old = store.read(table, ddl, store.touched(delta, *by)).select(*key, F.col("n").alias("_old"))
    signed = delta.join(old, key, "left").withColumn("_old", F.coalesce("_old", F.lit(0)))
    flips = staged(signed.select(*key, ((F.col("_old") + F.col("n") > 0).cast("bigint") - (F.col("_old") > 0).cast("bigint")).alias("n")).where("n <> 0"), "flips")
    _add(store, table, ddl, delta, *by)
    return flips


def satisfaction_changed(store: BucketStore, methods: DataFrame, wanted: DataFrame) -> None:
    """Methods of structs (struct, method, n) and of interfaces (interface, method, n) come and go; n counts declarations, 1 or -1."""
    old_methods = lambda names: store.read("methods", METHOD, store.touched(names, "method")).where("n > 0").select("struct", "method")
    old = staged(old_methods(wanted), "methods")
    m = _appearing(store, "methods", METHOD, methods, "method")
    w = _appearing(store, "wanted", WANTED, wanted, "method")
    # the methods' change with all that is wanted now, the methods before with the wanted's change
    now = store.read("wanted", WANTED, store.touched(m, "method")).where("n > 0").select("interface", "method")
    first = m.join(now, "method").select("struct", "interface", "n")
    second = w.join(old, "method").select("struct", "interface", "n")
    _add(store, "have", HAVE, staged(_counted(first.unionByName(second), "struct", "interface"), "have"), "interface")
    _add(store, "need", NEED, staged(_counted(w.select("interface", "n"), "interface"), "need"), "interface")


def satisfied_now(store: BucketStore) -> DataFrame:
    """(struct, interface) where a struct has every method of an interface."""
    need = store.read("need", NEED).select("interface", F.col("n").alias("_need"))
    return store.read("have", HAVE).join(need, "interface").where("n = _need").select("struct", "interface")


def coverage_of(spark, path: str) -> DataFrame:
    return indirect(latest(spark, path))


def satisfaction_of(spark, path: str) -> DataFrame:
    return satisfied_now(latest(spark, path))
