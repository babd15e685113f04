"""A resolved graph that is kept up to date: a change resolves again only the edges whose answer it may change.

Stored by bucket, under one manifest: nodes and references by their file; under
what names nodes can be found (keys) and references are sought (looks), both by
the name looked up; and the answers, by the reference's file. When files
change, their old and new keys are compared; looks of the names that differ
tell the references of other files that must be resolved again. So the buckets
read and written are those of the changed files, of the names that changed, and
of the references that look for these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dirname
from ..graph import Graph
from ..operators import resolve as R
from ..schema import EDGE_DDL, NODE_DDL, RAW_EDGE_DDL, conform
from ..sources.folders import staged
from . import derived
from .store import BucketStore, latest

REF_DDL = f"{RAW_EDGE_DDL}, src_label string, src_file string, src_package string"
KEY_DDL = "kind string, scope string, ref string, label string, place struct<file_path:string,start_byte:bigint,id:string>"
LOOK_DDL = "edge string, type string, ref string, src_file string, rank int, kind string, scope string, strategy string"
ANSWER_DDL = f"{RAW_EDGE_DDL}, dst_id string, src_label string, dst_label string, strategy string, cross_file_edge boolean, reason string"
KEY = ("kind", "scope", "ref")


def _names(ddl: str) -> list[str]:
    return [x.strip().split(" ")[0].split(":")[0] for x in ddl.replace("map<string,string>", "map").split(", ")]


def _keys(nodes: DataFrame) -> DataFrame:
    return R.keys_of(R.slim(nodes), nodes).select(*KEY, "label", "place").distinct()


def _refs(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    src = R.slim(nodes).select(F.col("id").alias("src_id"), F.col("label").alias("src_label"), F.col("file_path").alias("src_file"), F.col("package").alias("src_package"))
    return raw.join(src, "src_id", "left").withColumn("src_file", F.coalesce("src_file", "file_path")).withColumn("src_package", F.coalesce("src_package", dirname(F.col("file_path")))).select(*_names(REF_DDL))


def _looks(refs: DataFrame) -> DataFrame:
    return R.look_ups(refs.where("src_label is not null")).select(*_names(LOOK_DDL))


def update(store: BucketStore, changed: DataFrame, nodes: DataFrame, raw: DataFrame) -> dict[str, int]:
    """One change of the stored graph: all rows of changed(file_path) are replaced by nodes and raw, the extraction of those files as they are now.

    A file without new rows is gone. Counts what was done: files, keys that
    differ, references resolved again, of those in other files. The caller commits.
    """
    changed = staged(changed.select("file_path").distinct(), "changed")
    files = store.touched(changed, "file_path")
    new_nodes = staged(conform(nodes.join(changed, "file_path", "left_semi"), NODE_DDL).dropDuplicates(["id"]), "nodes")
    kept = lambda table, ddl: store.read(table, ddl, files)
    old_nodes = kept("nodes", NODE_DDL).join(changed, "file_path", "left_semi").select(*_names(NODE_DDL))
    new_refs = staged(_refs(conform(raw.join(changed, "file_path", "left_semi"), RAW_EDGE_DDL).dropDuplicates(["id"]), new_nodes), "refs")
    old_refs = staged(kept("refs", REF_DDL).join(changed, "file_path", "left_semi").select(*_names(REF_DDL)), "refs")

    # what names find other nodes than before
    signed = _keys(old_nodes).withColumn("n", F.lit(-1)).unionByName(_keys(new_nodes).withColumn("n", F.lit(1)))
    differ = staged(signed.groupBy(*KEY, "label", "place").agg(F.sum("n").alias("n")).where("n <> 0"), "differ")
    names = differ.select(*KEY).distinct()
    at = store.touched(names, *KEY)
    keys = store.read("keys", KEY_DDL, at).join(differ.where("n < 0").drop("n"), [*KEY, "label", "place"], "left_anti")
    store.put("keys", keys.select(*_names(KEY_DDL)).unionByName(differ.where("n > 0").drop("n").select(*_names(KEY_DDL))), at, *KEY)

    # references of other files that look for them
    looking = staged(store.read("looks", LOOK_DDL, at).join(names, list(KEY), "left_semi").select("edge", F.col("src_file").alias("file_path")).distinct().join(changed, "file_path", "left_anti"), "looking")
    others = store.touched(looking, "file_path")
    again = store.read("refs", REF_DDL, others).join(looking.select(F.col("edge").alias("id")), "id", "left_semi").select(*_names(REF_DDL))
    asked = staged(new_refs.unionByName(again), "asked")

    old_looks, new_looks = _looks(old_refs), staged(_looks(new_refs), "looks")
    at = sorted({*store.touched(old_looks, *KEY), *store.touched(new_looks, *KEY)})
    looks = store.read("looks", LOOK_DDL, at).join(old_refs.select(F.col("id").alias("edge")), "edge", "left_anti").select(*_names(LOOK_DDL))
    store.put("looks", looks.unionByName(new_looks), at, *KEY)

    # their answers, from the names they look for
    wanted = staged(_looks(asked), "wanted")
    best = R.candidates(store.read("keys", KEY_DDL, store.touched(wanted, *KEY)).join(wanted.select(*KEY).distinct(), list(KEY), "left_semi"))
    answers = staged(R.judged(asked, R.chosen(wanted, best)).select(*_names(ANSWER_DDL)), "answers")
    at = sorted({*files, *others})
    gone = asked.select("id").unionByName(old_refs.select("id")).distinct()
    # tests and calls that come and go, for the coverage that follows from them
    met = lambda df, n: df.where("reason is null and type in ('TESTS', 'CALLS')").select("type", "src_id", "dst_id", F.lit(n).cast("bigint").alias("n"))
    before = store.read("answers", ANSWER_DDL, at).join(gone, "id", "left_semi")
    signed = staged(met(before, -1).unionByName(met(answers, 1)).groupBy("type", "src_id", "dst_id").agg(F.sum("n").alias("n")).where("n <> 0"), "signed")
    if not signed.isEmpty():
        derived.coverage_changed(store, signed.where("type = 'TESTS'"), signed.where("type = 'CALLS'"))
    store.put("answers", store.read("answers", ANSWER_DDL, at).join(gone, "id", "left_anti").select(*_names(ANSWER_DDL)).unionByName(answers), at, "file_path")

    rest = lambda table, ddl: kept(table, ddl).join(changed, "file_path", "left_anti").select(*_names(ddl))
    nodes_now, refs_now = rest("nodes", NODE_DDL).unionByName(new_nodes), rest("refs", REF_DDL).unionByName(new_refs)
    store.put("nodes", nodes_now, files, "file_path")
    store.put("refs", refs_now, files, "file_path")
    return {"files": changed.count(), "keys": differ.count(), "resolved": asked.count(), "elsewhere": looking.count()}


def answers(spark, path: str) -> DataFrame:
    """The resolved references, with strategy and cross_file_edge."""
    return latest(spark, path).read("answers", ANSWER_DDL).where("reason is null").drop("reason")


def rejected(spark, path: str) -> DataFrame:
    return latest(spark, path).read("answers", ANSWER_DDL).where("reason is not null").select(*_names(RAW_EDGE_DDL), "reason")


def read(spark, path: str) -> Graph:
    """The stored graph: nodes, the edges that were resolved, and the indirect coverage that follows from them."""
    s = latest(spark, path)
    nodes = s.read("nodes", NODE_DDL)
    end = lambda x: nodes.select(F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"))
    through = derived.indirect(s).join(end("src"), "src_id").join(end("dst"), "dst_id")
    through = conform(through, EDGE_DDL, id=F.concat(F.lit("c:"), "src_id", F.lit(":"), "dst_id"), type=F.lit("COVERS"), coverage_type=F.lit("indirect"))
    return Graph(nodes, conform(answers(spark, path), EDGE_DDL).unionByName(through))


def apply_batch(spark, batch: DataFrame, number: int, read_files, path: str, buckets: int = 64) -> dict[str, int]:
    """One batch of changes(path, change_type, ts): each path's last change stands; its file is read, extracted and put in the place of the old one."""
    from ..sources.ingest import extract

    last = staged(batch.groupBy("path").agg(F.max_by("change_type", F.struct("ts", "change_type")).alias("change_type")), "changes")
    if last.isEmpty():
        return {}
    rows = staged(extract(read_files(last.where(~F.col("change_type").isin("Deleted", "Renamed")))), "rows")
    store = BucketStore(spark, path, number, buckets)
    done = update(store, last.select(F.col("path").alias("file_path")), rows.where("tag = 'node'"), rows.where("tag = 'edge'"))
    store.commit()
    return done


def live_graph(changes: DataFrame, read_files, path: str, checkpoint: str, buckets: int = 64, on_update=None):
    """A query that keeps the resolved graph under path up to date with a stream of changes.

    read_files(paths) gives files(path, content). A batch that is done again
    overwrites its own update. on_update(counts, number) is called after each.
    Names are resolved as resolve() does without imports' bindings; indirect
    coverage is kept with them.
    """

    def each(batch: DataFrame, number: int):
        done = apply_batch(batch.sparkSession, batch, number, read_files, path, buckets)
        if on_update:
            on_update(done, number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
