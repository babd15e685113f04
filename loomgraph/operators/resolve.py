"""Names to entities: ranked resolution by set-based joins, and validation against the edge schema.

A name is looked up by scopes in order (qualified name, same file, what the
file imports, same package, anywhere), inside a scope by the labels that its edge type expects,
and then by (file_path, start_byte, id), so the result does not depend on the
order of rows. Nodes are first reduced to one for each (name, scope, label), so
an edge meets at most as many rows as there are scopes times labels, however
common its name is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, dirname
from ..schema import ADDED_EXPECTED, EDGE_TYPES, EXPECTED, allowed_pairs
from ..sources.folders import staged

NO_SOURCE, NO_TARGET, NO_SCHEMA = "failed to resolve source", "failed to resolve target", "schema violation"


def qualified_names(nodes: DataFrame) -> DataFrame:
    """id, qualified: the names of all parents before a node's own; a root is named by its folder.

    A node takes its parent's name so far and then that one's parent, so the
    rounds are the logarithm of the depth; each but the first is written, and the
    last is the one without a node that has further to go. Parents in a circle raise ValueError.
    """
    folder = basename(dirname(F.col("file_path")))
    named = lambda at: at.select("id", F.when(F.coalesce(folder, F.lit("")).isin("", "."), F.col("qualified")).otherwise(F.concat(folder, F.lit("."), "qualified")).alias("qualified"))
    at = nodes.select("id", F.col("name").alias("qualified"), F.col("parent_id").alias("up"), "file_path")
    if at.where("up is not null").isEmpty():
        return named(at)
    for k in range(40):  # paths of 2**40 nodes
        parents = at.where("id is not null").select(F.col("id").alias("up"), F.col("qualified").alias("_q"), F.col("up").alias("_up"))
        at = at.join(parents, "up", "left").select("id", F.when(F.col("_q").isNotNull(), F.concat("_q", F.lit("."), "qualified")).otherwise(F.col("qualified")).alias("qualified"), F.col("_up").alias("up"), "file_path")
        if k:  # most parents have none of their own, and then nothing is written
            at = staged(at, "qualified")
        if at.where("up is not null").isEmpty():
            return named(at)
        if not at.where("up = id").isEmpty():
            break
    raise ValueError("a node is among its own parents")


def keys_of(n: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, scope, ref, label, place): under what a node can be found, several rows a node. They follow from the nodes of its file alone."""
    place = F.struct("file_path", F.coalesce("start_byte", F.lit(0)).alias("start_byte"), "id")
    row = lambda df, kind, scope, ref: df.select(F.lit(kind).alias("kind"), scope.alias("scope"), ref.alias("ref"), "label", place.alias("place"))
    anywhere, name = F.lit(""), F.col("name")
    # recv.method: a method by its parent's or receiver's name
    owner = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("owner")).where("parent_id is not null")
    method = n.where(F.col("label").isin("Method", "Function", "TestFunction"))
    owned = method.join(owner, "parent_id").select("id", "label", "name", "file_path", "start_byte", "owner")
    owned = owned.unionByName(method.where("receiver_type <> ''").select("id", "label", "name", "file_path", "start_byte", F.col("receiver_type").alias("owner")))
    # one row for each scope of a node, from one reading of the nodes
    by_name = n.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), scope.alias("scope")) for k, scope in (("file", F.col("file_path")), ("package", F.col("package")), ("global", anywhere))])).alias("s"))
    by_name = by_name.select("s.kind", "s.scope", name.alias("ref"), "label", place.alias("place"))
    by_owner = owned.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), scope.alias("scope")) for k, scope in (("method in file", F.col("file_path")), ("method", anywhere))])).alias("s"))
    by_owner = by_owner.select("s.kind", "s.scope", F.concat("owner", F.lit("."), "name").alias("ref"), "label", place.alias("place"))
    rows = [row(n, "id", anywhere, F.col("id")), row(n.join(qualified_names(nodes), "id"), "qualified", anywhere, F.col("qualified")), by_name, by_owner]
    return reduce(DataFrame.unionByName, rows).where("ref is not null and scope is not null")


def candidates(keys: DataFrame) -> DataFrame:
    """(kind, scope, ref, label, best): the least node by (file_path, start_byte, id) of each name, scope and label."""
    return keys.groupBy("kind", "scope", "ref", "label").agg(F.min("place").alias("best"))


def look_ups(edges: DataFrame) -> DataFrame:
    """(edge, type, ref, src_file, rank, kind, scope, strategy): under what an edge's reference is sought, nine rows at most.

    edges: id, type, dst_ref, src_file, src_package. The ranks say which scope counts first.
    """
    anywhere = F.lit("")
    looks = [(0, "id", anywhere, "id"), (1, "qualified", anywhere, "qualified"), (2, "file", F.col("src_file"), "file"), (3, "binding", F.col("src_file"), "binding"), (4, "package", F.col("src_package"), "package"), (5, "global", anywhere, "global")]
    dotted = [(6, "method in file", F.col("src_file"), "method"), (7, "method", anywhere, "method"), (8, "qualified", anywhere, "qualified")]
    row = lambda rank, kind, scope, strategy: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), scope.alias("scope"), F.lit(strategy).alias("strategy"))
    plain, more = F.array(*[row(*x) for x in looks]), F.array(*[row(*x) for x in dotted])
    asked = edges.where("dst_ref is not null").select("id", "type", F.col("dst_ref").alias("ref"), "src_file", "src_package")
    asked = asked.select("id", "type", "ref", "src_file", F.explode(F.when(F.size(F.split("ref", "\\.")) == 2, F.concat(plain, more)).otherwise(plain)).alias("l"))
    return asked.select(F.col("id").alias("edge"), "type", "ref", "src_file", "l.*").where("scope is not null")


def chosen(asked: DataFrame, best: DataFrame, cross_file: bool = True) -> DataFrame:
    """(edge, c): of the candidates under an edge's look-ups the first by scope, expected label and place."""
    found = asked.join(best, ["kind", "scope", "ref"])
    # ids, bindings and dotted references take any label; the others those that the type expects, in their order
    expected = {**EXPECTED, **ADDED_EXPECTED}
    order = F.create_map(*[F.lit(x) for t, labels in expected.items() for i, label in enumerate(labels) for x in (f"{t} {label}", i)])
    any_label = F.col("rank").isin(0, 3, 6, 7, 8) | ~F.col("type").isin(*expected)
    found = found.withColumn("label_rank", F.when(any_label, F.lit(0)).otherwise(F.try_element_at(order, F.concat("type", F.lit(" "), "label")))).where("label_rank is not null")
    if not cross_file:
        found = found.where(~F.col("rank").isin(3, 4, 5, 7, 8) | (F.col("best.file_path") == F.col("src_file")))
    return found.groupBy("edge").agg(F.min(F.struct("rank", "label_rank", "best.file_path", "best.start_byte", "best.id", "label", "strategy")).alias("c"))


def slim(nodes: DataFrame, unique: bool = False) -> DataFrame:
    """What resolution needs of nodes, ids once; unique: they are already."""
    there = nodes.where("id is not null")
    return (there if unique else there.dropDuplicates(["id"])).select("id", "label", "name", "file_path", "start_byte", "receiver_type", "parent_id", dirname(F.col("file_path")).alias("package"))


def resolve(raw: DataFrame, nodes: DataFrame, cross_file: bool = True, bound: DataFrame | None = None, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(resolved, rejected) for raw(id, type, src_id, dst_ref, ...); id names an edge and is unique.

    resolved has raw's columns with dst_id, src_label, dst_label, strategy and
    cross_file_edge; rejected has raw's columns with reason. A null or unknown
    reference is rejected, never lost. Each edge is looked up under its scopes,
    nine at most, in one join with one table of candidates. bound(file_path,
    ref, id) says what a name that a file imports stands for. unique: the nodes' ids are known to be there once.
    """
    spark = raw.sparkSession
    columns = raw.columns
    n = staged(slim(nodes, unique), "nodes")
    src = n.select(F.col("id").alias("src_id"), F.col("label").alias("src_label"), F.col("file_path").alias("src_file"), F.col("package").alias("src_package"))
    edges = staged(raw.join(src, "src_id", "left").select(*columns, "src_label", "src_file", "src_package"), "edges")
    keys = keys_of(n, nodes)
    if bound is not None:
        named = bound.select(F.col("file_path").alias("scope"), "ref", "id").join(n.select("id", "label", F.struct("file_path", F.coalesce("start_byte", F.lit(0)).alias("start_byte"), "id").alias("place")), "id")
        keys = keys.unionByName(named.select(F.lit("binding").alias("kind"), "scope", "ref", "label", "place"))
    best = chosen(look_ups(edges.where("src_label is not null")), candidates(keys), cross_file)
    checked = staged(judged(edges, best), "resolved")
    good = checked.where("reason is null").drop("reason", "allowed", "src_file")
    return good, checked.where("reason is not null").select(*columns, "reason")


def judged(edges: DataFrame, best: DataFrame) -> DataFrame:
    """edges(..., src_label, src_file, src_package) with their targets, and reason where there is none or the schema forbids it."""
    columns = [c for c in edges.columns if c not in ("src_label", "src_file", "src_package")]
    out = edges.join(best.withColumnRenamed("edge", "id"), "id", "left")
    out = out.select(*columns, F.col("c.id").alias("dst_id"), "src_label", F.col("c.label").alias("dst_label"), F.col("c.strategy").alias("strategy"), "src_file", (F.col("src_file") != F.col("c.file_path")).alias("cross_file_edge"))
    reason = F.when(F.col("src_label").isNull(), NO_SOURCE).when(F.col("dst_id").isNull(), NO_TARGET).when(~F.col("allowed"), NO_SCHEMA)
    return validate(out, edges.sparkSession).withColumn("reason", reason)


def validate(edges: DataFrame, spark) -> DataFrame:
    """allowed: the type's pair of labels is in the schema; types that the schema doesn't name pass."""
    rows = allowed_pairs(spark).withColumn("_ok", F.lit(True))  # bounded by the schema
    return edges.join(F.broadcast(rows), ["type", "src_label", "dst_label"], "left").withColumn("allowed", F.coalesce("_ok", ~F.col("type").isin(*EDGE_TYPES))).drop("_ok").select(*edges.columns, "allowed")


def stats(resolved: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: found, resolved, failed, cross-file."""
    good = resolved.agg(F.count("*").alias("resolved"), F.count_if("cross_file_edge").alias("cross_file"))
    bad = rejected.agg(F.count("*").alias("failed"))
    return good.crossJoin(bad).select((F.col("resolved") + F.col("failed")).alias("found"), "resolved", "failed", "cross_file")  # one row each
