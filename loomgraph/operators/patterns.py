"""Graph patterns as joins."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..sources.folders import dropped, replaced, staged


def named(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """The columns, or all, as prefix_column."""
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in columns or df.columns])


def hop(g: Graph, a: str, b: str, types: tuple, labels_a: tuple = (), labels_b: tuple = (), direction: str = "out", columns: tuple = ("id", "name", "file_path"), props: tuple = ()) -> DataFrame:
    """(a)-[:types]->(b): a row for each edge, with a_column, b_column and the edge's props."""
    e = g.rel(*types, direction=direction).select(F.col("src_id").alias(f"{a}_id"), F.col("dst_id").alias(f"{b}_id"), *props)
    left, right = named(g.scan(*labels_a), a, *columns), named(g.scan(*labels_b), b, *columns)
    return e.join(left, f"{a}_id").join(right, f"{b}_id")


def pairs(g: Graph, types: tuple, src_labels: tuple = (), dst_labels: tuple = (), direction: str = "out") -> DataFrame:
    """Distinct (src_id, dst_id) of edges between the labels; no node is read, as edges carry their ends' labels."""
    e = g.rel(*types, direction=direction)
    if src_labels:
        e = e.where(F.col("src_label").isin(*src_labels))
    if dst_labels:
        e = e.where(F.col("dst_label").isin(*dst_labels))
    return e.select("src_id", "dst_id").distinct()


def exists(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """Rows whose id is among ids' only column."""
    return df.join(ids.toDF(on), on, "left_semi")


def not_exists(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return df.join(ids.toDF(on), on, "left_anti")


def optional(df: DataFrame, pattern: DataFrame, on) -> DataFrame:
    """OPTIONAL MATCH: pattern, joined beforehand where it has several hops, is one unit."""
    return df.join(pattern, on, "left")


#: A level of unbounded walks with more rows is an error; cycles that share nodes make their number grow without measure.
MOST_WALKS = 50_000_000


def walks(edges: DataFrame, low: int, high: int | None) -> DataFrame:
    """(src_id, dst_id, hops, path) for each walk of low to high edges that uses no edge twice; path has the nodes.

    edges: distinct (src_id, dst_id). One join a hop; high bounds the plan.
    Without high, levels are made and checkpointed until one is empty; one of
    more than MOST_WALKS rows raises OverflowError.
    """
    if high is None:
        edges = edges.checkpoint()
    step = edges.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d"))
    at = edges.select("src_id", "dst_id", F.lit(1).alias("hops"), F.array("src_id", "dst_id").alias("path"))
    levels = [at]
    for k in count(2) if high is None else range(2, high + 1):
        nxt = at.join(step, F.col("dst_id") == F.col("_s"))
        used = F.exists(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: (F.element_at("path", i) == F.col("_s")) & (F.element_at("path", i + 1) == F.col("_d")))
        at = nxt.where(~used).select("src_id", F.col("_d").alias("dst_id"), F.lit(k).alias("hops"), F.concat("path", F.array("_d")).alias("path"))
        if high is None:
            at = at.limit(MOST_WALKS + 1).checkpoint()
            n = at.count()
            if n > MOST_WALKS:
                raise OverflowError(f"more than {MOST_WALKS} walks of {k} edges: state an upper bound")
            if not n:
                break
        levels.append(at)
    return reduce(DataFrame.unionByName, levels[low - 1 :] or [edges.limit(0).select("src_id", "dst_id", F.lit(1).alias("hops"), F.array("src_id", "dst_id").alias("path"))])


def reachable(edges: DataFrame, low: int, high: int) -> DataFrame:
    """Distinct (src_id, dst_id) joined by a walk of low to high edges; a level is made distinct before the next, so it grows by pairs, not walks."""
    step = edges.select(F.col("src_id").alias("_s"), F.col("dst_id").alias("_d")).distinct()
    at = edges.select("src_id", "dst_id").distinct()
    levels = [at]
    for _ in range(2, high + 1):
        at = at.join(step, F.col("dst_id") == F.col("_s")).select("src_id", F.col("_d").alias("dst_id")).distinct()
        levels.append(at)
    return reduce(DataFrame.unionByName, levels[low - 1 :]).distinct()


def closure(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(id, depth) of what start's ids reach, each node once at its least depth: a level is joined against what is seen.

    It goes on until a level has no new node; if there still is one after most levels, it raises OverflowError.
    """
    step = staged(edges.select(F.col("src_id").alias("_from"), F.col("dst_id").alias("id")).distinct(), "step")
    seen = staged(start.toDF("id").distinct().withColumn("depth", F.lit(0)), "seen")
    front = staged(seen, "front")
    for d in count(1):
        new = front.select(F.col("id").alias("_from")).join(step.hint("merge"), "_from").select("id").distinct().join(seen.hint("merge"), "id", "left_anti").withColumn("depth", F.lit(d))
        front = replaced(new, "front", front)
        if front.isEmpty():
            break
        if most is not None and d > most:
            raise OverflowError(f"nodes are more than {most} edges away")
        seen = replaced(seen.unionByName(front), "seen", seen)
    dropped(step, front)
    return seen


def cycles(edges: DataFrame, most: int) -> DataFrame:
    """(id, hops) of nodes on closed walks of at most so many edges."""
    return walks(edges, 1, most).where("src_id = dst_id").select(F.col("src_id").alias("id"), "hops").distinct()


def on_cycles(edges: DataFrame) -> DataFrame:
    """Distinct id of the nodes on closed walks of any number of edges."""
    return strong_components(edges).select("id")


#: So many rounds of taking off ends pass before runs are contracted.
ENDS_FIRST = 8


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes on closed walks: one row each, component is one of its nodes; nodes on no closed walk have no row.

    Nodes without edges on both sides go first. Runs of nodes with one edge in
    and one out become an edge by pointer doubling, so paths and rings of n nodes
    take about log n rounds. In what is left each node takes the least id that
    reaches it; edges between different labels are in no cycle, and what reaches
    a label's own node under that label is that node's component. It leaves, and
    the rest is done again. Runs are then laid out again: one is in a component
    if both its ends are. Rows stay linear in the edges; rounds follow the
    longest path among nodes of three or more edges. Repeated edges count once,
    an edge with a null end is none, no edges give no rows.
    """
    left = edges.where("src_id <> dst_id").select("src_id", "dst_id").distinct().checkpoint()
    ends, levels, found = 0, [], []
    while True:
        both = left.select(F.col("src_id").alias("id"), F.col("dst_id").alias("at"), F.lit(1).alias("outs"))
        nodes = both.unionByName(left.select(F.col("dst_id").alias("id"), F.lit(0).alias("outs")), allowMissingColumns=True)
        nodes = nodes.groupBy("id").agg(F.max("at").alias("at"), F.sum("outs").alias("outs"), F.sum(1 - F.col("outs")).alias("ins"))
        n = nodes.agg(F.count("*").alias("all"), F.count_if(F.expr("ins = 0 or outs = 0")).alias("ends"), F.count_if(F.expr("ins = 1 and outs = 1")).alias("inner")).first()
        if not n["all"]:
            break
        inner = nodes.where("ins = 1 and outs = 1").select("id", "at")
        due = n["inner"] and (ends >= ENDS_FIRST or not n["ends"])
        if due and not inner.join(inner.select(F.col("id").alias("at")), "at", "left_semi").isEmpty():
            rings, runs, links = _runs(left, inner)
            found.append(rings)
            levels.append((runs, links))
            left, ends = replaced(links.where("src_id <> dst_id").select("src_id", "dst_id").distinct(), "left", left), 0
        elif n["ends"]:
            on = left.join(left.select(F.col("dst_id").alias("src_id")).distinct().hint("merge"), "src_id", "left_semi")
            left = replaced(on.join(on.select(F.col("src_id").alias("dst_id")).distinct().hint("merge"), "dst_id", "left_semi").select("src_id", "dst_id"), "left", left)
            ends += 1
        else:
            part, left = _least_labels(left)
            found.append(part)
    none = edges.select(F.col("src_id").alias("id"), F.col("src_id").alias("component")).limit(0)
    out = reduce(DataFrame.unionByName, found, none)
    for runs, links in reversed(levels):
        out = staged(out, "found")
        own = links.join(out.toDF("src_id", "_s").hint("merge"), "src_id", "left").join(out.toDF("dst_id", "_d").hint("merge"), "dst_id", "left")
        own = staged(own.where("run is not null and (src_id = dst_id or _s = _d)").select("run", "src_id", "_s", F.coalesce("_s", "src_id").alias("component")), "own")
        bent = own.where("_s is null").select(F.col("src_id").alias("id"), "component").distinct()
        out = out.unionByName(bent).unionByName(runs.join(own.select("run", "component").hint("merge"), "run").select("id", "component"))
    loops = edges.where("src_id = dst_id").select(F.col("src_id").alias("id"), F.col("src_id").alias("component")).distinct()
    out = staged(out, "found")
    return out.unionByName(loops.join(out.hint("merge"), "id", "left_anti"))


def _runs(left: DataFrame, inner: DataFrame):
    """Rings (id, component), nodes of runs (id, run) and the edges (src_id, dst_id, run) between the others; run, by its last node, is null for an edge as it was.

    inner: (id, at), the nodes with one edge in and one out, and where that leads.
    A row's pointer goes twice as far each round; after rounds that end no more
    runs, the rows whose pointers are still among inner nodes are on rings.
    """
    inner = staged(inner, "inner")
    live = inner.select(F.col("id").alias("at"), F.lit(True).alias("live"))
    at = staged(inner.join(live.hint("merge"), "at", "left").select("id", "at", F.col("id").alias("run"), F.col("id").alias("low"), F.coalesce("live", F.lit(False)).alias("live")), "at")
    before, n, covered = -1, at.where("live").count(), 1
    while n and not (n == before and covered >= n):
        onward = at.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("run").alias("_run"), F.col("low").alias("_low"), F.col("live").alias("_live"))
        moved = at.where("live").join(onward.hint("merge"), "at").select("id", F.col("_at").alias("at"), F.col("_run").alias("run"), F.least("low", "_low").alias("low"), F.col("_live").alias("live"))
        at = replaced(at.where("not live").unionByName(moved), "at", at)
        before, n, covered = n, at.where("live").count(), covered * 2
    rings = at.where("live").select("id", F.col("low").alias("component"))
    runs = at.where("not live").select("id", "run")
    outer = left.join(inner.select(F.col("id").alias("src_id")).hint("merge"), "src_id", "left_anti")
    links = outer.join(at.where("not live").select(F.col("id").alias("dst_id"), "at", "run").hint("merge"), "dst_id", "left")
    return rings, runs, replaced(links.select("src_id", F.coalesce("at", "dst_id").alias("dst_id"), "run"), "links", inner)


def _least_labels(left: DataFrame):
    """Components (id, component) of several nodes that hold the least id reaching them, and the edges that touch no settled node."""
    labels = staged(left.select(F.col("src_id").alias("id")).union(left.select("dst_id")).distinct().select("id", F.col("id").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        low = left.join(labels.where("moved").select(F.col("id").alias("src_id"), "label").hint("merge"), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.min("label").alias("low"))
        new = labels.join(low.hint("merge"), "id", "left").select("id", F.least("label", "low").alias("label"), F.coalesce(F.col("low") < F.col("label"), F.lit(False)).alias("moved"))
        labels = replaced(new, "labels", labels)
    labels = labels.select("id", "label")
    ends = left.join(labels.toDF("src_id", "_s").hint("merge"), "src_id").join(labels.toDF("dst_id", "_d").hint("merge"), "dst_id")
    left = replaced(ends.where("_s = _d").select("src_id", "dst_id"), "left", left)
    back = left.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    settled = closure(back, labels.where("id = label").select("id")).select("id")
    part = settled.join(labels.hint("merge"), "id")
    several = part.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    part = staged(part.join(several.hint("merge"), "label", "left_semi").select("id", F.col("label").alias("component")), "part")
    rest = left.join(settled.toDF("src_id").hint("merge"), "src_id", "left_anti").join(settled.toDF("dst_id").hint("merge"), "dst_id", "left_anti").select("src_id", "dst_id")
    return part, replaced(rest, "left", left, labels, settled)


def count_of(df: DataFrame, pattern: DataFrame, key: str, name: str) -> DataFrame:
    """size() of a pattern: rows of pattern (its only column named key) for each row of df, 0 where there is none."""
    n = pattern.toDF(key).groupBy(key).agg(F.count("*").alias(name))
    return df.join(n, key, "left").fillna(0, [name])


#: Of a value's rows of either side so many are in a slice at most, and so many in a list: 504 are one bit-packed run of a Parquet file, so a list that comes again is the same bytes.
MOST_HELD, LISTED = 1 << 17, (32, 504)


def every_pair(left: DataFrame, right: DataFrame, on: str, left_rows: int = 1 << 12, right_rows: int = 1 << 16, alike: tuple = (), where: str | None = None) -> DataFrame:
    """The rows of left.join(right, on) where few values are shared by many rows of either side, so that the pairs, not the rows, are the work.

    A value's rows are cut into slices, each two of which meet in one task: as many as it takes to deal the pairs
    to all tasks, left_rows times right_rows of them at least, so what is moved grows with the rows and not with
    the pairs. Rows move once and are then listed; a task holds a slice of at most MOST_HELD rows, and two lists give
    their pairs one after the other, so that a file of them repeats itself within a few kB and stays small. Rows
    that are alike in the columns `alike` are listed together, and the condition `where` on these is asked once for
    two lists. left is staged, since its values are counted first. Null meets nothing.
    """
    left = staged(left, "left")
    sizes = staged(left.groupBy(on).agg(F.count("*").alias("_l")).join(right.groupBy(on).agg(F.count("*").alias("_r")), on), "sizes")
    tasks = 8 * left.sparkSession.sparkContext.defaultParallelism
    pairs = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0
    meetings = F.ceil(F.col("_l").cast("double") * F.col("_r") / max(left_rows * right_rows, pairs / (4 * tasks)))
    sizes = sizes.withColumn("_rs", F.least("_r", F.greatest(F.lit(1), F.round(F.sqrt(meetings * F.col("_r") / F.col("_l"))), F.ceil(F.col("_r") / MOST_HELD)).cast("int")))
    sizes = sizes.withColumn("_ls", F.least("_l", F.greatest(F.ceil(meetings / F.col("_rs")), F.ceil(F.col("_l") / MOST_HELD))).cast("int"))
    keys, both = [on, "_i", "_j"], (left, right)
    own = [[c for c in df.columns if c == on or c in alike] for df in both]
    listed = [[c for c in df.columns if c not in own[k]] or [on] for k, df in enumerate(both)]

    def lists(k):
        df, (mine, other) = both[k], (("_ls", "_rs"), ("_rs", "_ls"))[k]
        at = F.pmod(F.xxhash64(*df.columns), F.col(mine)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = df.join(sizes, on).select(*own[k], F.struct(*listed[k]).alias("_v"), at[k].alias("_i"), at[1 - k].alias("_j"))
        # a given number of tasks, since adaptive plans would put them together by their bytes
        out = rows.repartition(tasks, *keys).groupBy(*own[k], "_i", "_j").agg(F.collect_list("_v").alias("_v"))
        values = F.transform("_v", lambda x: x[listed[k][0]]) if len(listed[k]) == 1 else F.col("_v")  # a list of structs is the slower one
        n = LISTED[k]
        out = out.select(*own[k], "_i", "_j", values.alias("_v")).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("_v"), F.lit(n))))
        return out.select(*own[k], "_i", "_j", F.slice("_v", F.col("_at"), n).alias(f"_v{k}"))

    met = lists(0).join(lists(1).hint("merge"), keys)
    # nothing is put together here; it parts the generated code, which would hold the pairs of a list with all that it meets
    met = (met.where(where) if where else met).coalesce(16 * tasks)
    for k in (0, 1):
        met = met.withColumn(f"_v{k}", F.explode(f"_v{k}"))
    value = {c: F.col(f"_v{k}") if len(listed[k]) == 1 else F.col(f"_v{k}")[c] for k in (0, 1) for c in listed[k] if c != on}
    return met.select(*[value.get(c, F.col(c)).alias(c) for c in [on, *(c for df in both for c in df.columns if c != on)]])
