"""A property graph as two DataFrames."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import EDGE_DDL, EDGE_TYPES, LABELS, NODE_DDL, _columns, conform


class Graph:
    """nodes and edges with the canonical columns; scans, views and relations over them.

    Label and type predicates prune: on stored graphs the partition folders, on
    unions of derived tables the branches.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession

    def scan(self, *labels: str) -> DataFrame:
        """Nodes of the labels, or all."""
        return self.nodes.where(F.col("label").isin(*labels)) if labels else self.nodes

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def columns(self) -> tuple[list[str], list[str]]:
        return self.nodes.columns, self.edges.columns

    def rel(self, *types: str, direction: str = "out") -> DataFrame:
        """Edges of the types, or all. in: source and target swapped; any: both ways."""
        e = self.edges_of(*types)
        if direction == "out":
            return e
        ends = {"src_id": "dst_id", "dst_id": "src_id", "src_label": "dst_label", "dst_label": "src_label"}
        turned = e.select(*[F.col(ends.get(c, c)).alias(c) for c in e.columns])
        return turned if direction == "in" else e.unionByName(turned)

    def table(self, kind: str) -> DataFrame:
        """The edges of a type with the type's properties as columns."""
        e = self.edges_of(kind)
        kinds = {"confidence_score": "double", "is_required": "boolean"}
        own = {p: F.col(p) if p in e.columns else F.col("props")[p].cast(kinds.get(p, "string")) for p in EDGE_TYPES[kind][1]}
        return e.select("src_id", "dst_id", "src_label", "dst_label", *[c.alias(p) for p, c in own.items()])

    def create_views(self, prefix: str = "") -> None:
        """nodes, edges, a view for each label and one for each edge type, with its properties."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
        for label in LABELS:
            self.scan(label).createOrReplaceTempView(f"{prefix}{label}")
        for kind in EDGE_TYPES:
            self.table(kind).createOrReplaceTempView(f"{prefix}rel_{kind}")

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Parquet folders by label and type, ids once."""
        self.nodes.dropDuplicates(["id"]).write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
        merged = self.edges.groupBy("type", "src_id", "dst_id").agg(F.count("*").alias("call_sites"), *[F.min_by(c, F.struct("file_path", "start_byte", "id")).alias(c) for c in self.edges.columns if c not in ("type", "src_id", "dst_id", "props")], F.min_by("props", F.struct("file_path", "start_byte", "id")).alias("props"))
        merged.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")

    @staticmethod
    def read(spark, path: str) -> Graph:
        nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/satisfied")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return Graph(nodes, edges)
        return BuiltGraph(nodes, edges, tuple(spark.read.parquet(f"{path}/satisfied/{k}") for k in BuiltGraph.PARTS))

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """With more nodes; an id that is there keeps its node."""
        new = conform(nodes, NODE_DDL).dropDuplicates(["id"]).join(self.nodes.select("id"), "id", "left_anti").select(*self.nodes.columns)
        return Graph(self.nodes.unionByName(new), self.edges)

    def add_edges(self, edges: DataFrame) -> tuple[Graph, DataFrame]:
        """With more edges between nodes of the graph that the schema allows, and the others with their reason. edges: type, src_id, dst_id and properties."""
        from .operators.resolve import NO_SCHEMA, NO_SOURCE, NO_TARGET, validate

        end = lambda x: self.nodes.select(F.col("id").alias(f"{x}_id"), F.col("label").alias(f"{x}_label"))
        given = edges.drop("src_label", "dst_label").join(end("src"), "src_id", "left").join(end("dst"), "dst_id", "left")
        checked = validate(given, self.spark)
        reason = F.when(F.col("src_label").isNull(), NO_SOURCE).when(F.col("dst_label").isNull(), NO_TARGET).when(~F.col("allowed"), NO_SCHEMA)
        checked = checked.withColumn("reason", reason)
        good = conform(checked.where("reason is null"), EDGE_DDL)
        return Graph(self.nodes, self.edges.unionByName(good)), checked.where("reason is not null").select(*edges.columns, "reason")

    def without_files(self, paths: DataFrame) -> Graph:
        """Without the nodes of files (file_path), and the edges that end at them."""
        gone = self.nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
        nodes = self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns)
        edges = self.edges
        for end in ("src_id", "dst_id"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*self.edges.columns)
        return Graph(nodes, edges)

    def cypher(self, query: str, **params) -> DataFrame:
        """Runs a query of the supported Cypher subset."""
        from .plans.cypher import run

        return run(self, query, params)


class BuiltGraph(Graph):
    """A graph whose structs' IMPLEMENTS are held, and stored, between classes of structs and of interfaces with their members.

    Structs times interfaces may be as many edges as the square of the tree. They
    are made where edges of that type, or all, are asked for; plans that ask for
    other types don't have them.
    """

    PARTS = ("structs", "interfaces", "links")

    def __init__(self, nodes: DataFrame, listed: DataFrame, classes: tuple):
        from .sources.derive import expanded

        met = expanded(*classes)
        implements = conform(met, EDGE_DDL, id=F.concat(F.lit("i:"), "struct", F.lit(":"), "interface"), type=F.lit("IMPLEMENTS"), src_id=F.col("struct"), dst_id=F.col("interface"), src_label=F.lit("Struct"), dst_label=F.lit("Interface"))
        if "call_sites" in listed.columns:  # stored edges were merged by write()
            implements = implements.withColumn("call_sites", F.lit(1).cast("bigint"))
        super().__init__(nodes, listed.unionByName(implements))
        self.listed, self.classes = listed, classes

    def write(self, path: str, mode: str = "overwrite") -> None:
        """As Graph's, with the classes in a folder of their own in place of their edges."""
        Graph(self.nodes, self.listed.drop("call_sites")).write(path, mode)
        for name, part in zip(self.PARTS, self.classes):
            part.write.mode(mode).parquet(f"{path}/satisfied/{name}")


class PartedGraph(Graph):
    """A graph of which each label and each type is made when it is asked for, so a plan has the parts that it needs and no others.

    nodes: label to a function that gives its DataFrame; edges: type to several such functions.
    """

    def __init__(self, spark, nodes: dict, edges: dict):
        self.spark = spark
        self._nodes = {k: functools.cache(f) for k, f in nodes.items()}
        self._edges = {k: [functools.cache(f) for f in fs] for k, fs in edges.items()}

    def _united(self, parts: list, ddl: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [f() for f in parts]) if parts else self.spark.createDataFrame([], ddl)

    def columns(self) -> tuple[list[str], list[str]]:
        return [n for n, _ in _columns(NODE_DDL)], [n for n, _ in _columns(EDGE_DDL)]

    @functools.cached_property
    def nodes(self) -> DataFrame:
        return self.scan()

    @functools.cached_property
    def edges(self) -> DataFrame:
        return self.edges_of()

    def scan(self, *labels: str) -> DataFrame:
        return self._united([f for k, f in self._nodes.items() if not labels or k in labels], NODE_DDL)

    def edges_of(self, *types: str) -> DataFrame:
        return self._united([f for k, fs in self._edges.items() if not types or k in types for f in fs], EDGE_DDL)
