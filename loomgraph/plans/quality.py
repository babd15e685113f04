"""Lookups, quality metrics, patterns and change impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, extension
from ..graph import Graph
from ..operators.patterns import named
from .binding import graph
from .registry import query


@query("q01_entity_file", "select file_path from nodes where name = 'blue_gadget' or name = 'red_widget' order by file_path, id limit 1")
def q01(spark, d, *names):
    """The file of a node by name; the first in a total order where there are several."""
    x = graph(spark, d).nodes.where(F.col("name").isin(*(names or ("blue_gadget", "red_widget"))))
    return x.orderBy("file_path", "id").limit(1).select("file_path")


@query("q02_file_entities", "select id, label, name from nodes where file_path = 'f2.ts' or file_path like '%/f2.ts'")
def q02(spark, d, path: str = "f2.ts"):
    p = F.col("file_path")
    return graph(spark, d).nodes.where((p == path) | F.endswith(p, F.lit("/" + path))).select("id", "label", "name")


@query("q03_related_files", """
, any_way as (select src, dst from edges union all select dst, src from edges)
select distinct n.file_path from edges c join any_way a on a.src = c.dst join nodes n on n.id = a.dst where c.type = 'Contains' and c.src = 'src/m2/f2.ts' and n.file_path <> 'src/m2/f2.ts'""")
def q03(spark, d, path: str = "src/m2/f2.ts"):
    g = graph(spark, d)
    own = g.rel("Contains").where(F.col("src_id") == path).select(F.col("dst_id").alias("e_id"))
    x = g.rel(direction="any").join(own, F.col("src_id") == F.col("e_id")).select(F.col("dst_id").alias("id")).distinct().join(g.nodes.select("id", "file_path"), "id")
    return x.where(F.col("file_path") != path).select("file_path").distinct().orderBy("file_path")


@query("q04_cross_file_references", """
, any_way as (select type, src, dst from edges union all select type, dst, src from edges)
select type, array_to_string(list_sort(list(distinct b.file_path)), ',') as files
from nodes a join any_way e on e.src = a.id join nodes b on b.id = e.dst where a.file_path = 'src/m2/f2.ts' and b.file_path <> a.file_path group by 1""")
def q04(spark, d, path: str = "src/m2/f2.ts"):
    g = graph(spark, d)
    own = g.nodes.where(F.col("file_path") == path).select(F.col("id").alias("src_id"))
    x = g.rel(direction="any").join(own, "src_id").join(named(g.nodes, "b", "id", "file_path"), F.col("dst_id") == F.col("b_id")).where(F.col("b_file_path") != path)
    return x.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("b_file_path")), ",").alias("files"))


@query("q05_entities_by_name", "select id, label, file_path from nodes where name = 'TestFunction' or name = 'small_ring'")
def q05(spark, d, name: str = "small_ring"):
    return graph(spark, d).nodes.where(F.col("name").isin(name, "TestFunction")).select("id", "label", "file_path")


def file_counts(g: Graph) -> DataFrame:
    """file_path, entities, functions, classes of each file's entities, tests among them."""
    own = g.nodes.where(~F.col("label").isin("File", "Endpoint"))
    return own.groupBy("file_path").agg(F.count("*").alias("entities"), F.count_if(F.col("label").isin("Function", "Method")).alias("functions"), F.count_if(F.col("label").isin("Class", "Struct")).alias("classes"))


_FILES = """, own as (
  select file_path, count(*) as entities, count(*) filter (where label in ('Function', 'Method')) as functions, count(*) filter (where label in ('Class', 'Struct')) as classes
  from nodes where label not in ('File', 'Endpoint') group by 1)"""


@query("q16_overview", f"""{_FILES}
select 'extension' as kind, regexp_extract(file_path, '(\\.[^./]+)$', 1) as name, count(*) as n from file group by 2
union all select 'complexity', case when entities <= 5 then 'simple' when entities <= 15 then 'moderate' when entities <= 30 then 'complex' else 'very_complex' end, count(*) from own group by 2""")
def q16(spark, d):
    g = graph(spark, d)
    n = F.col("entities")
    bucket = F.when(n <= 5, "simple").when(n <= 15, "moderate").when(n <= 30, "complex").otherwise("very_complex")
    by_ext = g.scan("File").groupBy(F.lit("extension").alias("kind"), extension(F.col("file_path")).alias("name")).agg(F.count("*").alias("n"))
    return by_ext.unionByName(file_counts(g).groupBy(F.lit("complexity").alias("kind"), bucket.alias("name")).agg(F.count("*").alias("n")))


def code_quality(g: Graph) -> DataFrame:
    """Per file; lines of code and cohesion are the documented constants."""
    coupling = F.coalesce(F.try_divide(F.col("entities").cast("double"), F.col("functions").cast("double")), F.lit(0.0))
    return file_counts(g).select("file_path", F.col("functions").alias("function_count"), F.col("classes").alias("class_count"), F.col("entities").alias("cyclomatic_complexity"), F.round(coupling, 6).alias("coupling"), F.lit(1.0).alias("cohesion"), F.lit(0).cast("long").alias("lines_of_code"))


_QUALITY = f"""{_FILES}, quality as (
  select file_path, functions as function_count, classes as class_count, entities as cyclomatic_complexity, round(case when functions = 0 then 0 else entities::double / functions end::double, 6) as coupling, 1.0::double as cohesion, 0::bigint as lines_of_code from own)"""


@query("q17_code_quality", f"{_QUALITY} select * from quality")
def q17(spark, d):
    return code_quality(graph(spark, d))


@query("q18_recommendations", f"""{_QUALITY}
select file_path, 'large_file' as type, 'medium' as priority from quality where function_count > 20
union all select file_path, 'high_complexity', 'high' from quality where cyclomatic_complexity > 30
union all select file_path, 'high_coupling', 'medium' from quality where coupling > 3.0""")
def q18(spark, d):
    rules = F.array_compact(F.array(
        F.when(F.col("function_count") > 20, F.struct(F.lit("large_file").alias("type"), F.lit("medium").alias("priority"))),
        F.when(F.col("cyclomatic_complexity") > 30, F.struct(F.lit("high_complexity").alias("type"), F.lit("high").alias("priority"))),
        F.when(F.col("coupling") > 3.0, F.struct(F.lit("high_coupling").alias("type"), F.lit("medium").alias("priority"))),
    ))
    return code_quality(graph(spark, d)).select("file_path", F.explode(rules).alias("r")).select("file_path", "r.*")


def architecture(g: Graph, mains: tuple = ("main.go", "app.py"), factories: tuple = ("New", "Create")) -> DataFrame:
    """(pattern, confidence, evidence): factory functions, files of more than two interfaces, several services."""
    word = F.lit(False)
    for f in factories:
        word = word | F.startswith("name", F.lit(f)) | F.endswith("name", F.lit(f))
    factory = g.scan("Function").where(word).groupBy(F.lit("factory").alias("pattern")).agg(F.count("*").alias("evidence")).select("pattern", F.lit(0.7).alias("confidence"), "evidence")
    wide = g.scan("Interface", "Class").groupBy("file_path").agg(F.count("*").alias("n")).where("n > 2").groupBy(F.lit("interface_segregation").alias("pattern")).agg(F.count("*").alias("evidence")).select("pattern", F.lit(0.6).alias("confidence"), "evidence")
    services = g.scan("File").where(basename(F.col("file_path")).isin(*mains)).groupBy(F.lit("microservices").alias("pattern")).agg(F.count("*").alias("evidence")).where("evidence > 1").select("pattern", F.lit(0.8).alias("confidence"), "evidence")
    return factory.unionByName(wide).unionByName(services)


@query("q19_architecture", """
select 'factory' as pattern, 0.7::double as confidence, count(*) as evidence from fn where starts_with(name, 'small') or ends_with(name, 'small') or starts_with(name, 'ring') or ends_with(name, 'ring') having count(*) > 0
union all select 'interface_segregation', 0.6, count(*) from (select file_path from cls group by 1 having count(*) > 2) having count(*) > 0
union all select 'microservices', 0.8, count(*) from file where split_part(file_path, '/', -1) in ('f1.py', 'f2.ts') having count(*) > 1""")
def q19(spark, d):
    return architecture(graph(spark, d), mains=("f1.py", "f2.ts"), factories=("small", "ring"))


def related_files(g: Graph, path: str) -> DataFrame:
    """Other files with an entity of a name that the file has too."""
    own = g.nodes.where((F.col("file_path") == path) & (F.col("label") != "File")).select("name").distinct()
    return g.nodes.where((F.col("file_path") != path) & (F.col("label") != "File")).join(own, "name", "left_semi").select("file_path").distinct()


@query("q20_change_impact", """
, r as (select distinct file_path from nodes where label <> 'File' and file_path <> 'src/m2/f2.ts' and name in (select name from nodes where file_path = 'src/m2/f2.ts' and label <> 'File')),
n as (select count(*) as n from r)
select n as affected_files, case when n > 10 then 'very_high' when n > 5 then 'high' when n > 2 then 'medium' else 'low' end as risk_level,
       case when n > 10 then 2 when n > 5 then 1 else 0 end::bigint as messages from n""")
def q20(spark, d, path: str = "src/m2/f2.ts"):
    n = F.col("affected_files")
    x = related_files(graph(spark, d), path).agg(F.count("*").alias("affected_files"))
    return x.select(n, F.when(n > 10, "very_high").when(n > 5, "high").when(n > 2, "medium").otherwise("low").alias("risk_level"), (F.when(n > 5, 1).otherwise(0) + F.when(n > 10, 1).otherwise(0)).cast("long").alias("messages"))


@query("a13_registry_stats", "select count(*) as entities, count(*) filter (where label = 'Function') as functions, count(*) filter (where label = 'Class') as classes, count(*) filter (where label = 'TestFunction') as tests, count(distinct file_path) as files, count(distinct name) as names from nodes")
def a13(spark, d):
    by = lambda label: F.count_if(F.col("label") == label)
    return graph(spark, d).nodes.agg(F.count("*").alias("entities"), by("Function").alias("functions"), by("Class").alias("classes"), by("TestFunction").alias("tests"), F.count_distinct("file_path").alias("files"), F.count_distinct("name").alias("names"))
