"""The graph as a view over the star-schema tables, and the same in SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename
from ..graph import PartedGraph
from ..schema import EDGE_DDL, NODE_DDL, conform

_EXT = {0: (".go", "go"), 1: (".py", "python"), 2: (".ts", "typescript")}


def _by_rest(n, k: int):
    return F.when(n % 3 == 0, _EXT[0][k]).when(n % 3 == 1, _EXT[1][k]).otherwise(_EXT[2][k])


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark, sf_dir: str) -> PartedGraph:
    """part: functions in files by brand, classes by brand and size; customer: tests; orders and lineitem: edges; nation: endpoints."""
    table = cache(lambda name: load(spark, sf_dir, name))

    @cache
    def part():
        df = table("part").withColumn("bn", F.substring("p_brand", 7, 5).cast("int"))
        path = F.concat(F.lit("src/m"), F.col("bn") % 5, F.lit("/f"), F.col("bn"), _by_rest(F.col("bn"), 0))
        return df.select(
            F.concat(F.lit("fn:"), "p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), path.alias("file_path"), _by_rest(F.col("bn"), 1).alias("language"),
            F.concat("p_type", F.lit("("), "p_size", F.lit(")")).alias("signature"), F.concat("p_name", F.lit(" "), "p_type").alias("body"),
            F.col("p_size").alias("complexity"), (F.col("p_partkey") % 500).alias("line_number"), (F.col("p_partkey") % 2 == 0).alias("is_exported"),
            F.concat(F.lit("class:"), "bn", F.lit(":"), "p_size").alias("parent_id"), F.concat(F.lit("C"), "bn", F.lit("_"), "p_size").alias("class_name"), "p_partkey",
        )

    @cache
    def functions():
        return conform(part(), NODE_DDL, label=F.lit("Function"))

    @cache
    def classes():
        return conform(part().select(F.col("parent_id").alias("id"), F.col("class_name").alias("name"), "file_path", "language", "complexity").distinct(), NODE_DDL, label=F.lit("Class"))

    @cache
    def tests():
        names = part().select(F.col("p_partkey").alias("c_custkey"), F.col("name").alias("test_target"))
        return conform(
            table("customer").join(names, "c_custkey", "left"), NODE_DDL,
            id=F.concat(F.lit("test:"), "c_custkey"), label=F.lit("TestFunction"), name=F.concat(F.lit("Test"), "c_custkey"),
            file_path=F.concat(F.lit("tests/t"), "c_nationkey", F.lit("_test"), _by_rest(F.col("c_custkey"), 0)), language=_by_rest(F.col("c_custkey"), 1),
            is_test=F.lit(True), is_test_file=F.lit(True), test_framework=F.col("c_mktsegment"), assertion_count=F.col("c_custkey") % 6,
            test_type=F.when(F.col("c_nationkey") % 3 == 0, "unit").when(F.col("c_nationkey") % 3 == 1, "integration").otherwise("e2e"),
        )

    def files():
        own = functions().select("file_path", "language").distinct().withColumn("is_test_file", F.lit(False))
        own = own.unionByName(tests().select("file_path", "language").distinct().withColumn("is_test_file", F.lit(True)))
        return conform(own, NODE_DDL, id=F.col("file_path"), label=F.lit("File"), name=basename(F.col("file_path")))

    def endpoints():
        return conform(
            table("nation"), NODE_DDL, id=F.concat(F.lit("ep:"), "n_nationkey"), label=F.lit("Endpoint"), name=F.concat(F.lit("/api/"), F.lower("n_name")),
            signature=F.when(F.col("n_regionkey") % 2 == 0, "GET").otherwise("POST"), file_path=F.concat(F.lit("api/r"), "n_regionkey", _by_rest(F.col("n_regionkey"), 0)), language=_by_rest(F.col("n_regionkey"), 1),
        )

    def tested(priority, kind, **more):
        def made():
            rows = table("orders").where(f"o_orderstatus = 'F' and o_orderpriority = '{priority}'").join(table("lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"))
            rows = rows.groupBy("o_custkey", "l_partkey").agg((1 - F.max("l_discount")).alias("confidence"), F.min("l_linestatus").alias("status"))
            return conform(rows, EDGE_DDL, type=F.lit(kind), src_id=F.concat(F.lit("test:"), "o_custkey"), dst_id=F.concat(F.lit("fn:"), "l_partkey"), src_label=F.lit("TestFunction"), dst_label=F.lit("Function"), **more)

        return made

    def calls():
        returned = table("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey")
        following = returned.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_part"))
        both = returned.join(following, ["l_orderkey", "l_linenumber"]).select("l_partkey", "to_part").distinct()
        return conform(both, EDGE_DDL, type=F.lit("CALLS"), src_id=F.concat(F.lit("fn:"), "l_partkey"), dst_id=F.concat(F.lit("fn:"), "to_part"), src_label=F.lit("Function"), dst_label=F.lit("Function"))

    def inside(nodes, label):
        return lambda: conform(nodes().select("id", F.col("file_path").alias("_f")), EDGE_DDL, id=F.lit(None), type=F.lit("Contains"), src_id=F.col("_f"), dst_id=F.col("id"), src_label=F.lit("File"), dst_label=F.lit(label))

    def members():
        return conform(part().select("id", "parent_id"), EDGE_DDL, id=F.lit(None), type=F.lit("Contains"), src_id=F.col("parent_id"), dst_id=F.col("id"), src_label=F.lit("Class"), dst_label=F.lit("Function"))

    def inherits():
        smaller = classes().select(F.col("file_path").alias("_f"), (F.col("complexity") + 1).alias("_c"), F.col("id").alias("_id"))
        both = classes().select("id", "file_path", "complexity").join(smaller, (F.col("file_path") == F.col("_f")) & (F.col("complexity") == F.col("_c")))
        return conform(both, EDGE_DDL, type=F.lit("INHERITS"), src_id=F.col("id"), dst_id=F.col("_id"), src_label=F.lit("Class"), dst_label=F.lit("Class"), id=F.lit(None), file_path=F.lit(None))

    def served():
        rows = part().where("p_partkey % 10 = 0").join(table("nation"), F.expr("p_partkey div 10 % 25 = n_nationkey"))
        return conform(rows.select("id", "n_nationkey"), EDGE_DDL, id=F.lit(None), type=F.lit("EXPOSES_ENDPOINT"), src_id=F.col("id"), dst_id=F.concat(F.lit("ep:"), "n_nationkey"), src_label=F.lit("Function"), dst_label=F.lit("Endpoint"))

    def api():
        return conform(table("customer").where("c_nationkey % 3 = 1 and c_custkey % 4 = 0"), EDGE_DDL, type=F.lit("TESTS_API"), src_id=F.concat(F.lit("test:"), "c_custkey"), dst_id=F.concat(F.lit("ep:"), "c_nationkey"), src_label=F.lit("TestFunction"), dst_label=F.lit("Endpoint"))

    return PartedGraph(
        spark, {"Function": functions, "Class": classes, "TestFunction": tests, "File": files, "Endpoint": endpoints},
        {
            "TESTS": [tested("1-URGENT", "TESTS", confidence_score=F.col("confidence"))],
            "COVERS": [tested("2-HIGH", "COVERS", coverage_type=F.when(F.col("status") == "O", "indirect").otherwise("direct"))],
            "MOCKS": [tested("3-MEDIUM", "MOCKS")], "CALLS": [calls], "INHERITS": [inherits], "EXPOSES_ENDPOINT": [served], "TESTS_API": [api],
            "Contains": [inside(functions, "Function"), inside(classes, "Class"), inside(tests, "TestFunction"), members],
        },
    )


_SQL_EXT = "case {0} % 3 when 0 then '.go' when 1 then '.py' else '.ts' end"
_SQL_LANG = "case {0} % 3 when 0 then 'go' when 1 then 'python' else 'typescript' end"

#: The same tables for DuckDB.
SQL = f"""
with parts as (select *, substr(p_brand, 7)::int as bn from part),
fn as (
  select 'fn:' || p_partkey as id, replace(p_name, ' ', '_') as name, 'src/m' || (bn % 5) || '/f' || bn || {_SQL_EXT.format('bn')} as file_path, {_SQL_LANG.format('bn')} as language,
         p_type || '(' || p_size || ')' as signature, p_name || ' ' || p_type as body, p_size::int as complexity, (p_partkey % 500)::int as line_number, p_partkey % 2 = 0 as is_exported,
         'class:' || bn || ':' || p_size as parent_id, 'C' || bn || '_' || p_size as class_name, p_partkey from parts),
cls as (select distinct parent_id as id, class_name as name, file_path, language, complexity from fn),
test as (
  select 'test:' || c_custkey as id, 'Test' || c_custkey as name, 'tests/t' || c_nationkey || '_test' || {_SQL_EXT.format('c_custkey')} as file_path, {_SQL_LANG.format('c_custkey')} as language,
         c_mktsegment as test_framework, (c_custkey % 6)::bigint as assertion_count, case c_nationkey % 3 when 0 then 'unit' when 1 then 'integration' else 'e2e' end as test_type,
         fn.name as test_target from customer left join fn on p_partkey = c_custkey),
file as (
  select distinct file_path as id, split_part(file_path, '/', -1) as name, file_path, language, false as is_test_file from fn
  union all select distinct file_path, split_part(file_path, '/', -1), file_path, language, true from test),
ep as (
  select 'ep:' || n_nationkey as id, '/api/' || lower(n_name) as name, case when n_regionkey % 2 = 0 then 'GET' else 'POST' end as signature,
         'api/r' || n_regionkey || {_SQL_EXT.format('n_regionkey')} as file_path, {_SQL_LANG.format('n_regionkey')} as language from nation),
nodes as (
  select id, 'Function' as label, name, file_path, language, signature, complexity, false as is_test from fn
  union all select id, 'Class', name, file_path, language, null, complexity, false from cls
  union all select id, 'TestFunction', name, file_path, language, null, null, true from test
  union all select id, 'File', name, file_path, language, null, null, false from file
  union all select id, 'Endpoint', name, file_path, language, signature, null, false from ep),
sold as (
  select o_orderpriority, o_custkey, l_partkey, 1 - max(l_discount) as confidence, min(l_linestatus) as status
  from orders join lineitem on o_orderkey = l_orderkey
  where o_orderstatus = 'F' and l_returnflag = 'R' group by all),
tests as (select 'test:' || o_custkey as src, 'fn:' || l_partkey as dst, confidence from sold where o_orderpriority = '1-URGENT'),
covers as (select 'test:' || o_custkey as src, 'fn:' || l_partkey as dst, case when status = 'O' then 'indirect' else 'direct' end as coverage_type from sold where o_orderpriority = '2-HIGH'),
mocks as (select 'test:' || o_custkey as src, 'fn:' || l_partkey as dst from sold where o_orderpriority = '3-MEDIUM'),
reaches as (select src, dst from tests union select src, dst from covers),
calls as (
  select distinct 'fn:' || a.l_partkey as src, 'fn:' || b.l_partkey as dst from lineitem a
  join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_returnflag = 'R' and b.l_returnflag = 'R'),
inherits as (select a.id as src, b.id as dst from cls a join cls b on a.file_path = b.file_path and a.complexity = b.complexity + 1),
served as (select id as src, 'ep:' || n_nationkey as dst from fn join nation on p_partkey % 10 = 0 and p_partkey // 10 % 25 = n_nationkey),
api as (select 'test:' || c_custkey as src, 'ep:' || c_nationkey as dst from customer where c_nationkey % 3 = 1 and c_custkey % 4 = 0),
edges as (
  select 'TESTS' as type, src, dst, 'TestFunction' as src_label, 'Function' as dst_label from tests
  union all select 'COVERS', src, dst, 'TestFunction', 'Function' from covers
  union all select 'MOCKS', src, dst, 'TestFunction', 'Function' from mocks
  union all select 'CALLS', src, dst, 'Function', 'Function' from calls
  union all select 'Contains', file_path, id, 'File', 'Function' from fn
  union all select 'Contains', file_path, id, 'File', 'Class' from cls
  union all select 'Contains', file_path, id, 'File', 'TestFunction' from test
  union all select 'Contains', parent_id, id, 'Class', 'Function' from fn
  union all select 'INHERITS', src, dst, 'Class', 'Class' from inherits
  union all select 'EXPOSES_ENDPOINT', src, dst, 'Function', 'Endpoint' from served
  union all select 'TESTS_API', src, dst, 'TestFunction', 'Endpoint' from api)
"""
