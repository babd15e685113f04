"""The catalogue of dependency and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import full_match, percent
from ..operators.patterns import count_of, cycles, exists, hop, named, not_exists, on_cycles, optional, pairs, reachable
from .binding import graph
from .registry import query

REACH = ("TESTS", "COVERS")
TF, FN, CL = ("TestFunction",), ("Function",), ("Class",)


def functions(g):
    return g.scan(*FN).where(~F.col("is_test"))


def tested_ids(g):
    """Distinct functions that a test reaches."""
    return pairs(g, REACH, TF, FN).select("dst_id").distinct()


@query("d01_all_tests", "select name, test_type, test_framework, file_path from test")
def d01(spark, d):
    return graph(spark, d).scan(*TF).select("name", "test_type", "test_framework", "file_path").orderBy("file_path", "name")


@query("d02_coverage_pairs", "select t.name as test_name, f.name as target_name, f.file_path as target_file from tests join test t on t.id = src join fn f on f.id = dst")
def d02(spark, d):
    g = graph(spark, d)
    return hop(g, "t", "f", ("TESTS",), TF).select(F.col("t_name").alias("test_name"), F.col("f_name").alias("target_name"), F.col("f_file_path").alias("target_file"))


@query("d03_uncovered_functions", "select id, name, file_path from fn where id not in (select dst from tests) and not contains(file_path, '_test')")
def d03(spark, d):
    g = graph(spark, d)
    return not_exists(g.scan(*FN), pairs(g, ("TESTS",), TF, FN).select("dst_id")).where(~F.contains("file_path", F.lit("_test"))).select("id", "name", "file_path")


@query("d04_tests_by_framework", "select test_framework, count(*) as test_count, avg(assertion_count) as avg_assertions from test group by 1")
def d04(spark, d):
    return graph(spark, d).scan(*TF).groupBy("test_framework").agg(F.count("*").alias("test_count"), F.avg("assertion_count").alias("avg_assertions")).orderBy(F.desc("test_count"), "test_framework")


@query("d05_coverage_by_file", """
select file_path as file, count(distinct f.id) as total_functions, count(distinct src) as covering_tests, count(distinct dst) as covered_functions,
       round(count(distinct src)::double * 10000.0 / count(distinct f.id)::double) / 100.0 as coverage_percent,
       round(count(distinct dst)::double * 10000.0 / count(distinct f.id)::double) / 100.0 as function_percent
from fn f left join tests on dst = f.id group by file_path""")
def d05(spark, d):
    """The documented ratio counts tests; covered_functions and function_percent are the corrected columns."""
    g = graph(spark, d)
    e = pairs(g, ("TESTS",), TF, FN)
    # counts by function first, so that no distinct count over the whole join is needed
    by_file = optional(g.scan(*FN).select("id", "file_path"), e.withColumnRenamed("dst_id", "id"), "id").groupBy("file_path")
    out = by_file.agg(F.count_distinct("id").alias("total_functions"), F.count_distinct("src_id").alias("covering_tests"), F.count_distinct(F.when(F.col("src_id").isNotNull(), F.col("id"))).alias("covered_functions"))
    return out.where("total_functions > 0").select(
        F.col("file_path").alias("file"), "total_functions", "covering_tests", "covered_functions",
        percent(F.col("covering_tests"), F.col("total_functions")).alias("coverage_percent"), percent(F.col("covered_functions"), F.col("total_functions")).alias("function_percent"),
    ).orderBy(F.desc("coverage_percent"), "file")


@query("d06_cross_file_calls", "select a.id as caller, a.file_path as caller_file, b.id as callee, b.file_path as callee_file from calls join fn a on a.id = src join fn b on b.id = dst where a.file_path <> b.file_path")
def d06(spark, d):
    x = hop(graph(spark, d), "a", "b", ("CALLS",), FN, FN).where("a_file_path <> b_file_path")
    return x.select(F.col("a_id").alias("caller"), F.col("a_file_path").alias("caller_file"), F.col("b_id").alias("callee"), F.col("b_file_path").alias("callee_file"))


@query("d07_large_bodies", "select name, file_path, length(body)::int as size from fn where length(body) > 20")
def d07(spark, d, least: int = 20):
    return graph(spark, d).scan(*FN).where(F.length("body") > least).select("name", "file_path", F.length("body").alias("size")).orderBy(F.desc("size"), "file_path", "name")


@query("d08_circular_calls", """
select distinct id, hops from (
  select src as id, 1 as hops from calls where src = dst
  union all select a.src, 2 from calls a join calls b on a.dst = b.src where b.dst = a.src and (a.src, a.dst) <> (b.src, b.dst)
  union all select a.src, 3 from calls a join calls b on a.dst = b.src join calls c on b.dst = c.src
    where c.dst = a.src and (a.src, a.dst) <> (b.src, b.dst) and (a.src, a.dst) <> (c.src, c.dst) and (b.src, b.dst) <> (c.src, c.dst))""")
def d08(spark, d, most: int = 3):
    return cycles(pairs(graph(spark, d), ("CALLS",)), most)


@query("d08_on_call_cycles", """
select distinct id from (
  with recursive r(id, reached) as (select src, dst from calls union select r.id, c.dst from r join calls c on c.src = r.reached) select id from r where id = reached)""")
def d08_any(spark, d):
    """The functions on call cycles of any length, as the reference's unbounded pattern has them; d08_circular_calls has the lengths up to 3."""
    g = graph(spark, d)
    ensure_checkpoint(spark)
    return on_cycles(pairs(g, ("CALLS",)))


@query("d09_unused_functions", "select id, name, file_path from fn where id not in (select dst from calls) and name <> 'main'")
def d09(spark, d):
    g = graph(spark, d)
    return not_exists(g.scan(*FN).where("name <> 'main'"), pairs(g, ("CALLS",)).select("dst_id")).select("id", "name", "file_path")


@query("d10_cross_file_dependencies", "select a.file_path as from_file, b.file_path as to_file, count(*) as call_count from calls join fn a on a.id = src join fn b on b.id = dst where a.file_path <> b.file_path group by 1, 2")
def d10(spark, d):
    x = hop(graph(spark, d), "a", "b", ("CALLS",), FN, FN).where("a_file_path <> b_file_path")
    return x.groupBy(F.col("a_file_path").alias("from_file"), F.col("b_file_path").alias("to_file")).agg(F.count("*").alias("call_count")).orderBy(F.desc("call_count"), "from_file", "to_file")


@query("d11_tests_per_function", "select f.id, f.name, f.file_path, count(*) as test_count from tests join fn f on f.id = dst group by all")
def d11(spark, d):
    g = graph(spark, d)
    n = g.rel("TESTS").groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("test_count"))
    return g.scan(*FN).select("id", "name", "file_path").join(n, "id").select("id", "name", "file_path", "test_count").orderBy(F.desc("test_count"), "id")


@query("d12_most_assertions", "select name, assertion_count, file_path from test where assertion_count > 0 order by assertion_count desc, name limit 10")
def d12(spark, d):
    return graph(spark, d).scan(*TF).where("assertion_count > 0").select("name", "assertion_count", "file_path").orderBy(F.desc("assertion_count"), "name").limit(10)


@query("d13_mocked_dependencies", "select t.name as test_name, f.name as entity_name, f.file_path from mocks join test t on t.id = src join fn f on f.id = dst")
def d13(spark, d):
    return hop(graph(spark, d), "t", "e", ("MOCKS",), TF).select(F.col("t_name").alias("test_name"), F.col("e_name").alias("entity_name"), F.col("e_file_path").alias("file_path")).orderBy("test_name")


@query("d14_integration_tests", "select name, file_path, test_framework from test where test_type = 'integration'")
def d14(spark, d):
    return graph(spark, d).scan(*TF).where("test_type = 'integration'").select("name", "file_path", "test_framework")


@query("d15_go_calls_python", "select a.name as go_name, b.name as py_name, a.file_path as go_file, b.file_path as py_file from calls join fn a on a.id = src join fn b on b.id = dst where a.file_path like '%.go' and b.file_path like '%.py'")
def d15(spark, d):
    x = hop(graph(spark, d), "go", "py", ("CALLS",), FN, FN).where(F.endswith("go_file_path", F.lit(".go")) & F.endswith("py_file_path", F.lit(".py")))
    return x.select("go_name", "py_name", F.col("go_file_path").alias("go_file"), F.col("py_file_path").alias("py_file"))


def overall(g):
    """Two aggregates; the second pattern carries the first, so there is no row where nothing is tested."""
    total = functions(g).agg(F.count("*").alias("total_functions"))
    tested = exists(functions(g), tested_ids(g)).agg(F.count("*").alias("tested_functions")).where("tested_functions > 0")
    return total.crossJoin(tested)  # one row each


@query("d16_overall_coverage", "select (select count(*) from fn) as total_functions, count(distinct dst) as tested_functions, round(count(distinct dst)::double * 10000.0 / (select count(*) from fn)::double) / 100.0 as coverage_percentage from reaches having count(*) > 0")
def d16(spark, d):
    return overall(graph(spark, d)).withColumn("coverage_percentage", percent(F.col("tested_functions"), F.col("total_functions")))


def members(g, prefix="m"):
    """(c_id, m_id) of classes and the functions in them."""
    return g.rel("Contains").where("src_label = 'Class' and dst_label = 'Function'").select(F.col("src_id").alias("c_id"), F.col("dst_id").alias(f"{prefix}_id"))


def class_counts(g):
    """c_id, total_methods, tested_methods: an inner pattern for the total, an optional two-hop one for the tests."""
    tested = tested_ids(g).select(F.col("dst_id").alias("m_id"), F.lit(1).alias("hit"))
    return members(g).join(tested, "m_id", "left").groupBy("c_id").agg(F.count("*").alias("total_methods"), F.count("hit").alias("tested_methods"))


CLASS_SQL = """, counts as (
  select parent_id as c_id, count(*) as total_methods, count(distinct case when id in (select dst from reaches) then id end) as tested_methods from fn group by 1)"""


@query("d17_class_coverage", f"""{CLASS_SQL}
select name as class_name, file_path as file, total_methods, tested_methods, round(tested_methods::double * 10000.0 / total_methods::double) / 100.0 as method_coverage from counts join cls on id = c_id""")
def d17(spark, d):
    g = graph(spark, d)
    x = g.scan(*CL).join(class_counts(g), F.col("id") == F.col("c_id"))
    return x.select(F.col("name").alias("class_name"), F.col("file_path").alias("file"), "total_methods", "tested_methods", percent(F.col("tested_methods"), F.col("total_methods")).alias("method_coverage")).orderBy("method_coverage", "class_name")


@query("d18_file_coverage", """
select f.file_path, count(distinct e.dst) as total_entities, count(distinct case when e.dst in (select dst from reaches) then e.dst end) as tested_entities,
       round(count(distinct case when e.dst in (select dst from reaches) then e.dst end)::double * 10000.0 / count(distinct e.dst)::double) / 100.0 as coverage_percentage
from file f join edges e on e.src = f.id and e.type = 'Contains' and e.dst_label in ('Function', 'Class', 'Method')
where not contains(f.file_path, '.test.') and not contains(f.file_path, '.spec.') group by 1""")
def d18(spark, d):
    g = graph(spark, d)
    files = g.scan("File").where(~F.contains("file_path", F.lit(".test.")) & ~F.contains("file_path", F.lit(".spec."))).select("id", "file_path")
    held = g.rel("Contains").where("src_label = 'File'").where(F.col("dst_label").isin("Function", "Class", "Method")).select(F.col("src_id").alias("id"), "dst_id").distinct()
    hit = tested_ids(g).withColumn("hit", F.lit(1))
    x = files.join(held, "id").join(hit, "dst_id", "left").groupBy("file_path").agg(F.count("*").alias("total_entities"), F.count("hit").alias("tested_entities"))
    return x.withColumn("coverage_percentage", percent(F.col("tested_entities"), F.col("total_entities"))).orderBy("coverage_percentage", "file_path")


@query("d19_untested_functions", "select name as function_name, file_path as file, line_number as line, complexity from fn where id not in (select dst from reaches) and name not like '\\_%' escape '\\'")
def d19(spark, d):
    g = graph(spark, d)
    x = not_exists(functions(g).where(~F.startswith("name", F.lit("_"))), tested_ids(g))
    return x.select(F.col("name").alias("function_name"), F.col("file_path").alias("file"), F.col("line_number").alias("line"), "complexity").orderBy(F.desc("complexity"), "file", "line")


@query("d20_untested_classes", """
select c.name as class_name, c.file_path as file, count(f.id) as method_count, 0::bigint as property_count
from cls c left join fn f on f.parent_id = c.id
where c.id not in (select parent_id from fn where id in (select dst from reaches)) group by 1, 2""")
def d20(spark, d):
    g = graph(spark, d)
    direct = pairs(g, REACH, TF, CL).select("dst_id")
    through = members(g).join(tested_ids(g).withColumnRenamed("dst_id", "m_id"), "m_id", "left_semi").select("c_id")
    x = not_exists(not_exists(g.scan(*CL), direct), through).select("id", "name", "file_path")
    x = count_of(x, members(g).select("c_id"), "id", "method_count")
    x = count_of(x, g.rel("Contains").where("src_label = 'Class' and dst_label = 'Property'").select("src_id"), "id", "property_count")
    return x.select(F.col("name").alias("class_name"), F.col("file_path").alias("file"), "method_count", "property_count").orderBy(F.desc("method_count"), "class_name")


@query("d21_untested_endpoints", "select name as endpoint_path, signature as http_method, file_path as file from ep where id not in (select dst from api)")
def d21(spark, d):
    g = graph(spark, d)
    x = not_exists(g.scan("Endpoint"), pairs(g, ("TESTS", "TESTS_API"), TF, ("Endpoint",)).select("dst_id"))
    return x.select(F.col("name").alias("endpoint_path"), F.col("signature").alias("http_method"), F.col("file_path").alias("file")).orderBy("endpoint_path")


@query("d22_partly_tested_classes", f"""{CLASS_SQL}
select c.name as class_name, c.file_path as file, total_methods, tested_methods, array_to_string(list_sort(list(f.name)), ',') as untested_methods
from counts join cls c on c.id = c_id join fn f on f.parent_id = c.id and f.id not in (select dst from reaches)
where tested_methods > 0 and tested_methods < total_methods group by 1, 2, 3, 4""")
def d22(spark, d):
    g = graph(spark, d)
    partly = class_counts(g).where("tested_methods > 0 and tested_methods < total_methods")
    untested = not_exists(g.scan(*FN).select(F.col("id").alias("m_id"), F.col("name").alias("m_name")), tested_ids(g), "m_id")
    x = members(g).join(untested, "m_id").join(partly, "c_id").join(named(g.scan(*CL), "c", "id", "name", "file_path"), "c_id")
    x = x.groupBy(F.col("c_id"), F.col("c_name").alias("class_name"), F.col("c_file_path").alias("file"), "total_methods", "tested_methods").agg(F.array_join(F.array_sort(F.collect_list("m_name")), ",").alias("untested_methods"))
    return x.orderBy(F.col("tested_methods") / F.col("total_methods"), "class_name").drop("c_id")


@query("d23_critical_untested", """
select name as function_name, file_path as file, count(distinct src) as used_by_count, complexity, count(distinct src) * coalesce(complexity, 1) as priority_score
from fn join calls on dst = id where id not in (select dst from reaches) group by id, name, file_path, complexity having count(distinct src) > 2""")
def d23(spark, d):
    g = graph(spark, d)
    used = pairs(g, ("CALLS",)).groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("used_by_count")).where("used_by_count > 2")
    x = not_exists(functions(g).join(used, "id"), tested_ids(g))
    score = F.col("used_by_count") * F.coalesce("complexity", F.lit(1))
    return x.select(F.col("name").alias("function_name"), F.col("file_path").alias("file"), "used_by_count", "complexity", score.alias("priority_score")).orderBy(F.desc("priority_score"), "file", "function_name")


@query("d24_complex_untested", "select id, name as function_name, file_path as file, line_number as line, complexity from fn where complexity > 5 and id not in (select dst from reaches) order by complexity desc, id limit 20")
def d24(spark, d):
    g = graph(spark, d)
    x = not_exists(functions(g).where("complexity > 5"), tested_ids(g))
    return x.select("id", F.col("name").alias("function_name"), F.col("file_path").alias("file"), F.col("line_number").alias("line"), "complexity").orderBy(F.desc("complexity"), "id").limit(20)


@query("d25_exported_untested", "select name as function_name, file_path as file, signature from fn where is_exported and id not in (select dst from reaches)")
def d25(spark, d):
    g = graph(spark, d)
    return not_exists(functions(g).where("is_exported"), tested_ids(g)).select(F.col("name").alias("function_name"), F.col("file_path").alias("file"), "signature").orderBy("file", "function_name")


@query("d26_test_quality", """
, per as (select t.id, any_value(assertion_count) as assertion_count, count(dst) as mock_count from test t left join mocks on src = t.id group by t.id)
select avg(assertion_count) as avg_assertions_per_test, min(assertion_count) as min_assertions, max(assertion_count) as max_assertions, avg(mock_count) as avg_mocks_per_test,
       count(case when assertion_count = 0 then 1 end) as tests_without_assertions, count(*) as total_tests from per""")
def d26(spark, d):
    g = graph(spark, d)
    per = count_of(g.scan(*TF).select("id", "assertion_count"), g.rel("MOCKS").select("src_id"), "id", "mock_count")
    return per.agg(
        F.avg("assertion_count").alias("avg_assertions_per_test"), F.min("assertion_count").alias("min_assertions"), F.max("assertion_count").alias("max_assertions"),
        F.avg("mock_count").alias("avg_mocks_per_test"), F.count_if(F.col("assertion_count") == 0).alias("tests_without_assertions"), F.count("*").alias("total_tests"),
    )


@query("d27_test_types", "select test_type, count(*) as count, round(count(*)::double * 10000.0 / (select count(*) from test)::double) / 100.0 as percentage from test group by 1")
def d27(spark, d):
    from pyspark.sql import Window

    x = graph(spark, d).scan(*TF).groupBy("test_type").agg(F.count("*").alias("count"))
    # the window runs over a row for each type
    return x.withColumn("percentage", percent(F.col("count"), F.sum("count").over(Window.partitionBy()))).orderBy(F.desc("count"), "test_type")


@query("d28_coverage_by_module", """
, held as (select f.file_path, e.dst from file f join edges e on e.src = f.id and e.type = 'Contains' and e.dst_label in ('Function', 'Class') where not f.is_test_file),
modules as (select regexp_replace(file_path, '/[^/]*$', '') as module, count(distinct file_path) as file_count from file where not is_test_file group by 1)
select module, file_count, count(distinct dst) as total_entities, count(distinct case when dst in (select dst from reaches) then dst end) as tested_entities,
       round(count(distinct case when dst in (select dst from reaches) then dst end)::double * 10000.0 / count(distinct dst)::double) / 100.0 as coverage_percentage
from modules join held on starts_with(file_path, module || '/') group by 1, 2""")
def d28(spark, d):
    """A file counts for its folder and each folder above; the prefixes of a path are listed, so the prefix join is an equi-join."""
    g = graph(spark, d)
    files = g.scan("File").where(~F.col("is_test_file")).select("id", "file_path")
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    under = files.where(F.size(parts) > 1).select("id", F.explode(above).alias("module"))
    modules = files.groupBy(F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 2), F.element_at(parts, 1), lambda s, x: F.concat(s, F.lit("/"), x)).alias("module")).agg(F.count("*").alias("file_count"))
    held = g.rel("Contains").where("src_label = 'File'").where(F.col("dst_label").isin("Function", "Class")).select(F.col("src_id").alias("id"), "dst_id").distinct()
    hit = tested_ids(g).withColumn("hit", F.lit(1))
    x = under.join(modules, "module").join(held, "id").join(hit, "dst_id", "left").groupBy("module", "file_count").agg(F.count("*").alias("total_entities"), F.count("hit").alias("tested_entities"))
    return x.withColumn("coverage_percentage", percent(F.col("tested_entities"), F.col("total_entities"))).orderBy("module")


@query("d29_typescript_coverage", """
select (select count(*) from fn where language = 'typescript') as total_functions, count(distinct dst) as tested_functions,
       round(count(distinct dst)::double * 10000.0 / (select count(*) from fn where language = 'typescript')::double) / 100.0 as function_coverage
from reaches join fn on id = dst where language = 'typescript'""")
def d29(spark, d):
    g = graph(spark, d)
    ts = functions(g).where("language = 'typescript'")
    x = ts.agg(F.count("*").alias("total_functions")).crossJoin(exists(ts, tested_ids(g)).agg(F.count("*").alias("tested_functions")))  # one row each
    return x.withColumn("function_coverage", percent(F.col("tested_functions"), F.col("total_functions")))


@query("d29_python_untested", "select name, file_path, signature from fn where language = 'python' and split_part(signature, '(', 1) in ('ECONOMY', 'PROMO') and id not in (select dst from reaches)")
def d29_python(spark, d):
    """The decorator list is bound to the signature's first part."""
    g = graph(spark, d)
    tags = F.split("signature", "\\(")
    x = functions(g).where("language = 'python'").where(F.exists(tags, lambda t: t.isin("ECONOMY", "PROMO")))
    return not_exists(x, tested_ids(g)).select("name", "file_path", "signature").orderBy("file_path")


@query("d29_go_implementations", f"""{CLASS_SQL}
select i.name as base_name, c.name as implementation, total_methods, tested_methods, round(tested_methods::double * 10000.0 / total_methods::double) / 100.0 as coverage_percentage
from inherits join cls i on i.id = dst join cls c on c.id = src join counts on c_id = src""")
def d29_go(spark, d):
    """Bound to INHERITS, the class-to-class edge of the tables."""
    g = graph(spark, d)
    x = hop(g, "c", "i", ("INHERITS",), CL, CL).join(class_counts(g), "c_id")
    return x.select(F.col("i_name").alias("base_name"), F.col("c_name").alias("implementation"), "total_methods", "tested_methods", percent(F.col("tested_methods"), F.col("total_methods")).alias("coverage_percentage")).orderBy("coverage_percentage", "implementation")


@query("d30_integration_flows", """
, two as (select distinct a.src, b.dst from calls a join calls b on a.dst = b.src),
three as (select distinct a.src, b.dst from two a join calls b on a.dst = b.src),
flow as (select src, dst from calls union select src, dst from two union select src, dst from three)
select t.name as integration_test, e.name as api_endpoint, count(distinct flow.dst) as functions_covered
from api join test t on t.id = api.src join ep e on e.id = api.dst join served on served.dst = e.id join flow on flow.src = served.src
where t.test_type = 'integration' group by 1, 2""")
def d30(spark, d):
    """Functions within three calls of an endpoint's handlers. Counted by endpoint first: tests of one endpoint share the count."""
    g = graph(spark, d)
    served = pairs(g, ("EXPOSES_ENDPOINT",)).select(F.col("src_id").alias("h"), F.col("dst_id").alias("e_id"))
    flow = reachable(pairs(g, ("CALLS",)), 1, 3)
    by_endpoint = served.join(flow, F.col("h") == F.col("src_id")).select("e_id", "dst_id").distinct().groupBy("e_id").agg(F.count("*").alias("functions_covered"))
    x = hop(g, "t", "e", ("TESTS_API",), TF, ("Endpoint",), columns=("id", "name", "test_type")).where("t_test_type = 'integration'").join(by_endpoint, "e_id")
    return x.select(F.col("t_name").alias("integration_test"), F.col("e_name").alias("api_endpoint"), "functions_covered").orderBy(F.desc("functions_covered"), "integration_test")


@query("d31_mutation_readiness", """
select f.name as function_name, f.file_path as file, count(*) as test_count, sum(t.assertion_count)::bigint as total_assertions,
       round(sum(t.assertion_count)::double * 100.0 / count(*)::double) / 100.0 as assertions_per_test
from reaches join fn f on f.id = dst join test t on t.id = src group by f.id, f.name, f.file_path having count(*) >= 3 and sum(t.assertion_count) >= count(*) * 2""")
def d31(spark, d):
    g = graph(spark, d)
    x = pairs(g, REACH, TF, FN).join(named(g.scan(*TF), "t", "id", "assertion_count"), F.col("src_id") == F.col("t_id"))
    x = x.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("test_count"), F.sum("t_assertion_count").alias("total_assertions")).where("test_count >= 3 and total_assertions >= test_count * 2")
    per = F.round(F.col("total_assertions").cast("double") * 100.0 / F.col("test_count").cast("double")) / 100.0
    return functions(g).select("id", "name", "file_path").join(x, "id").select(F.col("name").alias("function_name"), F.col("file_path").alias("file"), "test_count", "total_assertions", per.alias("assertions_per_test")).orderBy(F.desc("test_count"), "function_name")


@query("d32_test_effectiveness", """
, per as (
  select t.id, t.name, t.test_type, t.assertion_count as a, (select count(*) from mocks where src = t.id) as m, (select count(distinct dst) from edges e where e.src = t.id and e.type in ('TESTS', 'COVERS')) as n from test t),
scored as (
  select *, case when a = 0 then 0 when a <= 2 then 1 when a <= 5 then 2 else 3 end + case when m = 0 then 0 when m <= 2 then 1 else 2 end + case when n = 0 then 0 when n = 1 then 1 else 2 end as score from per)
select name as test_name, test_type as type, score as effectiveness_score, case when score >= 6 then 'Excellent' when score >= 4 then 'Good' when score >= 2 then 'Fair' else 'Poor' end as rating from scored""")
def d32(spark, d):
    g = graph(spark, d)
    x = count_of(g.scan(*TF).select("id", "name", "test_type", "assertion_count"), g.rel("MOCKS").select("src_id"), "id", "mocks")
    x = count_of(x, pairs(g, REACH, TF).select("src_id"), "id", "targets")
    a, m, n = F.col("assertion_count"), F.col("mocks"), F.col("targets")
    score = F.when(a == 0, 0).when(a <= 2, 1).when(a <= 5, 2).otherwise(3) + F.when(m == 0, 0).when(m <= 2, 1).otherwise(2) + F.when(n == 0, 0).when(n == 1, 1).otherwise(2)
    x = x.withColumn("effectiveness_score", score)
    s = F.col("effectiveness_score")
    return x.select(F.col("name").alias("test_name"), F.col("test_type").alias("type"), s, F.when(s >= 6, "Excellent").when(s >= 4, "Good").when(s >= 2, "Fair").otherwise("Poor").alias("rating")).orderBy(F.desc("effectiveness_score"), "test_name")


@query("d33_coverage_gate", """
, c as (select count(distinct dst)::double * 100.0 / (select count(*) from fn)::double as p from reaches)
select p as coverage_percentage, 80.0::double as threshold, p >= 80.0 as gate_passed, case when p >= 80.0 then 'PASS: Coverage threshold met' else 'FAIL: Coverage below threshold' end as gate_status from c""")
def d33(spark, d, threshold: float = 80.0):
    x = overall(graph(spark, d)).select((F.col("tested_functions").cast("double") * 100.0 / F.col("total_functions").cast("double")).alias("coverage_percentage"), F.lit(float(threshold)).alias("threshold"))
    x = x.withColumn("gate_passed", F.col("coverage_percentage") >= F.col("threshold"))
    return x.withColumn("gate_status", F.when(F.col("gate_passed"), "PASS: Coverage threshold met").otherwise("FAIL: Coverage below threshold"))


@query("d33_new_code_coverage", """
, changed as (select distinct 'fn:' || l_partkey as id from lineitem where l_shipdate > timestamp '2001-12-31' - interval 365 day)
select (select count(*) from fn join changed using (id)) as new_functions, count(distinct dst) as tested_new_functions,
       round(count(distinct dst)::double * 10000.0 / (select count(*) from fn join changed using (id))::double) / 100.0 as new_code_coverage
from reaches join changed on id = dst""")
def d33_new(spark, d, now: str = "2001-12-31", days: int = 365):
    """A function's last change is its last shipment; now is a parameter, so that a result can be had again."""
    from .binding import load

    g = graph(spark, d)
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    changed = load(spark, d, "lineitem").where(F.col("l_shipdate") > since).select(F.concat(F.lit("fn:"), "l_partkey").alias("id")).distinct()
    new = exists(functions(g), changed)
    x = new.agg(F.count("*").alias("new_functions")).crossJoin(exists(new, tested_ids(g)).agg(F.count("*").alias("tested_new_functions")))  # one row each
    return x.withColumn("new_code_coverage", percent(F.col("tested_new_functions"), F.col("new_functions")))


@query("d33_coverage_trend", """
, snaps as (
  select date_trunc('month', o_orderdate)::date as month, 'fn:' || l_partkey as id from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F' and l_returnflag = 'R' and o_orderpriority in ('1-URGENT', '2-HIGH')),
firsts as (select id, min(month) as month from snaps group by 1)
select month, sum(count(*)) over (order by month)::bigint as tested_functions, (select count(*) from fn) as total_functions from firsts group by month""")
def d33_trend(spark, d):
    """Functions tested by the end of each month; the window runs over a row for each month."""
    from pyspark.sql import Window

    from .binding import load

    o = load(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
    x = o.join(load(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"))
    firsts = x.groupBy("l_partkey").agg(F.min(F.trunc("o_orderdate", "month")).alias("month")).groupBy("month").agg(F.count("*").alias("n"))
    total = functions(graph(spark, d)).agg(F.count("*").alias("total_functions"))
    return firsts.select("month", F.sum("n").over(Window.orderBy("month")).alias("tested_functions")).crossJoin(total)  # one row


@query("d34_json_summary", """
select '{"total_functions":' || (select count(*) from fn) || ',"tested_functions":' || count(distinct dst) || ',"tests":' || (select count(*) from test) || '}' as report from reaches""")
def d34(spark, d):
    from .reports import json_report

    g = graph(spark, d)
    return json_report(overall(g).crossJoin(g.scan(*TF).agg(F.count("*").alias("tests"))))  # one row each


@query("d35_find_function", "select id, name, file_path, signature from fn where name = 'small_ring'")
def d35(spark, d, name: str = "small_ring"):
    return graph(spark, d).scan(*FN).where(F.col("name") == name).select("id", "name", "file_path", "signature")


@query("d35_references", "select a.id as caller, a.file_path, b.id as target from calls join fn a on a.id = src join fn b on b.id = dst where b.name = 'small_ring'")
def d35_references(spark, d, name: str = "small_ring"):
    g = graph(spark, d)
    target = g.scan(*FN).where(F.col("name") == name).select(F.col("id").alias("dst_id"))
    x = g.rel("CALLS").join(target, "dst_id").select("src_id", "dst_id").join(named(g.scan(*FN), "a", "id", "file_path"), F.col("src_id") == F.col("a_id"))
    return x.select(F.col("a_id").alias("caller"), F.col("a_file_path").alias("file_path"), F.col("dst_id").alias("target"))


@query("d35_class_methods", "select name, signature from fn where class_name = 'C2_11'")
def d35_methods(spark, d, name: str = "C2_11"):
    g = graph(spark, d)
    return hop(g, "c", "m", ("Contains",), CL, FN, columns=("id", "name", "signature")).where(F.col("c_name") == name).select(F.col("m_name").alias("name"), F.col("m_signature").alias("signature"))


@query("d36_locate_entity", "select label, file_path, count(*) as entities from nodes where name = 'small_ring' group by all")
def d36_locate(spark, d, name: str = "small_ring"):
    return graph(spark, d).nodes.where(F.col("name") == name).groupBy("label", "file_path").agg(F.count("*").alias("entities"))


@query("d36_entities_of_file", """
select label, name, case label when 'Class' then 1 when 'Function' then 2 else 3 end as kind_rank from nodes where label <> 'File' and file_path like '%/f2.ts'""")
def d36_entities(spark, d, suffix: str = "/f2.ts"):
    x = graph(spark, d).nodes.where((F.col("label") != "File") & F.endswith("file_path", F.lit(suffix)))
    return x.select("label", "name", F.when(F.col("label") == "Class", 1).when(F.col("label") == "Function", 2).otherwise(3).alias("kind_rank")).orderBy("kind_rank", "name")


@query("d36_entity_counts", "select file_path, count(*) as entity_count, array_to_string(list_sort(list(distinct label)), ',') as kinds from nodes where label <> 'File' group by 1")
def d36_counts(spark, d):
    x = graph(spark, d).nodes.where("label <> 'File'").groupBy("file_path").agg(F.count("*").alias("entity_count"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("kinds"))
    return x.orderBy(F.desc("entity_count"), "file_path")


@query("d36_test_files", "select file_path, count(*) as tests from test where contains(file_path, '_test') group by 1")
def d36_tests(spark, d):
    return graph(spark, d).scan(*TF).where(F.contains("file_path", F.lit("_test"))).groupBy("file_path").agg(F.count("*").alias("tests")).orderBy("file_path")


@query("d36_related_by_kind", """
, any_way as (select type, src, dst from edges union all select type, dst, src from edges)
select b.file_path, array_to_string(list_sort(list(distinct type)), ',') as kinds, count(*) as links
from any_way join nodes a on a.id = src join nodes b on b.id = dst where a.file_path = 'src/m2/f2.ts' and b.file_path <> a.file_path and a.label <> 'File' and b.label <> 'File' group by 1""")
def d36_related(spark, d, path: str = "src/m2/f2.ts"):
    g = graph(spark, d)
    own = g.nodes.where((F.col("file_path") == path) & (F.col("label") != "File")).select(F.col("id").alias("src_id"))
    x = g.rel(direction="any").join(own, "src_id").join(named(g.nodes.where("label <> 'File'"), "b", "id", "file_path"), F.col("dst_id") == F.col("b_id"))
    x = x.where(F.col("b_file_path") != path)
    return x.groupBy(F.col("b_file_path").alias("file_path")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("kinds"), F.count("*").alias("links")).orderBy("file_path")


@query("d37_regex_files", "select file_path, language from file where regexp_full_match(file_path, '.*_test\\.(ts|py)') or regexp_full_match(file_path, '.*\\.spec\\.(ts|tsx)')")
def d37_files(spark, d):
    x = graph(spark, d).scan("File").where(full_match(F.col("file_path"), r".*_test\.(ts|py)") | full_match(F.col("file_path"), r".*\.spec\.(ts|tsx)"))
    return x.select("file_path", "language")


@query("d37_tests_of_function", """
select f.id, f.name, f.file_path, count(t.id) as direct_test_count, coalesce(array_to_string(list_sort(list(t.name) filter (where t.id is not null)), ','), '') as test_names
from fn f left join tests on dst = f.id left join test t on t.id = src where f.language = 'typescript' and f.name = 'small_ring' group by 1, 2, 3""")
def d37_tests(spark, d, name: str = "small_ring", lang: str = "typescript"):
    g = graph(spark, d)
    f = g.scan(*FN).where((F.col("name") == name) & (F.col("language") == lang)).select("id", "name", "file_path")
    t = hop(g, "t", "f", ("TESTS",), TF, FN).select(F.col("f_id").alias("id"), "t_name")
    x = optional(f, t, "id").groupBy("id", "name", "file_path").agg(F.count("t_name").alias("direct_test_count"), F.array_join(F.array_sort(F.collect_list("t_name")), ",").alias("test_names"))
    return x


@query("d37_untested_components", "select name, file_path from cls where regexp_full_match(file_path, '.*\\.(ts|tsx)') and regexp_full_match(name, '.*_1\\d?') and id not in (select dst from tests)")
def d37_components(spark, d):
    g = graph(spark, d)
    x = g.scan(*CL).where(full_match(F.col("file_path"), r".*\.(ts|tsx)") & full_match(F.col("name"), r".*_1\d?"))
    return not_exists(x, pairs(g, ("TESTS",), TF, CL).select("dst_id")).select("name", "file_path")


@query("d37_cross_language_handlers", """
select t.name as test_name, e.name as endpoint, h.name as handler, h.language from api join test t on t.id = api.src join ep e on e.id = api.dst join served on served.dst = e.id join fn h on h.id = served.src
where t.language = 'typescript' and h.language in ('go', 'python')""")
def d37_handlers(spark, d):
    g = graph(spark, d)
    calls = hop(g, "t", "e", ("TESTS_API",), TF, ("Endpoint",), columns=("id", "name", "language")).where("t_language = 'typescript'")
    served = hop(g, "h", "e", ("EXPOSES_ENDPOINT",), FN, ("Endpoint",), columns=("id", "name", "language")).where(F.col("h_language").isin("go", "python")).select("e_id", "h_name", "h_language")
    return calls.join(served, "e_id").select(F.col("t_name").alias("test_name"), F.col("e_name").alias("endpoint"), F.col("h_name").alias("handler"), F.col("h_language").alias("language"))


@query("d36_files_of_class", "select distinct file_path from cls where name = 'C2_11'")
def d36_class_files(spark, d, name: str = "C2_11"):
    return graph(spark, d).scan(*CL).where(F.col("name") == name).select("file_path").distinct()


@query("d36_cross_file_calls", """
select a.name as caller, a.file_path as from_file, b.name as callee, b.file_path as to_file
from calls join fn a on a.id = src join fn b on b.id = dst where a.file_path <> b.file_path""")
def d36_calls_between_files(spark, d):
    """All of them; the documented example shows any ten."""
    x = hop(graph(spark, d), "a", "b", ("CALLS",)).where("a_file_path <> b_file_path")
    return x.select(F.col("a_name").alias("caller"), F.col("a_file_path").alias("from_file"), F.col("b_name").alias("callee"), F.col("b_file_path").alias("to_file"))


@query("d36_context_of_file", """
select label, name, coalesce(signature, 'N/A') as signature, case label when 'Import' then 1 when 'Struct' then 2 when 'Interface' then 3 when 'Function' then 4 when 'Method' then 5 else 6 end as kind_rank
from nodes where file_path = 'src/m2/f2.ts'""")
def d36_context(spark, d, path: str = "src/m2/f2.ts"):
    """What a file has, kind by kind, with signatures."""
    x = graph(spark, d).nodes.where(F.col("file_path") == path)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CONTEXT_ORDER)), F.col("label")), F.lit(0))
    rank = F.when(rank == 0, len(CONTEXT_ORDER) + 1).otherwise(rank).cast("int")
    return x.select("label", "name", F.coalesce("signature", F.lit("N/A")).alias("signature"), rank.alias("kind_rank")).orderBy("kind_rank", "name")


#: The order of kinds in a file's context; others come after these. Fixed values.
CONTEXT_ORDER = ("Import", "Struct", "Interface", "Function", "Method")


@query("d37_framework_statistics", "select test_framework as framework, count(*) as tests, avg(assertion_count) as avg_assertions from test where language = 'typescript' group by 1")
def d37_frameworks(spark, d, lang: str = "typescript"):
    x = graph(spark, d).scan(*TF).where(F.col("language") == lang).groupBy(F.col("test_framework").alias("framework"))
    return x.agg(F.count("*").alias("tests"), F.avg("assertion_count").alias("avg_assertions")).orderBy(F.desc("tests"), "framework")


@query("d38_label_histogram", "select label, count(*) as n from nodes group by 1")
def d38(spark, d):
    return graph(spark, d).nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


@query("d38_call_strings", "select a.name || ' -> ' || b.name as call, count(*) as n from calls join fn a on a.id = src join fn b on b.id = dst group by 1")
def d38_calls(spark, d):
    x = hop(graph(spark, d), "a", "b", ("CALLS",))
    return x.groupBy(F.concat("a_name", F.lit(" -> "), "b_name").alias("call")).agg(F.count("*").alias("n"))


@query("d38_inheritance_strings", "select a.name || ' extends ' || b.name as text from inherits join cls a on a.id = src join cls b on b.id = dst")
def d38_inherits(spark, d):
    return hop(graph(spark, d), "a", "b", ("INHERITS",), CL, CL).select(F.concat("a_name", F.lit(" extends "), "b_name").alias("text"))


@query("j17_walks_of_three", "select count(*) as walks from calls a join calls b on a.dst = b.src join calls c on b.dst = c.src where (a.src, a.dst) <> (b.src, b.dst) and (a.src, a.dst) <> (c.src, c.dst) and (b.src, b.dst) <> (c.src, c.dst)")
def j17(spark, d):
    from ..operators.patterns import walks

    return walks(pairs(graph(spark, d), ("CALLS",)), 3, 3).agg(F.count("*").alias("walks"))


@query("j11_undirected_degree", "select id, count(*) as degree from (select src as id from calls union all select dst from calls) group by 1")
def j11(spark, d):
    return graph(spark, d).rel("CALLS", direction="any").groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("degree"))


@query("j17_closure", """
, recursive_start as (select 'fn:0' as id)
select count(*) as reached from (
  with recursive r(id, depth) as (select 'fn:0', 0 union select c.dst, 0 from r join calls c on c.src = r.id) select distinct id from r)""")
def j17_closure(spark, d, start: str = "fn:0"):
    from ..operators.patterns import closure

    g = graph(spark, d)
    ensure_checkpoint(spark)
    return closure(pairs(g, ("CALLS",)).checkpoint(), spark.createDataFrame([(start,)], "id string")).agg(F.count("*").alias("reached"))


def ensure_checkpoint(spark):
    """The shared folder of the session, or a temporary one where none is set."""
    from ..sources.folders import shared_root

    shared_root(spark)


@query("sc09_label_alternation", "select label, count(*) as n, min(name) as first_name from nodes where label in ('Function', 'Class') group by 1")
def sc09(spark, d):
    return graph(spark, d).scan("Function", "Class").groupBy("label").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("sc10_type_alternation", "select type, count(*) as n from edges where type in ('TESTS', 'COVERS', 'MOCKS') group by 1")
def sc10(spark, d):
    return graph(spark, d).rel("TESTS", "COVERS", "MOCKS").groupBy("type").agg(F.count("*").alias("n"))


