"""Test-coverage analytics: one pass of joins and grouped aggregates instead of queries for each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent
from ..graph import Graph
from ..operators.patterns import pairs
from ..schema import TEST_LABELS
from ..sources.derive import indirect_covers
from .binding import graph
from .registry import query

#: Weights of the scores, as documented; fixed values.
DIRECT, ASSERTED, UNIT, INTEGRATION, INDIRECT = 0.6, 0.2, 0.1, 0.15, 0.3
UNKNOWN_CONFIDENCE, INDIRECT_CONFIDENCE, MOST_ASSERTIONS = 0.5, 0.3, 5
PRODUCTION = ("Function", "Method", "Class", "Struct", "Interface")


def production(g: Graph) -> DataFrame:
    """Entities of code labels that are neither tests nor in test files; types in test files count, as documented."""
    return g.scan(*PRODUCTION).where(~F.col("is_test") & (~F.col("is_test_file") | F.col("label").isin("Struct", "Interface")))


def tests_of(g: Graph) -> DataFrame:
    t = g.scan(*TEST_LABELS)
    return t.select(F.col("id").alias("src_id"), "test_type", F.coalesce("assertion_count", F.lit(0)).alias("assertions"), "test_framework")


def direct_tests(g: Graph) -> DataFrame:
    """(entity_id, test_id, confidence) of TESTS edges."""
    return g.rel("TESTS").select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("test_id"), F.coalesce("confidence_score", F.lit(UNKNOWN_CONFIDENCE)).alias("confidence"))


def indirect_tests(g: Graph) -> DataFrame:
    """(entity_id, test_id, confidence) of COVERS edges marked indirect."""
    return g.rel("COVERS").where("coverage_type = 'indirect'").select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("test_id"), F.lit(INDIRECT_CONFIDENCE).alias("confidence"))


def derived_indirect(g: Graph, hops: int = 3) -> DataFrame:
    """Test t covers f indirectly if t TESTS h, h calls f within so many hops, f is not h, and t doesn't TEST f."""
    found = indirect_covers(pairs(g, ("TESTS",)), pairs(g, ("CALLS",)), hops)
    return found.select(F.col("dst_id").alias("entity_id"), F.col("src_id").alias("test_id"), F.lit(INDIRECT_CONFIDENCE).alias("confidence"))


def entity_coverage(g: Graph) -> DataFrame:
    """One row for each production entity: counts, assertions, coverage and confidence scores, flags."""
    t = tests_of(g)
    a = F.least(F.col("assertions"), F.lit(MOST_ASSERTIONS)).cast("double") / MOST_ASSERTIONS
    kind = F.when(F.col("test_type") == "unit", UNIT).when(F.col("test_type") == "integration", INTEGRATION).otherwise(0.0)
    worth = F.col("confidence") * DIRECT + F.when(F.col("assertions") > 0, a * ASSERTED).otherwise(0.0) + kind
    direct = direct_tests(g).join(t.withColumnRenamed("src_id", "test_id"), "test_id", "left").groupBy("entity_id").agg(
        F.count("*").alias("direct_tests"), F.sum("assertions").alias("direct_assertions"), F.sum("confidence").alias("direct_confidence"), F.sum(worth).alias("direct_worth"),
        F.bool_or(F.col("test_type") == "unit").alias("has_unit"), F.bool_or(F.col("test_type") == "integration").alias("has_integration"),
    )
    indirect = indirect_tests(g).join(t.withColumnRenamed("src_id", "test_id"), "test_id", "left").groupBy("entity_id").agg(
        F.count("*").alias("indirect_tests"), F.sum("assertions").alias("indirect_assertions"), F.sum("confidence").alias("indirect_confidence")
    )
    x = production(g).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("label").alias("entity_type"), "file_path").join(direct, "entity_id", "left").join(indirect, "entity_id", "left")
    x = x.fillna(0, ["direct_tests", "indirect_tests", "direct_assertions", "indirect_assertions"]).fillna(0.0, ["direct_confidence", "indirect_confidence", "direct_worth"]).fillna(False, ["has_unit", "has_integration"])
    n = F.col("direct_tests") + F.col("indirect_tests")
    score = F.least(F.lit(1.0), F.col("direct_worth") + F.col("indirect_confidence") * INDIRECT)
    return x.select(
        "entity_id", "entity_name", "entity_type", "file_path", (n > 0).alias("is_covered"), "direct_tests", "indirect_tests", n.alias("test_count"),
        (F.col("direct_assertions") + F.col("indirect_assertions")).alias("assertion_count"), F.round(score, 6).alias("coverage_score"),
        F.round(F.coalesce(F.try_divide(F.col("direct_confidence") + F.col("indirect_confidence") * 0.5, n.cast("double")), F.lit(0.0)), 6).alias("confidence_score"), "has_unit", "has_integration",
    )


_ENTITY_SQL = """, d as (
  select dst, count(*) as n, sum(assertion_count) as a, sum(confidence) as c, bool_or(test_type = 'unit') as has_unit, bool_or(test_type = 'integration') as has_integration,
         sum(confidence * 0.6 + case when assertion_count > 0 then least(assertion_count, 5)::double / 5 * 0.2 else 0 end + case test_type when 'unit' then 0.1 when 'integration' then 0.15 else 0 end) as worth
  from tests join test on id = src group by dst),
i as (select dst, count(*) as n, sum(assertion_count) as a, sum(0.3::double) as c from covers join test on id = src where coverage_type = 'indirect' group by dst),
prod as (select id, name, 'Function' as label, file_path from fn union all select id, name, 'Class', file_path from cls),
ent as (
  select id as entity_id, name as entity_name, label as entity_type, file_path, coalesce(d.n, 0) + coalesce(i.n, 0) > 0 as is_covered, coalesce(d.n, 0) as direct_tests, coalesce(i.n, 0) as indirect_tests,
         coalesce(d.n, 0) + coalesce(i.n, 0) as test_count, (coalesce(d.a, 0) + coalesce(i.a, 0))::bigint as assertion_count,
         round(least(1.0, coalesce(worth, 0)::double + coalesce(i.c, 0) * 0.3)::double, 6) as coverage_score,
         round(case when coalesce(d.n, 0) + coalesce(i.n, 0) = 0 then 0 else (coalesce(d.c, 0) + coalesce(i.c, 0) * 0.5) / (coalesce(d.n, 0) + coalesce(i.n, 0)) end::double, 6) as confidence_score,
         coalesce(has_unit, false) as has_unit, coalesce(has_integration, false) as has_integration
  from prod left join d on d.dst = id left join i on i.dst = id)"""


@query("q08_entity_coverage", f"{_ENTITY_SQL} select * from ent")
def q08(spark, d):
    return entity_coverage(graph(spark, d))


@query("q06_direct_tests", "select dst as entity_id, src as test_id, confidence from tests")
def q06(spark, d):
    return direct_tests(graph(spark, d))


@query("q07_indirect_tests", "select dst as entity_id, src as test_id, 0.3::double as confidence from covers where coverage_type = 'indirect'")
def q07(spark, d):
    return indirect_tests(graph(spark, d))


@query("q07b_derived_indirect", """
, two as (select distinct a.src, b.dst from calls a join calls b on a.dst = b.src),
three as (select distinct a.src, b.dst from two a join calls b on a.dst = b.src),
flow as (select src, dst from calls union select src, dst from two union select src, dst from three)
select distinct flow.dst as entity_id, tests.src as test_id, 0.3::double as confidence from tests join flow on tests.dst = flow.src
where flow.src <> flow.dst and (tests.src, flow.dst) not in (select src, dst from tests)""")
def q07b(spark, d):
    return derived_indirect(graph(spark, d))


@query("q11_uncovered", f"{_ENTITY_SQL} select entity_id, entity_name, entity_type, file_path from ent where not is_covered")
def q11(spark, d):
    g = graph(spark, d)
    seen = direct_tests(g).select("entity_id").union(indirect_tests(g).select("entity_id"))
    return production(g).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("label").alias("entity_type"), "file_path").join(seen, "entity_id", "left_anti")


@query("q12_tests_by_target", "select dst as target_id, t.id as test_id, t.name as test_name, t.test_type from reaches join test t on t.id = src")
def q12(spark, d):
    """TESTS and COVERS together, each test of a target once."""
    g = graph(spark, d)
    t = g.scan(*TEST_LABELS).select(F.col("id").alias("test_id"), F.col("name").alias("test_name"), "test_type")
    return pairs(g, ("TESTS", "COVERS")).select(F.col("dst_id").alias("target_id"), F.col("src_id").alias("test_id")).join(t, "test_id").select("target_id", "test_id", "test_name", "test_type")


def metrics(g: Graph) -> DataFrame:
    """One row: totals, share covered, averages, and the quality score."""
    e = entity_coverage(g).agg(F.count("*").alias("total_entities"), F.count_if("is_covered").alias("covered_entities"))
    t = g.scan(*TEST_LABELS).agg(
        F.count("*").alias("total_tests"), F.coalesce(F.sum("assertion_count"), F.lit(0)).alias("total_assertions"),
        F.count_distinct(F.when(F.col("test_framework") != "", F.col("test_framework"))).alias("frameworks"), F.count_distinct(F.when(F.col("test_type") != "", F.col("test_type"))).alias("types"),
    )
    x = e.crossJoin(t)  # one row each
    share = F.coalesce(F.try_divide(F.col("covered_entities").cast("double"), F.col("total_entities").cast("double")), F.lit(0.0))
    average = F.coalesce(F.try_divide(F.col("total_assertions").cast("double"), F.col("total_tests").cast("double")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(F.col("total_tests").cast("double"), F.col("total_entities").cast("double")), F.lit(0.0))
    one = lambda c: F.least(c, F.lit(1.0))
    quality = share * 0.4 + one(ratio) * 0.2 + one(average / 3) * 0.2 + one(F.col("frameworks").cast("double") / 2) * 0.1 + one(F.col("types").cast("double") / 3) * 0.1
    return x.select(
        "total_entities", "covered_entities", "total_tests", "total_assertions", "frameworks", "types", F.round(share * 100, 6).alias("coverage_percentage"),
        F.round(average, 6).alias("average_assertions"), F.round(ratio, 6).alias("test_ratio"), F.round(quality, 6).alias("quality_score"),
    )


@query("q13_coverage_metrics", f"""{_ENTITY_SQL},
m as (
  select (select count(*) from ent)::double as e, (select count(*) from ent where is_covered)::double as c, count(*)::double as n, sum(assertion_count)::double as a,
         count(distinct test_framework)::double as f, count(distinct test_type)::double as t from test)
select e::bigint as total_entities, c::bigint as covered_entities, n::bigint as total_tests, a::bigint as total_assertions, f::bigint as frameworks, t::bigint as types,
       round(c / e * 100, 6) as coverage_percentage, round(a / n, 6) as average_assertions, round(n / e, 6) as test_ratio,
       round(c / e * 0.4::double + least(n / e, 1.0) * 0.2::double + least(a / n / 3, 1.0) * 0.2::double + least(f / 2, 1.0) * 0.1::double + least(t / 3, 1.0) * 0.1::double, 6) as quality_score from m""")
def q13(spark, d):
    return metrics(graph(spark, d))


@query("q13_coverage_by_type", f"""{_ENTITY_SQL}
select entity_type, count(*) as total, count(*) filter (where is_covered) as covered, round(count(*) filter (where is_covered)::double * 10000.0 / count(*)::double) / 100.0 as percentage from ent group by 1""")
def q13_type(spark, d):
    x = entity_coverage(graph(spark, d)).groupBy("entity_type").agg(F.count("*").alias("total"), F.count_if("is_covered").alias("covered"))
    return x.withColumn("percentage", percent(F.col("covered"), F.col("total")))


@query("q13_coverage_by_file", f"""{_ENTITY_SQL}
select file_path, count(*) as total, count(*) filter (where is_covered) as covered, round(count(*) filter (where is_covered)::double * 10000.0 / count(*)::double) / 100.0 as percentage from ent group by 1""")
def q13_file(spark, d):
    x = entity_coverage(graph(spark, d)).groupBy("file_path").agg(F.count("*").alias("total"), F.count_if("is_covered").alias("covered"))
    return x.withColumn("percentage", percent(F.col("covered"), F.col("total")))


@query("q13_frameworks_and_types", "select 'framework' as kind, test_framework as name, count(*) as n from test group by 2 union all select 'type', test_type, count(*) from test group by 2")
def q13_counts(spark, d):
    t = graph(spark, d).scan(*TEST_LABELS)
    one = lambda kind, c: t.where(F.col(c) != "").groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return one("framework", "test_framework").unionByName(one("type", "test_type"))
