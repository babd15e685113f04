"""Resolution over the tables: each function calls a name, each test names its target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..schema import RAW_EDGE_DDL, conform
from .binding import graph, load
from .registry import query


def raw_edges(spark, d):
    g = graph(spark, d)
    part = load(spark, d, "part")
    names = part.select((F.col("p_partkey") - 7).alias("k"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("ref"))
    calls = part.join(names, F.col("p_partkey") == F.col("k")).select(
        F.concat(F.lit("c"), "p_partkey").alias("id"), F.lit("CALLS").alias("type"), F.concat(F.lit("fn:"), "p_partkey").alias("src_id"),
        F.when(F.col("p_partkey") % 50 == 0, "no_such_name").when(F.col("p_partkey") % 50 == 1, F.concat(F.lit("fn:"), F.col("p_partkey") + 1)).otherwise(F.col("ref")).alias("dst_ref"),
    )
    tests = g.scan("TestFunction").where("test_target is not null").select(F.concat(F.lit("t"), "id").alias("id"), F.lit("TESTS").alias("type"), F.col("id").alias("src_id"), F.col("test_target").alias("dst_ref"))
    wrong = load(spark, d, "nation").select(F.concat(F.lit("w"), "n_nationkey").alias("id"), F.lit("INHERITS").alias("type"), F.concat(F.lit("ep:"), "n_nationkey").alias("src_id"), F.lit("C2_11").alias("dst_ref"))
    return g, conform(calls.unionByName(tests).unionByName(wrong), RAW_EDGE_DDL)


_SQL = """, raw as (
  select 'c' || a.p_partkey as id, 'CALLS' as type, 'fn:' || a.p_partkey as src, a.file_path as f,
         case when a.p_partkey % 50 = 0 then 'no_such_name' when a.p_partkey % 50 = 1 then 'fn:' || (a.p_partkey + 1) else b.name end as ref
  from fn a join fn b on b.p_partkey = a.p_partkey + 7
  union all select 't' || id, 'TESTS', id, file_path, test_target from test where test_target is not null),
pick as (
  select raw.id, raw.type, raw.src, fn.id as dst, raw.f, fn.file_path as df,
         row_number() over (partition by raw.id order by case when fn.id = ref then 0 when fn.file_path = f then 2 when regexp_replace(fn.file_path, '/[^/]*$', '') = regexp_replace(f, '/[^/]*$', '') then 3 else 4 end, fn.file_path, fn.id) as k,
         case when fn.id = ref then 'id' when fn.file_path = f then 'file' when regexp_replace(fn.file_path, '/[^/]*$', '') = regexp_replace(f, '/[^/]*$', '') then 'package' else 'global' end as strategy
  from raw join fn on fn.name = ref or fn.id = ref),
good as (select id, type, src as src_id, dst as dst_id, strategy, f <> df as cross_file_edge from pick where k = 1)"""


@query("j02_resolved_edges", f"{_SQL} select * from good")
def j02(spark, d):
    g, raw = raw_edges(spark, d)
    return R.resolve(raw, g.nodes)[0].select("id", "type", "src_id", "dst_id", "strategy", "cross_file_edge")


@query("j07_rejected_edges", f"""{_SQL}
select id, 'failed to resolve target' as reason from raw where id not in (select id from good)
union all select 'w' || n_nationkey, case when exists (select 1 from cls where name = 'C2_11') then 'schema violation' else 'failed to resolve target' end from nation""")
def j07(spark, d):
    g, raw = raw_edges(spark, d)
    return R.resolve(raw, g.nodes)[1].select("id", "reason")


@query("a13_resolution_stats", f"{_SQL} select (select count(*) from raw) + (select count(*) from nation) as found, (select count(*) from good) as resolved, (select count(*) from raw) + (select count(*) from nation) - (select count(*) from good) as failed, (select count(*) from good where cross_file_edge) as cross_file")
def stats(spark, d):
    g, raw = raw_edges(spark, d)
    return R.stats(*R.resolve(raw, g.nodes))


@query("j06_qualified_names", "select id, split_part(file_path, '/', -2) || '.' || class_name || '.' || name as qualified from fn")
def j06(spark, d):
    g = graph(spark, d)
    return R.qualified_names(g.scan("Function", "Class")).where(F.startswith("id", F.lit("fn:")))


@query("ex13_interface_satisfaction", """
, methods as (select distinct c_nationkey as struct, (c_custkey * 7 % 50) as m from customer where c_custkey % 3 <> 0),
wanted as (select distinct p_brand as interface, p_size - 1 as m from part where p_partkey % 37 = 0)
select struct, interface from wanted join methods using (m) group by 1, 2 having count(*) = (select count(*) from wanted w where w.interface = wanted.interface)""")
def ex13(spark, d):
    """Relational division: the structs that have every method of an interface, bound to nations and brands."""
    from ..sources.derive import satisfied

    methods = load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("struct"), (F.col("c_custkey") * 7 % 50).alias("method"))
    wanted = load(spark, d, "part").where("p_partkey % 37 = 0").select(F.col("p_brand").alias("interface"), (F.col("p_size") - 1).cast("bigint").alias("method"))
    return satisfied(methods, wanted)


@query("sf1_search_lines", r"""
, lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_number from documents)
select doc_id, line_number::int as line_number, trim(line) as line from lines where contains(lower(line), 'license')""")
def sf1(spark, d):
    from .search import search_lines

    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return search_lines(docs, "license", key="doc_id", most=None)


@query("sf1_search_top", r"""
, lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_number from documents),
hits as (select doc_id, line_number::int as line_number, trim(line) as line from lines where regexp_matches(line, '(?i)rights\s+reserved'))
select *, (select count(*) from hits) as total from hits order by doc_id, line_number limit 100""")
def sf1_top(spark, d):
    from .search import search_lines

    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return search_lines(docs, r"rights\s+reserved", key="doc_id", regex=True)
