"""The sinks, services and helpers around the graph, as queries."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from ..functions.scalars import contains_word, entity_id
from ..operators import resolve as R
from ..schema import EDGE_DDL, NODE_DDL, conform
from ..streaming import changes as S
from ..streaming.events import EventBuffer, to_json
from . import reports
from .binding import graph, load
from .extraction import sources
from .registry import query
from .resolution import _SQL as RAW
from .resolution import raw_edges
from .service import run_cypher


@query("sk01_views", "select 'Function' as name, count(*) as n, null::double as confidence from fn union all select 'CALLS', count(*), null from calls union all select 'TESTS', count(*), max(confidence) from tests")
def views(spark, d):
    """Views by label and type, asked in SQL."""
    graph(spark, d).create_views("sk01_")
    return spark.sql("""select 'Function' as name, count(*) as n, cast(null as double) as confidence from sk01_Function union all select 'CALLS', count(*), null from sk01_rel_CALLS
    union all select 'TESTS', count(*), max(confidence_score) from sk01_rel_TESTS""")


def _added(spark, d):
    g = graph(spark, d)
    nation = load(spark, d, "nation")
    new = conform(nation, NODE_DDL, id=F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("fn:"), F.col("n_nationkey") + 1)).otherwise(F.concat(F.lit("new:"), "n_nationkey")), label=F.lit("Function"), name=F.col("n_name"))
    return nation, *_more(g.add_nodes(new.unionByName(new)), nation)


def _more(g, nation):
    n = F.col("n_nationkey")
    given = nation.select(
        F.when(n % 2 == 0, "CALLS").otherwise("INHERITS").alias("type"), F.concat(F.lit("new:"), n).alias("src_id"), F.when(n % 3 == 0, "nowhere").otherwise(F.concat(F.lit("fn:"), n + 1)).alias("dst_id"),
    )
    return g, *g.add_edges(conform(given, EDGE_DDL))


@query("sk03_added_nodes", "select count(*) as n, count(*) filter (where id like 'new:%') as added from (select id from fn union select 'new:' || n_nationkey from nation where n_nationkey % 5 <> 0)")
def added_nodes(spark, d):
    """An id that is there keeps its node; repeated ones come once."""
    _, g, _, _ = _added(spark, d)
    return g.scan("Function").agg(F.count("*").alias("n"), F.count_if(F.startswith("id", F.lit("new:"))).alias("added"))


@query("sk04_added_edges", """
select coalesce(case when n % 5 = 0 then 'failed to resolve source' when n % 3 = 0 then 'failed to resolve target' when n % 2 = 1 then 'schema violation' end, 'added') as outcome, count(*) as n
from (select n_nationkey as n from nation) group by 1""")
def added_edges(spark, d):
    """Edges join both ends and are checked by the schema; the others come back with their reason."""
    _, g, more, rejected = _added(spark, d)
    added = more.rel("CALLS").where(F.startswith("src_id", F.lit("new:"))).agg(F.lit("added").alias("outcome"), F.count("*").alias("n"))
    return rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n")).unionByName(added)


@query("sk05_text_result", "select string_agg(name || chr(9) || '|' || chr(9) || line, '' order by name) as text from (select n_name as name, n_regionkey || chr(10) as line from nation)")
def text_result(spark, d):
    return spark.createDataFrame([(reports.render_text(load(spark, d, "nation").select("n_name", "n_regionkey").orderBy("n_name")),)], "text string")  # 25 rows


@query("sk06_cypher_service", "select (select count(*) from ep where signature = 'GET') as result_count, true as failed")
def service(spark, d):
    """Text in, JSON out: the number of lines, and the reason of a query that can't be run."""
    g = graph(spark, d)
    good, bad = run_cypher(g, "MATCH (e:Endpoint) WHERE e.signature = $s RETURN e.name", s="GET"), run_cypher(g, "MATCH (e:Endpoint RETURN e")
    return spark.createDataFrame([(json.loads(json.dumps(good))["resultCount"], "error" in bad)], "result_count bigint, failed boolean")


@query("sk07_html_report", "select 25 + 1 as lines, count(*) as cells from nation")
def html(spark, d):
    text = reports.html_report(load(spark, d, "nation").select("n_name"), "<nations>")
    return spark.createDataFrame([(text.count("<tr>"), text.count("<td>") if "&lt;nations&gt;" in text else 0)], "lines int, cells bigint")


@query("sk08_events", "select 'Added' as type, 10 as held, count(*) - 10 as dropped from nation")
def events(spark, d):
    """A bounded buffer of events for listeners, as JSON; what doesn't fit is counted."""
    buffer = EventBuffer(10)
    for r in load(spark, d, "nation").select("n_name").collect():  # 25 rows
        buffer.offer("Added", path=r["n_name"])
    rows = [(to_json(e), buffer.dropped) for e in buffer.drain()]
    got = spark.createDataFrame(rows, "event string, dropped bigint").withColumn("type", F.get_json_object("event", "$.type"))
    return got.groupBy("type").agg(F.count("*").alias("held"), F.max("dropped").alias("dropped"))


@query("st05_initial_changes", "select 'Added' as change_type, count(*) as files, sum(s_suppkey)::bigint as entities from supplier")
def initial(spark, d):
    """A snapshot as changes, and the state that starts from it."""
    files = sources(spark, d, "py").withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    changes = S.initial_changes(files).withColumn("entities", F.regexp_extract("path", r"(\d+)\.py$", 1).cast("bigint"))
    return S.update_stats_batch(changes).groupBy("change_type").agg(F.count("*").alias("files"), F.sum("entities_added").alias("entities"))


@query("st06_manual_update", "select 'registry.py' as path, 'Modified' as change_type union all select 'gone.py', 'Deleted'")
def manual(spark, d):
    """Asked for by hand: a file of this folder, and one that isn't there."""
    here = os.path.dirname(os.path.abspath(__file__))
    return S.one_update(spark, here, "registry.py").unionByName(S.one_update(spark, here, "gone.py")).drop("ts")


@query("p13_return_all", "select id, name, signature from ep")
def everything(spark, d):
    return graph(spark, d).cypher("MATCH (e:Endpoint) RETURN *").select("e.id", "e.name", "e.signature")


@query("p14_parameters", "select id, complexity from fn where complexity >= 45 and language = 'go' and not starts_with(name, 'a')")
def parameters(spark, d):
    return graph(spark, d).cypher("MATCH (f:Function {language: $language}) WHERE f.complexity >= $least AND NOT f.name STARTS WITH $start RETURN f.id AS id, f.complexity AS complexity", language="go", least=45, start="a")


@query("f11_path_nodes", ", two as (select a.src as x, a.dst as y, b.dst as z from calls a join calls b on a.dst = b.src where (a.src, a.dst) <> (b.src, b.dst)) select 3 as steps, count(*) as paths, count(distinct y) as middles from two")
def path_nodes(spark, d):
    got = graph(spark, d).cypher("MATCH way = (a:Function)-[:CALLS*2]->(b:Function) RETURN nodes(way) AS ids")
    return got.agg(F.max(F.size("ids")).alias("steps"), F.count("*").alias("paths"), F.count_distinct(F.col("ids")[1]).alias("middles"))


@query("f14_entity_ids", "select p_partkey, substr(sha256(p_name || ':' || p_size || ':' || p_brand), 1, 16) as id from part")
def ids(spark, d):
    return load(spark, d, "part").select("p_partkey", entity_id(F.col("p_name"), F.col("p_size"), F.col("p_brand")).alias("id"))


@query("f16_contained_words", "select p_partkey from part where starts_with(p_name, 'blue') or suffix(p_name, 'blue')")
def words(spark, d):
    return load(spark, d, "part").where(contains_word(F.col("p_name"), "blue")).select("p_partkey")


_INSIDE = RAW.replace("on fn.name = ref or fn.id = ref)", "on fn.name = ref and fn.file_path = f or fn.id = ref)")


@query("j05_inside_files", f"{_INSIDE} select id, dst_id, strategy from good")
def inside(spark, d):
    """Resolution that doesn't leave the file, but for ids."""
    g, raw = raw_edges(spark, d)
    return R.resolve(raw, g.nodes, cross_file=False)[0].select("id", "dst_id", "strategy")


@query("td20_test_files", """
, paths as (select file_path as p from fn union select file_path from test union select 'web/__tests__/c' || c_custkey || '.js' from customer where c_custkey % 3 = 0 union select 'pkg/test_m' || c_custkey || '.py' from customer where c_custkey % 3 = 1 union select 'pkg/latest' || c_custkey || '.py' from customer where c_custkey % 3 = 2)
select p as file_path, regexp_matches(p, '(_test[.]go|/test_[^/]*[.]py|_test[.]py|[.](test|spec)[.][jt]sx?)$') or regexp_matches(p, '(^|/)(tests?|__tests__|spec)/') as is_test from paths""")
def test_files(spark, d):
    """Which paths are test files, by each language's rules."""
    from ..functions.scalars import is_test_path

    g, c = graph(spark, d), load(spark, d, "customer")
    k = F.col("c_custkey")
    made = c.select(F.when(k % 3 == 0, F.concat(F.lit("web/__tests__/c"), k, F.lit(".js"))).when(k % 3 == 1, F.concat(F.lit("pkg/test_m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("pkg/latest"), k, F.lit(".py"))).alias("file_path"))
    paths = g.scan("Function", "TestFunction").select("file_path").unionByName(made).distinct()
    return paths.select("file_path", is_test_path(F.col("file_path")).alias("is_test"))
