"""The live graph and derived edges under change, over the tables: what stands after several updates is what the final state gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_dir
from ..streaming import derived, event_log, keyed_state, live_graph
from ..streaming.store import BucketStore, latest
from .binding import graph, load
from .registry import query
from .text_index import search, update_index
from .streams import _SQL as CHANGES
from .streams import file_changes

BUCKETS = 16


def _last_events(spark, d, parts: tuple = (0.8, 0.9, 1.0)) -> list[DataFrame]:
    """events cut by time into batches, of each user's events in a batch the last one."""
    e = load(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = e.agg(F.min("at"), F.max("at")).first()
    out, before = [], None
    for p in parts:
        until = low + int((high - low) * p)
        part = e.where(F.col("at") <= until) if before is None else e.where((F.col("at") > before) & (F.col("at") <= until))
        out.append(part.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id", "ts"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*"))
        before = until
    return out


def _path(u):
    return F.concat(F.lit("src/m"), u % 7, F.lit("/u"), u, F.lit(".py"))


@query("st04_live_graph", """
, ended as (select user_id as u, arg_max(event_type, (ts, event_id)) as kind, arg_max(event_id, (ts, event_id)) as e from events group by 1),
alive as (select 'src/m' || (u % 7) || '/u' || u || '.py' as path, 'src/m' || (u % 7) as folder, 'f' || (u % 50) as name, 'f' || ((u + e % 10) % 50) as ref from ended where kind <> 'error'),
met as (select a.path as source, b.path as target, case when a.path = b.path then 'file' when a.folder = b.folder then 'package' else 'global' end as strategy from alive a join alive b on b.name = a.ref)
select source, target, strategy, source <> target as cross_file_edge from met
qualify row_number() over (partition by source order by case strategy when 'file' then 0 when 'package' then 1 else 2 end, target) = 1""")
def st04_live(spark, d):
    """A user is a file that defines a function and calls another by name; its events change or delete it. Three updates, of which the later ones resolve again only what they touch."""
    path = shared_dir(spark, "live")
    for number, batch in enumerate(_last_events(spark, d)):
        u = F.col("user_id")
        text = F.concat(F.lit("def f"), u % 50, F.lit("():\n    return f"), (u + F.col("event_id") % 10) % 50, F.lit("()\n"))
        files = batch.select(_path(u).alias("path"), text.alias("content"))
        changes = batch.select(_path(u).alias("path"), F.when(F.col("event_type") == "error", "Deleted").otherwise("Modified").alias("change_type"), "ts")
        live_graph.apply_batch(spark, changes, number, lambda wanted, files=files: files.join(wanted.select("path"), "path", "left_semi"), path, BUCKETS)
    there = latest(spark, path).read("nodes", live_graph.NODE_DDL).select(F.col("id").alias("dst_id"), F.col("file_path").alias("target"))
    return live_graph.answers(spark, path).where("type = 'CALLS'").join(there, "dst_id").select(F.col("file_path").alias("source"), "target", "strategy", "cross_file_edge")


_NUMBER = "cast(split({0}, ':')[1] as bigint)"


@query("q07b_maintained_coverage", """
, c as (select src, dst from calls where (split_part(src, ':', 2)::bigint + split_part(dst, ':', 2)::bigint) % 5 <> 0 or (split_part(src, ':', 2)::bigint + split_part(dst, ':', 2)::bigint) % 10 = 0),
t as (select distinct src, dst from tests where (split_part(src, ':', 2)::bigint + split_part(dst, ':', 2)::bigint) % 7 <> 0),
one as (select distinct t.src, c.dst from t join c on t.dst = c.src), two as (select distinct one.src, c.dst from one join c on one.dst = c.src), three as (select distinct two.src, c.dst from two join c on two.dst = c.src),
found as (select * from one union select * from two union select * from three)
select src as src_id, dst as dst_id from found except select src, dst from t""")
def maintained_coverage(spark, d):
    """All tests and calls come, then some go, then some of these calls come back; support is counted, never recomputed."""
    g = graph(spark, d)
    k = F.expr(_NUMBER.format("src_id")) + F.expr(_NUMBER.format("dst_id"))
    tests, calls = (g.rel(x).select("src_id", "dst_id").distinct().withColumn("k", k) for x in ("TESTS", "CALLS"))
    signed = lambda rows, n: rows.select("src_id", "dst_id", F.lit(n).cast("bigint").alias("n"))
    steps = [(signed(tests, 1), signed(calls, 1)), (signed(tests.where("k % 7 = 0"), -1), signed(calls.where("k % 5 = 0"), -1)), (signed(tests.limit(0), 1), signed(calls.where("k % 10 = 0"), 1))]
    path = shared_dir(spark, "derived")
    for number, (t, c) in enumerate(steps):
        store = BucketStore(spark, path, number, BUCKETS)
        derived.coverage_changed(store, t, c)
        store.commit()
    return derived.coverage_of(spark, path)


@query("ex13_maintained_satisfaction", """
, methods as (select distinct c_nationkey as struct, (c_custkey * 7 % 50) as m from customer where c_custkey % 3 <> 0),
wanted as (select distinct p_brand as interface, p_size - 1 as m from part where p_partkey % 37 = 0)
select struct::varchar as struct, interface from wanted join methods using (m) group by 1, 2 having count(*) = (select count(*) from wanted w where w.interface = wanted.interface)""")
def maintained_satisfaction(spark, d):
    """Nations as structs, brands as interfaces: more methods and wants come than stay; a declaration that another one repeats still counts when one goes."""
    customer, part = load(spark, d, "customer"), load(spark, d, "part")
    m = lambda rows, n: rows.select(F.col("c_nationkey").cast("string").alias("struct"), (F.col("c_custkey") * 7 % 50).cast("string").alias("method"), F.lit(n).cast("bigint").alias("n"))
    w = lambda rows, n: rows.select(F.col("p_brand").alias("interface"), (F.col("p_size") - 1).cast("string").alias("method"), F.lit(n).cast("bigint").alias("n"))
    wanted, extra = part.where("p_partkey % 37 = 0"), part.where("p_partkey % 37 = 1")
    path = shared_dir(spark, "derived")
    for number, (methods, wants) in enumerate([(m(customer, 1), w(wanted.unionByName(extra), 1)), (m(customer.where("c_custkey % 3 = 0"), -1), w(extra, -1))]):
        store = BucketStore(spark, path, number, BUCKETS)
        derived.satisfaction_changed(store, methods, wants)
        store.commit()
    return derived.satisfaction_of(spark, path)


GAP = 20 * 60 * 1000
#: What is known before the first change: every third user's file, with five entities.
KNOWN = "select 'src/u' || user_id || '.py' as path, 5 as n from (select distinct user_id from events where user_id % 3 = 0)"
_KEYED = f"""{CHANGES},
ended as (select path, run, arg_max(change_type, (ts, change_type, entities)) as change_type, arg_max(entities, (ts, change_type, entities)) as n, max(ts) as ts, count(*) as events from runs group by path, run),
given as (select *, change_type in ('Deleted', 'Renamed') as gone, ts + interval 20 minute <= date_trunc('milliseconds', (select max(ts) from ch)) as passed from ended),
known as ({KNOWN}),
steps as (
  select g.*, case when row_number() over w = 1 then k.n else lag(case when gone then null else g.n end) over w end as before
  from given g left join known k on k.path = g.path window w as (partition by g.path order by g.ts))"""


def _streamed(spark, d, to_the_end: bool) -> tuple[DataFrame, str]:
    """(updates, checkpoint): events as a stream in three parts, by a query that starts from a snapshot and is stopped and started again before the last part."""
    changes = file_changes(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = (changes.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")))).first()
    snapshot = load(spark, d, "events").where("user_id % 3 = 0").select(F.concat(F.lit("src/u"), "user_id", F.lit(".py")).alias("path"), F.lit(5).cast("bigint").alias("entities")).distinct()
    at = shared_dir(spark, "changes")
    before = None
    with keyed_state.state_store(spark):
        for k, part in enumerate((0.5, 0.8, 1.0)):
            until = low + int((high - low) * part)
            us = F.unix_micros("ts")
            rows = changes.where(us <= until) if before is None else changes.where((us > before) & (us <= until))
            before = until
            if part == 1.0 and to_the_end:  # a change far behind the last, so that all runs end
                rows = rows.unionByName(spark.createDataFrame([("~", "Added", 0)], "path string, change_type string, entities bigint").withColumn("ts", F.timestamp_micros(F.lit(high + 10 * GAP * 1000))))
            rows.write.parquet(f"{at}/in/{k}")
            if k:
                stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
                out = keyed_state.keyed_updates(stream, GAP, "0 seconds", snapshot)
                out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out"), f"{at}/checkpoint"


@query("st04_keyed_state", f"""{_KEYED}
select path, ts, change_type, events, case when gone or before is not null then 0 else n end as entities_added, coalesce(before, 0)::bigint as entities_removed, case when gone or before is null then 0 else n end as entities_modified from steps""")
def st04_keyed(spark, d):
    """Debounce and statistics in one keyed state of a stream with timers, from a snapshot, over a restart."""
    return _streamed(spark, d, True)[0].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("st07_state_statistics", f"""{_KEYED},
stands as (
  select k.path, case when s.path is null then k.n when s.gone then null else s.n end as n from known k left join (select * from steps where passed qualify row_number() over (partition by path order by ts desc) = 1) s on s.path = k.path
  union all select path, case when gone then null else n end from (select * from steps where passed qualify row_number() over (partition by path order by ts desc) = 1) where path not in (select path from known))
select (select count(*) from stands where n is not null) as files, (select coalesce(sum(n), 0)::bigint from stands) as entities,
       (select count(distinct path) from steps where not passed) as pending_files, (select coalesce(sum(events), 0)::bigint from steps where not passed) as pending_changes""")
def st07_state(spark, d):
    """Files, entities and waiting changes as the checkpoint of a stopped query has them."""
    return keyed_state.state_statistics(spark, _streamed(spark, d, False)[1])


@query("st08_events_once", """
, cut as (select epoch_us(min(ts)) as low, epoch_us(max(ts)) as high from events),
parted as (select case when epoch_us(ts) <= low + (high - low) // 2 then 0 else 1 end as batch, * from events, cut),
counted as (select batch, event_type, event_id, row_number() over (partition by batch order by ts, event_id) as sequence, count(*) over (partition by batch) as n from parted)
select batch::bigint as batch, event_type as type, 'kept' as what, count(*) as n, sum(sequence * (event_id % 1000))::bigint as weight from counted where sequence * 5 <= n * 4 group by all
union all select batch::bigint, event_type, 'dropped', count(*), 0 from counted where sequence * 5 > n * 4 group by all""")
def events_once(spark, d):
    """Two batches of events in the log, one of them delivered a second time with the room for four fifths of it: what is kept, under which number, and what was dropped."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = load(spark, d, "events").select(F.col("event_type").alias("type"), "event_id", "ts", us.alias("us"))
    low, high = e.agg(F.min("us"), F.max("us")).first()
    middle = low + (high - low) // 2
    path = shared_dir(spark, "log")
    for number, part in enumerate((e.where(F.col("us") <= middle), e.where(F.col("us") > middle))):
        room = part.count() * 4 // 5
        for _ in range(1 + number):
            event_log.deliver(part.select("type", "event_id", "ts"), number, path, ("ts", "event_id"), room)
    kept = event_log.events_of(spark, path).withColumn("k", F.get_json_object("event", "$.event_id").cast("bigint"))
    kept = kept.groupBy("batch", "type").agg(F.lit("kept").alias("what"), F.count("*").alias("n"), F.sum(F.col("sequence") * (F.col("k") % 1000)).alias("weight"))
    return kept.unionByName(event_log.dropped(spark, path).select("batch", "type", F.lit("dropped").alias("what"), F.col("dropped").alias("n"), F.lit(0).cast("bigint").alias("weight")))


@query("sf1_indexed_search", r"""
, kept as (select doc_id, case when doc_id % 10 = 3 then text || chr(10) || 'No Rights  Reserved here' else text end as text from documents where doc_id % 10 <> 4),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_number from kept)
select 'd' || doc_id as path, line_number::int as line_number, trim(line) as line from lines where regexp_matches(line, '(?i)(rights\s+reserved|licen[cs]e)')""".replace(chr(92) * 2, chr(92)))
def indexed_search(spark, d):
    """Documents as stored files with trigram postings; some change, some go; then a search by the pattern's trigrams."""
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))
    path = shared_dir(spark, "index")
    update_index(spark, path, 0, docs, docs, BUCKETS)
    changed = docs.where("doc_id % 10 in (3, 4)")
    now = changed.where("doc_id % 10 = 3").withColumn("content", F.concat("content", F.lit("\nNo Rights  Reserved here")))
    update_index(spark, path, 1, changed, now, BUCKETS)
    return search(spark, path, r"(rights\s+reserved|licen[cs]e)", regex=True, most=None)
