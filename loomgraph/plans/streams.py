"""The stream operators over the events table, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import changes as S
from .binding import load
from .registry import query


def file_changes(spark, d):
    """events as file changes: a user is a file, its event the change, its value the number of entities."""
    e = load(spark, d, "events")
    kind = F.col("event_type")
    change = F.when(kind == "signup", "Added").when(kind.isin("click", "view"), "Modified").when(kind == "error", "Deleted").otherwise("Renamed")
    return e.select(F.concat(F.lit("src/u"), "user_id", F.lit(".py")).alias("path"), change.alias("change_type"), "ts", F.floor(F.abs("value")).cast("bigint").alias("entities"))


_SQL = """, ch as (
  select 'src/u' || user_id || '.py' as path, case when event_type = 'signup' then 'Added' when event_type in ('click', 'view') then 'Modified' when event_type = 'error' then 'Deleted' else 'Renamed' end as change_type,
         ts, floor(abs(value))::bigint as entities from events),
runs as (select *, sum(case when before is null or ts - before >= interval 20 minute then 1 else 0 end) over (partition by path order by ts, change_type) as run
  from (select *, lag(ts) over (partition by path order by ts, change_type) as before from ch)),
upd as (
  select path, ts, change_type, entities, change_type in ('Deleted', 'Renamed') as gone,
         lag(case when change_type in ('Deleted', 'Renamed') then null else entities end) over (partition by path order by ts, change_type) as before from ch)"""


@query("st03_debounce", f"{_SQL} select path, arg_max(change_type, (ts, change_type)) as change_type, max(ts) as ts, count(*) as events from runs group by path, run")
def st03(spark, d):
    return S.debounce(file_changes(spark, d), "20 minutes")


@query("st04_update_stats", f"""{_SQL}
select path, ts, change_type, case when gone or before is not null then 0 else entities end as entities_added, coalesce(before, 0) as entities_removed, case when gone or before is null then 0 else entities end as entities_modified from upd""")
def st04(spark, d):
    return S.update_stats_batch(file_changes(spark, d))


@query("st07_totals", f"""{_SQL}
select count(distinct path) as files_updated, sum(case when gone or before is not null then 0 else entities end)::bigint as entities_added, sum(coalesce(before, 0))::bigint as entities_removed,
       sum(case when gone or before is null then 0 else entities end)::bigint as entities_modified from upd""")
def st07(spark, d):
    return S.totals(S.update_stats_batch(file_changes(spark, d)))


@query("st02_relevant_changes", f"""{_SQL}
select change_type, count(*) as n from (select *, user_id % 6 as k, case when event_type = 'signup' then 'Added' when event_type in ('click', 'view') then 'Modified' when event_type = 'error' then 'Deleted' else 'Renamed' end as change_type from events)
where k in (0, 4) or k = 2 and change_type = 'Deleted' group by 1""")
def st02(spark, d):
    """By user: known files, a folder that is ignored, an extension that isn't known (asked for unless the file is deleted), a path too deep, and a change of no known type."""
    e = load(spark, d, "events")
    kind, k, u = F.col("event_type"), F.col("user_id") % 6, F.col("user_id").cast("string")
    change = F.when(kind == "signup", "Added").when(kind.isin("click", "view"), "Modified").when(kind == "error", "Deleted").otherwise("Renamed")
    deep = F.concat(F.lit("a/b/c/d/e/f/g/h/i/j/u"), u, F.lit(".py"))
    path = F.when(k == 1, F.concat(F.lit("web/node_modules/u"), u, F.lit(".js"))).when(k == 2, F.concat(F.lit("src/u"), u, F.lit(".txt"))).when(k == 3, deep).when(k == 4, F.concat(F.lit("src/u"), u, F.lit(".ts"))).otherwise(F.concat(F.lit("src/u"), u, F.lit(".py")))
    changes = e.select(path.alias("path"), F.when(k == 5, "Touched").otherwise(change).alias("change_type"), "ts")
    return S.relevant(changes).groupBy("change_type").agg(F.count("*").alias("n"))
