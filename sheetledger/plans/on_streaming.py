"""Streaming operators run over the event table as a stream, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as N
from ..sources.tables import read_table
from ..streaming import events as S
from ..streaming.tables import VersionedTable, drain, last_state
from .catalog import query
from .on_aggregates import _annotations
from .on_sources import scratch

#: Micro-batches that a table is streamed in.
PARTS = 3


def _sliced(spark, frame, name):
    """Write consecutive parts of the data's own time range and stream them back, one part to a micro-batch.

    A part has as many files as a shuffle has tasks, and the stream takes so many at a time.
    """
    path = scratch(spark, name)
    low, high = (float(v or 0) for v in frame.select(F.unix_micros("ts").alias("t")).agg(F.min("t"), F.max("t")).first())
    step = (high - low) / PARTS
    part = F.when(F.col("ts").isNull(), 0).otherwise(F.least(F.lit(PARTS - 1), F.floor((F.unix_micros("ts") - low) / max(step, 1.0))))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(PARTS):
        frame.where(part == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(path)


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("STM-01", """
select event_type, case event_type when 'error' then 'review' when 'purchase' then 'rebuild' when 'click' then 'review' end as handler,
  case when event_type in ('error', 'purchase', 'click') then 'done' else 'skipped' end as status, count(*) as n from events group by 1, 2, 3""")
def event_dispatch(spark, d):
    stream = S.once(S.event_stream(spark, d), "event_id", "ts", "1 hour")
    routed = S.dispatch(stream, "event_type", {"error": "review", "purchase": "rebuild", "click": "review"})
    out = drain(routed.select("event_id", "event_type", "handler", "status"), scratch(spark, "dispatch"))
    return out.groupBy("event_type", "handler", "status").agg(F.count("*").alias("n"))


def _changes(spark, d):
    kind = F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 60, "built")).otherwise("changed")
    return read_table(spark, d, "events").select(F.col("user_id").alias("project"), "ts", kind.alias("kind")).where("kind is not null")


_SUGGEST = """
with c as (select user_id as project, ts, case when event_type = 'purchase' then case when value > 60 then 'built' end else 'changed' end as kind from events),
b as (select project, max(ts) as built from c where kind = 'built' group by 1)
select c.project, count(*) as changed from c left join b on b.project = c.project where kind = 'changed' and (built is null or ts > built) group by 1 having count(*) >= 20"""


@query("STM-02", _SUGGEST)
def threshold_suggestion(spark, d):
    state = S.SuggestionState(spark, scratch(spark, "suggest"), 20, 4)
    S.run_batches(_sliced(spark, _changes(spark, d), "changes"), state.process, scratch(spark, "suggest_check"))
    return state.suggestions().select("project", "changed")


@query("STM-02", _SUGGEST)
def threshold_suggestion_batch(spark, d):
    return S.suggestions_batch(_changes(spark, d), 20).select("project", "changed")




@query("STM-03", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as start, event_type, count(*) as calls, count(*) filter (where value > 60) as errors, sum(value::decimal(28,4))::double as cost from events group by 1, 2""")
def tumbling_cost(spark, d):
    out = S.cost_windows(S.event_stream(spark, d), "ts", "event_type", F.col("value"), F.col("value") > 60)
    rows = last_state(drain(out, scratch(spark, "tumbling"), "update"), ["start", "event_type"])
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("STM-04", """
with w as (select date_trunc('day', ts) - to_days(i::int) as start, event_type, value from events, range(0, 7) r(i))
select strftime(start, '%Y-%m-%d') as start, event_type, count(*) as calls, count(*) filter (where value > 60) as errors, sum(value::decimal(28,4))::double as cost from w group by 1, 2""")
def sliding_cost(spark, d):
    out = S.cost_sliding(S.event_stream(spark, d), "ts", "event_type", F.col("value"), F.col("value") > 60, "7 days", "1 day")
    rows = last_state(drain(out, scratch(spark, "sliding"), "update"), ["start", "event_type"])
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("STM-04", """
with w as (select date_trunc('day', ts) - to_days(i::int) as start, event_type, value from events, range(0, 7) r(i)), m as (select max(ts) - interval 2 hours as mark, date_trunc('day', max(ts) - interval 2 hours) as pane from events)
select strftime(start, '%Y-%m-%d') as start, event_type, count(*) as calls, count(*) filter (where value > 60) as errors, sum(value::decimal(28,4))::double as cost from w, m where start + interval 7 days <= pane group by 1, 2""")
def trailing_cost(spark, d):
    """Closed windows of seven days, from panes of a day."""
    out = S.cost_trailing(S.event_stream(spark, d), "ts", "event_type", F.col("value"), F.col("value") > 60, "7 days", "1 day")
    return drain(out, scratch(spark, "trailing")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("STM-05", """
with g as (select user_id, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 6 * 3600000000 as brk from events),
s as (select *, sum(coalesce(brk, true)::int) over (partition by user_id order by ts) as sid from g),
e as (select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 6 * 3600000000 as end_us, count(*) as actions from s group by user_id, sid)
select * from e where end_us // 1000 <= (select epoch_ms(max(ts)) from events) - 2 * 3600000""")
def closed_sessions(spark, d):
    """Sessions that the watermark has passed: each comes out once and leaves the state."""
    out = drain(S.sessions(S.event_stream(spark, d), "user_id", "ts", "6 hours"), scratch(spark, "closed"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "actions")


@query("STM-05", """
with g as (select user_id, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 6 * 3600000000 as brk from events),
s as (select *, sum(coalesce(brk, true)::int) over (partition by user_id order by ts) as sid from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 6 * 3600000000 as end_us, count(*) as actions from s group by user_id, sid""")
def review_sessions(spark, d):
    out = S.sessions(S.event_stream(spark, d), "user_id", "ts", "6 hours")
    rows = drain(out, scratch(spark, "sessions"), "complete")
    final = rows.join(rows.agg(F.max("batch").alias("batch")), "batch", "left_semi")
    return final.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "actions")


def _reports(spark, d):
    status = F.when(F.col("value") > 50, "failed").when(F.col("value") > 5, "done").otherwise("running")
    return read_table(spark, d, "events").select(F.col("user_id").alias("item"), status.alias("status"), "ts", F.col("event_id").alias("seq"))


@query("STM-06", """
with r as (select user_id as item, case when value > 50 then 'failed' when value > 5 then 'done' else 'running' end as status, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events),
m as (select c_custkey as item, c_nationkey as batch from customer),
c as (select batch, count(*) as total, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed from m left join r on r.item = m.item and n = 1 where m.item in (select user_id from events) group by 1)
select batch, total, done, failed, case when done + failed < total then 'running' when failed = 0 then 'done' when failed = total then 'failed' else 'partial' end as state, round((done + failed) / total, 4) as progress from c""")
def batch_completion(spark, d):
    reports = _reports(spark, d)
    members = read_table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_nationkey").alias("batch"))
    keeper = S.BatchCompletion(spark, scratch(spark, "completion"), buckets=4)
    S.run_batches(_sliced(spark, reports, "reports"), keeper.process, scratch(spark, "completion_check"))
    return keeper.states(members.join(reports.select("item").distinct(), "item", "left_semi"), "batch")


@query("STM-07", """
select user_id, event_id, coalesce(json_extract(props, '$.k')::bigint % 4, 0) + 1 as reap_attempts, coalesce(json_extract(props, '$.k')::bigint % 4, 0) + 1 <= 3 as requeue
from events where event_type = 'view' and epoch_us(timestamp '2024-01-20') - epoch_us(ts) > 2 * 3600000000""")
def stale_reaper(spark, d):
    rows = read_table(spark, d, "events").withColumn("attempts", _k() % 4)
    return S.plan_reap(rows, "2024-01-20", 2.0, 3, "event_type", "ts", "attempts", "view").select("user_id", "event_id", "reap_attempts", "requeue")


@query("STM-07")
def stale_reaper_stream(spark, d):
    frame = read_table(spark, d, "events").select("user_id", "ts", "event_type")
    out = S.reap(_sliced(spark, frame, "work"), "user_id", "ts", "event_type", 24.0, 3, active="view")
    return drain(out, scratch(spark, "reap"))


@query("STM-08", """
with e as (select user_id % 12 as engine, ts, event_id, coalesce(value < 25, false) as ok from events),
r as (select *, row_number() over (partition by engine order by ts, event_id) - row_number() over (partition by engine, ok order by ts, event_id) as run from e)
select engine, epoch_us(min(ts)) as down_us, epoch_us(max(ts)) as last_us, count(*) as failures from r where not ok group by engine, run having count(*) >= 5""")
def failure_runs(spark, d):
    calls = read_table(spark, d, "events").select((F.col("user_id") % 12).alias("engine"), "ts", "event_id", F.coalesce(F.col("value") < 25, F.lit(False)).alias("ok"))
    runs = N.failure_runs(calls, ["engine"], "ts", "event_id", "ok")
    return runs.select("engine", F.unix_micros("down_at").alias("down_us"), F.unix_micros("last_at").alias("last_us"), "failures")


@query("STM-09", """
select user_id, event_id, event_type as status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1""")
def stream_upsert(spark, d):
    table = VersionedTable(spark, scratch(spark, "upserts"), ["user_id"], "user_id long, event_id long, status string, ts timestamp", 4)
    frame = read_table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status"), "ts")
    S.sink_upsert(_sliced(spark, frame, "statuses"), table, [F.desc("ts"), F.desc("event_id")], scratch(spark, "upserts_check")).awaitTermination()
    return table.current().drop("ts")


@query("STM-10", """
select c_mktsegment, c_nationkey, count(*) as n, sum(value::decimal(28,4))::double as total from events left join customer on c_custkey = user_id group by 1, 2""")
def stream_static_enrich(spark, d):
    dim = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    out = S.enrich_stream(S.event_stream(spark, d), dim, "user_id", "c_custkey").select("event_id", "value", "c_mktsegment", "c_nationkey")
    return drain(out, scratch(spark, "enrich")).groupBy("c_mktsegment", "c_nationkey").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"))


@query("STM-11")
def path_join_stream(spark, d):
    uploads = S.event_stream(spark, d).where("event_type = 'view'")
    proposals = S.event_stream(spark, d).where("event_type = 'purchase'")
    return drain(S.first_pair(uploads, proposals, "user_id", "ts", "10 days"), scratch(spark, "pairs"))


@query("STM-12")
def learning_loop(spark, d):
    loop = S.LearningLoop(spark, scratch(spark, "learning"))

    def step(batch, batch_id):
        loop.process(batch, batch_id)
        loop.adopt(loop.suggestions().where("raw < 'raw3'"), batch_id)

    S.run_batches(_sliced(spark, _annotations(spark, d), "annotations"), step, scratch(spark, "learning_check"))
    return loop.suggestions()
