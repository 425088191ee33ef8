"""Scans, sources and sinks bound to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.export import to_coco
from ..sources.feeds import extract_text, flatten_feed
from ..sources.logs import due_sources, partition_gaps, read_months, write_month_partitioned
from ..sources.tables import read_table
from ..sources.writes import audit_rows, insert_absent, keyed_upsert, replace_by_key, upsert_open
from .catalog import query


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SRC-01", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders
where o_orderstatus = 'F' and o_totalprice >= 100000""")
def table_scan(spark, d):
    return (read_table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice >= 100000")
            .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))


@query("SRC-02", """
select strftime(o_orderdate, '%Y_%m') as order_month, count(*) as n from orders
where strftime(o_orderdate, '%Y_%m') between '1996_03' and '1997_06' group by 1""")
def month_partition_log(spark, d):
    path = scratch(spark, "month_log")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    write_month_partitioned(orders, "o_orderdate", path, "1996_01", "1997_05")
    return (read_months(spark, path, "o_orderdate", "1996_03", "1997_06")
            .groupBy(F.date_format("o_orderdate", "yyyy_MM").alias("order_month")).agg(F.count("*").alias("n")))


@query("SRC-03", """
with want as (select unnest(generate_series(date '2023-12-01', date '2024-03-01', interval 1 month)) as m)
select strftime(m, '%Y_%m') as month, strftime(m, '%Y-%m-%d') as from_date,
       strftime(m + interval 1 month, '%Y-%m-%d') as to_date
from want where m not in (select date_trunc('month', ts) from events)""")
def partition_coverage(spark, d):
    return partition_gaps(read_table(spark, d, "events"), "ts", "2023-12-15", 3)


@query("SRC-04", r"""
with items as (
  select doc_id, t.i as i, regexp_replace(t.line, '^\s+|\s+$', '', 'g') as content
  from documents, lateral (select unnest(string_split(text, chr(10))) as line,
                                  generate_subscripts(string_split(text, chr(10)), 1) - 1 as i) t),
kept as (select *, row_number() over (partition by doc_id order by i) - 1 as pos from items where content <> '')
select doc_id, case when i % 3 = 0 then 'auto_' || pos else 'A' || i end as article_no, content,
       i % 2 = 0 as is_mandatory
from kept""")
def json_feed_flatten(spark, d):
    line = lambda text, i: F.struct(
        F.when(i % 3 != 0, F.concat(F.lit("A"), i)).alias("article_no"),
        text.alias("content"), (i % 2 == 0).alias("is_mandatory"))
    pages = read_table(spark, d, "documents").select(
        "doc_id", F.to_json(F.struct(F.struct(
            F.transform(F.split("text", "\n"), line).alias("articles")).alias("data"))).alias("page"))
    return (flatten_feed(pages, "page", "data.articles", ("doc_id",))
            .select("doc_id", "article_no", "content", "is_mandatory"))


@query("SRC-05", """
with s as (select c_custkey, (c_nationkey + 1) * 4 as interval_hours,
  case when c_custkey % 7 <> 0
       then timestamp '2024-01-10 00:00:00' - to_hours(cast(c_custkey % 200 as integer)) end as last_synced_at from customer)
select c_custkey, cast(interval_hours as integer) as interval_hours from s
where last_synced_at is null or last_synced_at + to_hours(cast(interval_hours as integer)) <= timestamp '2024-01-10 00:00:00'""")
def due_source_scan(spark, d):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    sources = read_table(spark, d, "customer").select(
        "c_custkey", ((F.col("c_nationkey") + 1) * 4).alias("interval_hours"),
        F.when(F.col("c_custkey") % 7 != 0,
               now - F.make_interval(hours=(F.col("c_custkey") % 200).cast("int"))).alias("last_synced_at"))
    return due_sources(sources, "2024-01-10 00:00:00").select("c_custkey", "interval_hours")


@query("SRC-06", r"""
with a as (select page_id, regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g') as t from pages),
b as (select page_id, regexp_replace(t, '(?is)<script[^>]*>.*?</script>', ' ', 'g') as t from a),
c as (select page_id, regexp_replace(t, '(?is)<style[^>]*>.*?</style>', ' ', 'g') as t from b),
e as (select page_id, regexp_replace(t, '(?is)</(p|div|li|h1|h2|h3|tr|title)>|<br */?>', chr(10), 'g') as t from c),
f as (select page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') as t from e),
g as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as t from f),
h as (select page_id, regexp_replace(t, '[ \t\r\f]+', ' ', 'g') as t from g),
i as (select page_id, regexp_replace(t, ' ?\n[ \n]*', chr(10), 'g') as t from h),
j as (select page_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from i)
select page_id, md5(t) as text_md5, 'text_layer' as method, cast(1 as bigint) as pages,
       cast(length(t) as bigint) as chars from j""")
def web_page_text(spark, d):
    text = extract_text(read_table(spark, d, "pages"), "html", "page_id")
    return text.select("page_id", F.md5("text").alias("text_md5"), "method", "pages", "chars")


@query("SRC-07", """
with b as (select d.doc_id, case when toxic = 1 then 'column' when quality = 1 then 'beam' else 'other' end as category,
             round(quality * 0.25::double, 4) as x, 0.5 as y, round(least(n_chars, 2000) / 3000.0, 4)::double as w, 0.1::double as h
           from documents d join labels l on d.doc_id = l.doc_id),
im as (select doc_id, row_number() over (order by doc_id) as image_id from (select distinct doc_id from b))
select row_number() over (order by b.doc_id) as id, image_id, doc_id, doc_id || '.png' as file_name,
       cast(case category when 'column' then 1 when 'beam' then 2 else 0 end as bigint) as category_id,
       category as category_name, x, w, round(w * h, 6) as area
from b join im using (doc_id)""")
def annotation_export(spark, d):
    docs, labels = read_table(spark, d, "documents"), read_table(spark, d, "labels")
    boxes = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("drawing_id"), F.col("doc_id").alias("ann_key"),
        F.when(F.col("toxic") == 1, "column").when(F.col("quality") == 1, "beam").otherwise("other").alias("category"),
        (F.col("quality") * 0.25).alias("x"), F.lit(0.5).alias("y"),
        F.round(F.least("n_chars", F.lit(2000)) / 3000.0, 4).alias("w"), F.lit(0.1).alias("h"))
    images, anns, _ = to_coco(boxes, ["column", "beam"])
    return (anns.join(images.withColumnRenamed("id", "image_id"), "image_id")
            .select("id", "image_id", F.col("drawing_id").alias("doc_id"), "file_name", "category_id",
                    "category_name", "x", "w", "area"))


def _orders_delta(spark, d):
    return read_table(spark, d, "orders").where("o_totalprice > 300000").select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey") + 10_000_000_000).otherwise(F.col("o_orderkey"))
        .alias("o_orderkey"), F.lit("R").alias("o_orderstatus"), F.lower("o_orderpriority").alias("o_orderpriority"))


_DELTA_SQL = """delta as (select case when o_orderpriority = '1-URGENT' then o_orderkey + 10000000000 else o_orderkey end as o_orderkey,
  'R' as o_orderstatus, lower(o_orderpriority) as o_orderpriority from orders where o_totalprice > 300000),
base as (select o_orderkey, o_orderstatus, o_orderpriority from orders)"""
_BASE = ("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SRC-08", f"""
with {_DELTA_SQL}
select * from base where o_orderkey not in (select o_orderkey from delta) or o_orderstatus = 'P'
union all
select * from delta where o_orderkey not in (select o_orderkey from base where o_orderstatus = 'P')""")
def keyed_upsert_orders(spark, d):
    base = read_table(spark, d, "orders").select(*_BASE)
    return keyed_upsert(base, _orders_delta(spark, d), ["o_orderkey"], [F.col("o_orderstatus")],
                        lambda a: F.col(f"{a}o_orderstatus") == "P")


@query("SRC-09", """
with e as (select user_id, event_type as kind, event_id, value,
             case when value < 40 then 'resolved' else 'open' end as status from events),
seed as (select user_id, kind, event_id, status from e where status = 'resolved'
         union all select user_id, kind, max(event_id), 'open' from e where status = 'open' and value < 80 group by 1, 2),
delta as (select user_id, kind, max(event_id) as event_id, 'open' as status from e where value >= 80 and status = 'open' group by 1, 2)
select * from seed where status = 'resolved'
union all select s.* from seed s where status = 'open'
  and not exists (select 1 from delta d where d.user_id = s.user_id and d.kind = s.kind)
union all select * from delta""")
def partial_unique_upsert(spark, d):
    rows = read_table(spark, d, "events").select(
        "user_id", F.col("event_type").alias("kind"), "event_id", "value",
        F.when(F.col("value") < 40, "resolved").otherwise("open").alias("status"))
    opened = rows.where("status = 'open'")
    first = (opened.where("value < 80").groupBy("user_id", "kind").agg(F.max("event_id").alias("event_id"))
             .withColumn("status", F.lit("open")))
    base = rows.where("status = 'resolved'").drop("value").unionByName(first)
    return upsert_open(base, opened.where("value >= 80").drop("value"), ["user_id", "kind"], F.col("status") == "open",
                       [F.col("event_id").desc()])


@query("SRC-10", f"""
with {_DELTA_SQL}
select * from delta where o_orderkey not in (select o_orderkey from base)""")
def insert_if_absent(spark, d):
    base = read_table(spark, d, "orders").select("o_orderkey")
    return insert_absent(base, _orders_delta(spark, d), ["o_orderkey"], [F.col("o_orderpriority")])


@query("SRC-11", """
select event_id, user_id, event_type from events where user_id not in (select user_id from events where value > 200)
union all select event_id + 1000000, user_id, 'redo' from events where value > 200""")
def replace_by_key_events(spark, d):
    events = read_table(spark, d, "events")
    delta = events.where("value > 200").select(
        (F.col("event_id") + 1_000_000).alias("event_id"), "user_id", F.lit("redo").alias("event_type"))
    return replace_by_key(events.select("event_id", "user_id", "event_type"), delta, ["user_id"])


@query("SRC-12", f"""
with {_DELTA_SQL}
select coalesce(b.o_orderkey, x.o_orderkey) as o_orderkey,
  case when b.o_orderkey is null then 'insert' when x.o_orderkey is null then 'delete' else 'update' end as action,
  case when b.o_orderkey is not null then '{{"o_orderstatus":"' || b.o_orderstatus || '","o_orderpriority":"' || b.o_orderpriority || '"}}' end as old_state,
  case when x.o_orderkey is not null then '{{"o_orderstatus":"' || x.o_orderstatus || '","o_orderpriority":"' || x.o_orderpriority || '"}}' end as new_state
from base b full join delta x on b.o_orderkey = x.o_orderkey
where b.o_orderkey is null or x.o_orderkey is null
   or b.o_orderstatus <> x.o_orderstatus or b.o_orderpriority <> x.o_orderpriority""")
def audit_append(spark, d):
    base = read_table(spark, d, "orders").select(*_BASE)
    return audit_rows(base, _orders_delta(spark, d), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])
