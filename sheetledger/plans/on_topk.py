"""Sorts, limits and set operations bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as X
from ..operators import topk as K
from ..operators.joins import overlay
from ..operators.projections import map_values, severity_of
from ..sources.tables import read_table
from .catalog import query
from .on_projections import PRIORITY_CASE, PRIORITY_SEVERITY

# Problem types named in the test prose: pattern, lift, projects.
PROBLEMS = {"sequence": (r"there", 5.8, 15), "change": (r"tion le", 4.81, 11), "embed": (r"sch der", 3.18, 16),
            "clash": (r"the", 9.9, 2)}


@query("TOP-01", """
select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority,
  case when o_orderstatus <> 'P' then o_totalprice end desc nulls last, o_orderkey limit 50 offset 100""")
def paged_sort(spark, d):
    rows = read_table(spark, d, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return K.page(rows, [F.asc("o_orderpriority"), F.desc_nulls_last("price"), F.asc("o_orderkey")], 50, 100).select(
        "o_orderkey", "o_orderpriority", "o_totalprice")


def _issue_sources(spark, d):
    """Three issue sources in one shape: priced orders, low-confidence lines, error events."""
    orders = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("source_key"), F.col("o_custkey").alias("drawing_id"),
        map_values(F.col("o_orderpriority"), PRIORITY_SEVERITY, "low").alias("severity"),
        map_values(F.col("o_orderstatus"), {"F": "closed", "O": "pending"}, "acknowledged").alias("native_status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("amount"))
    lines = read_table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("source_key"), F.col("l_partkey").alias("drawing_id"),
        severity_of(F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)).alias("severity"),
        map_values(F.col("l_linestatus"), {"F": "remediated"}, "pending").alias("native_status"),
        F.col("l_shipdate").alias("created_at"), F.col("l_extendedprice").alias("amount"))
    events = read_table(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("source_key"), F.col("user_id").alias("drawing_id"),
        F.when(F.col("value") > 40, "high").otherwise("medium").alias("severity"), F.lit("pending").alias("native_status"),
        F.col("ts").alias("created_at"), F.col("value").alias("amount"))
    return {"engine": orders, "symbol": lines, "event": events}


_ISSUES = f"""i as (
  select 'engine:' || o_orderkey as id, 'engine' as source, o_custkey as drawing_id, {PRIORITY_CASE} as severity, case o_orderstatus when 'F' then 'closed' when 'O' then 'pending' else 'acknowledged' end as native_status, o_orderdate as created_at, o_totalprice as amount from orders
  union all select 'symbol:' || (l_orderkey * 1000000 + l_partkey * 10 + l_linenumber), 'symbol', l_partkey, case when l_returnflag = 'N' then 'medium' when l_discount * 10 < 0.5 then 'high' when l_discount * 10 < 0.8 then 'medium' else 'low' end,
    case l_linestatus when 'F' then 'remediated' else 'pending' end, l_shipdate, l_extendedprice from lineitem
  union all select 'event:' || event_id, 'event', user_id, case when value > 40 then 'high' else 'medium' end, 'pending', ts, value from events where event_type = 'error')"""
_RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end"


@query("TOP-02", f"""
with {_ISSUES} select id, severity, amount from i order by {_RANK}, amount desc, id limit 40 offset 20""")
def topn_merge(spark, d):
    shaped = [X.unify({name: df}) for name, df in _issue_sources(spark, d).items()]
    order = [K.severity_rank(F.col("severity")).asc(), F.desc("amount"), F.asc("id")]
    return K.merge_top(shaped, order, 40, 20).select("id", "severity", "amount")


@query("TOP-03", """
select l_orderkey, l_partkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 500""")
def capped_by_importance(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return K.cap(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], 500)[0]


@query("TOP-03", "select count(*) as total, greatest(count(*) - 500, 0) as cut from lineitem")
def cap_report(spark, d):
    return K.cap(read_table(spark, d, "lineitem"), [F.desc("l_extendedprice")], 500)[1]


@query("TOP-04", f"""
with {_ISSUES},
st as (select o_orderkey, 'remediated' as status from orders where o_totalprice > 480000),
r as (select c_custkey, case when c_mktsegment = 'BUILDING' then 5.8::double when c_mktsegment like 'M%' then 3.18::double else 0 end as risk from customer)
select i.id, source, severity, coalesce(st.status, native_status) as status, coalesce(risk, 0) as risk, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at
from i left join st on i.source = 'engine' and i.id = 'engine:' || st.o_orderkey left join r on r.c_custkey = i.drawing_id
order by {_RANK}, coalesce(risk, 0) desc, i.created_at desc, i.id limit 100""")
def severity_then_cost(spark, d):
    """The issue page end to end: unify, overlay the closing state, enrich, rank, cut."""
    issues = X.unify(_issue_sources(spark, d))
    closed = read_table(spark, d, "orders").where("o_totalprice > 480000").select(
        F.lit("engine").alias("source"), F.col("o_orderkey").alias("source_key"), F.lit("remediated").alias("status"), F.lit("").alias("note"))
    problems = {"sequence": (r"BUILDING", 5.8, 15), "embed": (r"^M", 3.18, 16), "clash": (r".", 9.9, 2)}
    risk = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("drawing_id"), K.cost_risk(F.col("c_mktsegment"), problems).alias("risk"))
    rows = overlay(issues, closed, ["source", "source_key"], F.col("native_status")).join(risk, "drawing_id", "left")
    rows = rows.withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    order = K.issue_order(F.col("severity"), F.col("risk"), F.desc("created_at"), F.asc("id"))
    return K.page(rows, order, 100).select("id", "source", "severity", "status", "risk",
                                           F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("TOP-05", r"""
with k as (select p_partkey, case when p_size % 11 = 0 then '￿' else
  array_to_string(list_transform(regexp_extract_all(upper(p_brand || '-' || p_size || '.' || p_partkey), '(\d+|\D+)'), lambda x: case when regexp_full_match(x, '\d+') and length(x) < 8 then lpad(x, 8, '0') else x end), '') end as sort_key from part)
select p_partkey, sort_key from k order by sort_key, p_partkey limit 300""")
def natural_order(spark, d):
    number = F.when(F.col("p_size") % 11 != 0, F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")))
    rows = read_table(spark, d, "part").select("p_partkey", K.natural_key(number).alias("sort_key"))
    return K.page(rows, [F.asc("sort_key"), F.asc("p_partkey")], 300)


@query("TOP-06", """
with s as (select l_suppkey as drawing_id, count(distinct l_returnflag) - 1 as directions, max(l_linenumber) - 1 as zones, max(l_quantity)::int as max_gaps, count(*) as total_gaps, max(l_orderkey) % 4 = 0 as zone_confirmed from lineitem group by 1)
select drawing_id, directions * 1000 + least(max_gaps, 40) as coverage_score from s where not zone_confirmed and zones <= 6 and total_gaps > 0 order by 2 desc, 1 limit 25""")
def candidate_ranking(spark, d):
    sheets = read_table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("drawing_id")).agg(
        (F.count_distinct("l_returnflag") - 1).alias("directions"), (F.max("l_linenumber") - 1).alias("zones"), F.max("l_quantity").cast("int").alias("max_gaps"),
        F.count("*").alias("total_gaps"), (F.max("l_orderkey") % 4 == 0).alias("zone_confirmed"))
    return K.rank_anchors(sheets, 25).select("drawing_id", "coverage_score")


@query("TOP-07", """
with e as (select o_orderkey, case when o_orderstatus = 'P' then null when o_orderstatus = 'O' then 0 else o_custkey end as estimate from orders)
select o_orderkey, estimate, case when estimate is null then 1 when estimate <= 0 then 2 else 0 end as tier from e
order by tier, case when estimate > 0 then -estimate else 0 end, o_orderkey""")
def three_tier_rank(spark, d):
    rows = read_table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("estimate"))
    return K.rank_estimate(rows, "estimate", "o_orderkey")


@query("TOP-08", """
with r as (select o_orderkey, o_custkey, floor(o_totalprice / 1000)::bigint as c, length(o_orderpriority) as z from orders),
s as (select o_custkey, max(c) as total, count(*) as n, min(o_orderkey) as f from r group by 1)
select o_orderkey, o_custkey, total // n + case when o_orderkey = f then total % n else 0 end as unlocks, z as effort from r join s using (o_custkey)""")
def unlock_priority(spark, d):
    rows = read_table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).alias("components"), F.length("o_orderpriority").alias("zones"))
    return K.unlock_rank(rows, "o_custkey", "o_orderkey", "components", "zones")


@query("TOP-09", "select event_id, event_type, user_id from events order by ts desc, event_id desc limit 15")
def recent_n(spark, d):
    return K.recent(read_table(spark, d, "events"), "ts", 15, F.desc("event_id")).select("event_id", "event_type", "user_id")


@query("TOP-10", """
with q as (select 'topology' as kind, l_orderkey || '-' || l_linenumber || '-' || l_partkey as item, l_discount as confidence from lineitem where l_returnflag = 'A'
  union all select 'naming', p_partkey::varchar, p_size / 50.0::double from part union all select 'conflict', event_id::varchar, value / 500 from events where event_type = 'error')
select kind, item, confidence from q order by confidence, kind, item limit 60""")
def review_queue(spark, d):
    topo = read_table(spark, d, "lineitem").where("l_returnflag = 'A'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("item"), F.col("l_discount").alias("confidence"))
    naming = read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item"), (F.col("p_size") / 50.0).alias("confidence"))
    conflict = read_table(spark, d, "events").where("event_type = 'error'").select(
        F.col("event_id").cast("string").alias("item"), (F.col("value") / 500).alias("confidence"))
    return K.review_queue([("topology", topo), ("naming", naming), ("conflict", conflict)], 60, F.asc("item"))


@query("SET-01", f"""
with {_ISSUES} select id, source, drawing_id, severity, native_status, amount from i""")
def unify_sources(spark, d):
    return X.unify(_issue_sources(spark, d)).select("id", "source", "drawing_id", "severity", "native_status", "amount")


@query("SET-02", """
select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 3000)""")
def missing_set(spark, d):
    present = read_table(spark, d, "supplier").where("s_acctbal > 3000").select(F.col("s_nationkey").alias("n_nationkey"))
    return X.missing(read_table(spark, d, "nation"), present, "n_nationkey")


@query("SET-03", """
select c_nationkey as nation, c_custkey % 50 as slot from customer where c_acctbal > 5000 intersect select s_nationkey, s_suppkey % 50 from supplier""")
def common_labels(spark, d):
    a = read_table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("slot"))
    b = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("slot"))
    return X.shared(a, b, ["nation", "slot"])


@query("SET-04", """
with n as (select o_orderkey, case when o_totalprice > 400000 then '1-URGENT' when o_totalprice < 20000 then null else o_orderpriority end as v, o_orderpriority as was from orders)
select o_orderkey, v as o_orderpriority, was from n where v is distinct from was""")
def changed_only(spark, d):
    old = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    price = F.col("o_totalprice")
    new = read_table(spark, d, "orders").select("o_orderkey", F.when(price > 400000, "1-URGENT").when(price >= 20000, F.col("o_orderpriority")).alias("o_orderpriority"))
    return X.changed(old, new, "o_orderkey", "o_orderpriority")


@query("SET-05", """
with a as (select source, w as label, count(*) as a from (select source, unnest(string_split(text, ' ')) as w from documents where lang = 'en') group by 1, 2),
b as (select source, w as label, count(*) as b from (select source, unnest(string_split(text, ' ')) as w from documents where lang <> 'en') group by 1, 2)
select source, sum(least(coalesce(a, 0), coalesce(b, 0)))::bigint as matched, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::bigint as only_a,
  sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::bigint as only_b, round(sum(least(coalesce(a, 0), coalesce(b, 0))) / sum(greatest(coalesce(a, 0), coalesce(b, 0))), 4) as jaccard
from a full join b using (source, label) group by 1""")
def multiset_agreement(spark, d):
    words = read_table(spark, d, "documents").select("source", "lang", F.explode(F.split("text", " ")).alias("w"))
    words = words.withColumnRenamed("w", "label")
    return X.agreement(words.where("lang = 'en'"), words.where("lang <> 'en'"), ["source"], "label")
