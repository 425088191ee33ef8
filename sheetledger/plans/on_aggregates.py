"""Dashboard, cost and list aggregations bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggs import rate
from ..operators import aggregates as A
from ..operators import evidence as E
from ..sources.tables import read_table
from .catalog import query
from .on_projections import PRIORITY_CASE, PRIORITY_SEVERITY
from ..operators.projections import map_values


@query("AGG-01", """
select o_orderstatus, count(*) as cnt, coalesce(sum(o_totalprice::decimal(28,2)), 0)::double as total from orders group by 1""")
def status_funnel(spark, d):
    return A.funnel(read_table(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@query("AGG-02", """
select l_returnflag, count(*) as total, count(*) filter (where l_discount > 0.05::double) as discounted,
  count(*) filter (where l_linestatus = 'F') as finished, count(*) filter (where l_quantity >= 40) as bulk from lineitem group by 1""")
def filtered_counts(spark, d):
    return A.counts_where(read_table(spark, d, "lineitem"), ["l_returnflag"], discounted=F.col("l_discount") > 0.05,
                          finished=F.col("l_linestatus") == "F", bulk=F.col("l_quantity") >= 40)


@query("AGG-03", """
select o_orderpriority, coalesce(round(count(*) filter (where o_orderstatus = 'F')::double / nullif(count(*) filter (where o_totalprice > 400000), 0), 4), 0) as plain_rate,
  round(count(*) filter (where o_orderstatus = 'O')::double / nullif(count(*) filter (where o_totalprice > 1e9), 0), 4) as null_rate
from orders group by 1""")
def safe_rate(spark, d):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return read_table(spark, d, "orders").groupBy("o_orderpriority").agg(
        rate(F.count_if(status == "F"), F.count_if(price > 400000)).alias("plain_rate"),
        rate(F.count_if(status == "O"), F.count_if(price > 1e9), 4, None).alias("null_rate"))


@query("AGG-04", """
select c_custkey, c_acctbal, coalesce(sum(o_totalprice::decimal(28,2)), 0)::double as year_saving
from customer left join orders on o_custkey = c_custkey and o_orderstatus in ('F', 'O') and o_orderdate >= timestamp '2000-01-01'
where c_acctbal >= 5000 group by 1, 2 having coalesce(sum(o_totalprice::decimal(28,2)), 0)::double < 500000""")
def kpi_breach(spark, d):
    orders = read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return A.kpi_breach(read_table(spark, d, "customer").select("c_custkey", "c_acctbal"), orders, "c_custkey", "c_acctbal",
                        "o_totalprice", "o_orderdate", F.col("o_orderstatus").isin("F", "O"), "2000-01-01", 5000, 500000)


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("AGG-05", """
select event_type, count(*) as call_count, sum(json_extract(props, '$.k')::bigint + user_id)::bigint as total_tokens,
  sum((value * 2)::decimal(28,4))::double as total_cost, round(avg(value)) as avg_latency, count(*) filter (where value < 20) as error_count
from events where ts >= timestamp '2024-01-31' - interval 15 day group by 1""")
def engine_cost_30d(spark, d):
    return A.cost_by(read_table(spark, d, "events"), "event_type", "ts", "2024-01-31", 15, _k() + F.col("user_id"),
                     F.col("value") * 2, "value", F.col("value") >= 20)


@query("AGG-06", """
select l_returnflag, p_brand, s_nationkey, count(*) as total_calls, count(*) filter (where l_linestatus = 'F') as success_calls,
  round(avg(l_extendedprice)) as avg_latency, round(quantile_cont(l_extendedprice, 0.95), 4) as p95_latency,
  sum(l_quantity)::bigint as prompt_tokens, sum(l_linenumber)::bigint as completion_tokens,
  round(sum((l_extendedprice * l_discount)::decimal(28,6)), 4)::double as total_cost
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2, 3""")
def cost_summary(spark, d):
    calls = (read_table(spark, d, "lineitem")
             .join(read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
             .join(read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"))
    return A.cost_summary(calls, ["l_returnflag", "p_brand", "s_nationkey"], "l_extendedprice", "l_quantity", "l_linenumber",
                          F.col("l_extendedprice") * F.col("l_discount"), F.col("l_linestatus") == "F").withColumn(
        "p95_latency", F.round("p95_latency", 4))


@query("AGG-07", """
select strftime(ts, '%Y-%m-%d') as day, event_type, sum(value::decimal(28,4))::double as cost, count(*) as calls
from events where ts >= timestamp '2024-01-31' - interval 20 day group by 1, 2""")
def daily_cost(spark, d):
    return A.daily(read_table(spark, d, "events"), "ts", "event_type", "2024-01-31", 20, F.col("value"))


@query("AGG-08", """
select source, count(*) as total, count(*) filter (where n_chars > 2000) as mandatory, count(quality) as graphed,
  count(case when toxic = 0 then l.doc_id end) as vectored, count(distinct case when toxic = 0 then l.doc_id end) as vectors
from documents d left join labels l on l.doc_id = d.doc_id group by 1""")
def library_layers(spark, d):
    articles = read_table(spark, d, "documents").join(
        read_table(spark, d, "labels").withColumn("vector_id", F.when(F.col("toxic") == 0, F.col("doc_id"))), "doc_id", "left")
    return A.layer_status(articles, "source", F.col("n_chars") > 2000, "quality", "vector_id")


@query("AGG-09", """
select coalesce(case when o_totalprice > 250000 then o_orderpriority end, o_orderstatus) as label,
  bool_or(o_totalprice > 250000) as is_detail, count(*) as cnt from orders group by 1""")
def detail_or_flag(spark, d):
    fine = F.when(F.col("o_totalprice") > 250000, F.col("o_orderpriority"))
    return A.label_summary(read_table(spark, d, "orders"), fine, F.col("o_orderstatus"))


@query("AGG-10", """
select l_partkey, count(*) as observations, count(distinct case when l_quantity > 5 then l_suppkey end) as sources,
  coalesce(string_agg(distinct case when l_quantity > 5 then l_suppkey::varchar end, ',' order by case when l_quantity > 5 then l_suppkey::varchar end), '') as source_ids
from lineitem group by 1""")
def source_lists(spark, d):
    rows = read_table(spark, d, "lineitem").select(
        "l_partkey", F.when(F.col("l_quantity") > 5, F.col("l_suppkey")).cast("string").alias("supplier"))
    return A.with_sources(rows, ["l_partkey"], "supplier").select(
        "l_partkey", "observations", "sources", F.array_join("source_list", ",").alias("source_ids"))


@query("AGG-11", """
with m as (select l_returnflag, l_linestatus, l_linenumber::varchar as l_linenumber, (l_discount > 0.05::double)::int as f from lineitem)
select 'total' as facet, null as value, count(*) as n, sum(f)::bigint as flagged from m
union all select 'l_returnflag', l_returnflag, count(*), sum(f)::bigint from m group by l_returnflag
union all select 'l_linestatus', l_linestatus, count(*), sum(f)::bigint from m group by l_linestatus
union all select 'l_linenumber', l_linenumber, count(*), sum(f)::bigint from m group by l_linenumber""")
def multi_dim_counts(spark, d):
    return A.facets(read_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"],
                    F.col("l_discount") > 0.05)


@query("AGG-12", """
select l_returnflag, l_linestatus, p_brand, grouping_id(l_returnflag, l_linestatus, p_brand)::bigint as level, count(*) as elements,
  round(sum((l_quantity * p_size)::decimal(28,10)), 4)::double as gross, round(sum((l_quantity * p_size * 0.9::double)::decimal(28,10)), 4)::double as net,
  round(sum((l_quantity * 2)::decimal(28,10)), 4)::double as formwork, count(*) filter (where not l_discount > 0.05::double) as measured,
  count(*) filter (where l_discount > 0.05::double) as estimated, count(*) filter (where l_quantity * p_size <= 0) as uncovered
from lineitem join part on p_partkey = l_partkey group by rollup (l_returnflag, l_linestatus, p_brand)""")
def quantity_rollup(spark, d):
    rows = read_table(spark, d, "lineitem").join(
        read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey")
    gross = F.col("l_quantity") * F.col("p_size")
    return A.qto_rollup(rows, ["l_returnflag", "l_linestatus", "p_brand"], gross, gross * 0.9, F.col("l_quantity") * 2,
                        F.col("l_discount") > 0.05)


_ACTION_SQL = "case event_type when 'click' then 'confirm' when 'view' then 'reclass' when 'error' then 'reject' when 'signup' then 'addbox' else 'edit' end"


def _actions(spark, d):
    action = map_values(F.col("event_type"), {"click": "confirm", "view": "reclass", "error": "reject", "signup": "addbox"}, "edit")
    return read_table(spark, d, "events").select("event_id", "user_id", "ts", "value", action.alias("action"),
                                                 F.when(_k() % 6 != 0, (_k() % 6).cast("string")).alias("label"))


@query("AGG-13", f"""
with a as (select {_ACTION_SQL} as action, coalesce(nullif((json_extract(props, '$.k')::bigint % 6)::varchar, '0'), 'unlabeled') as label from events)
select label, count(*) as total, count(*) filter (where action in ('reclass', 'reject', 'addbox')) as rework,
  round(count(*) filter (where action in ('reclass', 'reject', 'addbox'))::double / count(*), 4) as rework_rate,
  round(count(*) filter (where action = 'confirm')::double / count(*), 4) as confirm_rate,
  round(count(*) filter (where action = 'reclass')::double / count(*), 4) as reclass_rate,
  round(count(*) filter (where action = 'reject')::double / count(*), 4) as reject_rate,
  round(count(*) filter (where action = 'addbox')::double / count(*), 4) as addbox_rate from a group by 1""")
def rework_rate(spark, d):
    return A.rework_rate(_actions(spark, d), "action", "label")


@query("AGG-14", f"""
select strftime(ts, '%Y-%m-%d') as period, round(count(*) filter (where {_ACTION_SQL} in ('reclass', 'reject', 'addbox'))::double / count(*), 4) as rework_rate,
  count(*) as cnt from events group by 1""")
def rework_trend(spark, d):
    return A.rework_trend(_actions(spark, d), "action", "ts")


@query("AGG-15", """
with a as (select user_id, min(ts) as a from events where event_type = 'view' group by 1),
b as (select user_id, min(ts) as b from events where event_type = 'purchase' group by 1),
h as (select (epoch_us(b) - epoch_us(a)) / 3.6e9 as h from a join b using (user_id) where b >= a)
select round(median(h), 2) as median_hours, count(*) as sample_size from h""")
def critical_path_median(spark, d):
    events = read_table(spark, d, "events")
    return A.first_to_first(events.where("event_type = 'view'"), events.where("event_type = 'purchase'"), "user_id", "ts")


@query("AGG-16", """
select o_orderpriority as kind, count(*) filter (where o_orderstatus = 'F') as accepted, count(*) filter (where o_orderstatus = 'P') as dismissed,
  round(count(*) filter (where o_orderstatus = 'F')::double / nullif(count(*) filter (where o_orderstatus in ('F', 'P')), 0), 4) as rate
from orders group by 1""")
def adoption_rate(spark, d):
    status = map_values(F.col("o_orderstatus"), {"F": "accepted", "P": "dismissed"}, "open")
    return A.adoption(read_table(spark, d, "orders").withColumn("status", status), "o_orderpriority", "status")


@query("AGG-17", """
with r as (select d.lang, case when l.doc_id is null then null when quality = 1 then 'ready' else 'pending' end as status,
             case when toxic = 1 then 'toxic' end as error from documents d left join labels l on l.doc_id = d.doc_id),
c as (select lang, count(*) as total, count(status) as with_status, count(*) filter (where status = 'ready') as ready, count(error) as failed from r group by 1)
select lang, total, with_status, ready, failed, total - with_status as unprocessed,
  round_even(ready * 100 / total, 0)::bigint as percent, round_even(with_status * 100 / total, 0)::bigint as processed_percent from c""")
def coverage_stats(spark, d):
    status = read_table(spark, d, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "ready").otherwise("pending").alias("status"),
        F.when(F.col("toxic") == 1, "toxic").alias("error"))
    return A.coverage(read_table(spark, d, "documents"), status, "doc_id", "lang")


@query("AGG-36", """
select l_returnflag, count(l_extendedprice) as cnt, round(avg(l_extendedprice), 4) as mean, min(l_extendedprice) as min, max(l_extendedprice) as max,
  round(median(l_extendedprice), 4) as median from lineitem group by 1""")
def confidence_stats(spark, d):
    return (A.conf_stats(read_table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
            .withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4)))


@query("AGG-37", """
with h as (select lang, n_chars::double as conf, (quality = 1)::int as hit from documents join labels using (doc_id))
select lang, count(*) as n, case when min(conf) < max(conf) and min(hit) < max(hit) then round(corr(conf, hit), 6) end as corr from h group by 1""")
def calibration_corr(spark, d):
    rows = read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id")
    return (A.calibration(rows, ["lang"], "n_chars", F.col("quality") == 1).withColumn("corr", F.round("corr", 6)))


# Words that do occur in the test prose; a caller passes its own patterns.
PATTERNS = {"order": r"there|thre", "change": r"(?i)tion le|tion the", "mismatch": r"\|", "embed": r"sch der|der sch",
            "late": r"[0-9]{3}", "rare": r"(?i)xyzzy|lorem"}


@query("AGG-38", r"""
with l as (select source, lang = 'en' as cost, unnest(string_split(text, chr(10))) as line from documents),
base as (select avg(cost::int) as b from l),
h as (select 'order' as pattern, * from l where regexp_matches(line, 'there|thre')
  union all select 'change', * from l where regexp_matches(line, '(?i)tion le|tion the')
  union all select 'mismatch', * from l where regexp_matches(line, '\|')
  union all select 'embed', * from l where regexp_matches(line, 'sch der|der sch')
  union all select 'late', * from l where regexp_matches(line, '[0-9]{3}')
  union all select 'rare', * from l where regexp_matches(line, '(?i)xyzzy|lorem'))
select pattern, count(*) as lines, round(avg(cost::int), 6) as cost_rate, round(avg(cost::int) / (select b from base), 6) as lift,
  count(distinct source) as projects, count(distinct source) >= 5 as reliable from h group by 1""")
def lift_table(spark, d):
    lines = read_table(spark, d, "documents").select(
        "source", (F.col("lang") == "en").alias("cost"), F.explode(F.split("text", "\n")).alias("line"))
    return (A.lift(lines, "line", PATTERNS, F.col("cost"), "source")
            .withColumn("cost_rate", F.round("cost_rate", 6)).withColumn("lift", F.round("lift", 6)))


@query("AGG-39", r"""
with l as (select lang, source, regexp_replace(lower(line), '[0-9\s.,;:!?()\[\]|\-]+', '', 'g') as l
           from (select lang, source, unnest(string_split(text, chr(10))) as line from documents)),
s as (select lang, l, count(distinct source) as n from l where length(l) >= 6 group by 1, 2)
select lang, count(*) as lines, count(*) filter (where n >= 2) as on_2_dates, count(*) filter (where n >= 3) as on_3_dates from s group by 1""")
def recurrence(spark, d):
    lines = read_table(spark, d, "documents").select("lang", "source", F.explode(F.split("text", "\n")).alias("line"))
    return A.recurring(lines, "lang", "source", "line")


@query("AGG-40", """
select md5(text) as number, count(*) as copies, string_agg(distinct source, ',' order by source) as versions, count(distinct source) > 1 as conflict
from documents group by 1 having count(*) > 1""")
def duplicate_groups(spark, d):
    rows = read_table(spark, d, "documents").select(F.md5("text").alias("number"), "source")
    return A.duplicates(rows, "number", "source").withColumn("versions", F.array_join("versions", ","))


@query("AGG-41", """
with i as (select l_orderkey, l_returnflag, case when l_quantity >= 10 then
    array_to_string(list_sort(['L' || l_linenumber, 'L' || (l_suppkey % 5)]), '|') || '@' || (l_partkey % 30) end as location_key from lineitem)
select location_key, count(*) as cnt, count(distinct l_orderkey) as drawings, string_agg(distinct l_returnflag, ',' order by l_returnflag) as disciplines
from i where location_key is not null group by 1 having count(distinct l_orderkey) >= 2""")
def location_clusters(spark, d):
    big = F.col("l_quantity") >= 10
    levels = F.when(big, F.array(F.concat(F.lit("L"), F.col("l_linenumber")), F.concat(F.lit("L"), F.col("l_suppkey") % 5)))
    axes = F.when(big, F.array((F.col("l_partkey") % 30).cast("string")))
    return (A.clusters(read_table(spark, d, "lineitem"), A.location_key(levels, axes), "l_orderkey", "l_returnflag")
            .withColumn("disciplines", F.array_join("disciplines", ",")))


@query("AGG-42", """
select 'obj' || (json_extract(props, '$.k')::bigint % 40) as name, count(*) as cnt from events group by 1
union all select event_type, count(*) from events where value > 30 group by 1""")
def object_ranking(spark, d):
    names = F.array_compact(F.array(
        F.struct(F.concat(F.lit("obj"), _k() % 40).alias("name")),
        F.when(F.col("value") > 30, F.struct(F.col("event_type").alias("name")))))
    rows = read_table(spark, d, "events").select(F.to_json(F.struct(names.alias("objects"))).alias("method"))
    return A.top_objects(rows, "method", "$.objects")


@query("AGG-43", f"""
select b.rank::int as rank, b.severity, count(o.o_orderkey) as n from (values (0, 'critical'), (1, 'high'), (2, 'medium'), (3, 'low'), (4, 'unseen')) b(rank, severity)
left join orders o on {PRIORITY_CASE} = b.severity group by 1, 2""")
def fixed_bins(spark, d):
    rows = read_table(spark, d, "orders").select(map_values(F.col("o_orderpriority"), PRIORITY_SEVERITY, "low").alias("severity"))
    return A.distribution(rows, "severity", ["critical", "high", "medium", "low", "unseen"])


@query("AGG-44", """
with c as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by 1, 2)
select l_orderkey, string_agg(l_returnflag || '=' || n, ',' order by l_returnflag) as engines, sum(n)::bigint as total from c group by 1""")
def engine_summary(spark, d):
    out = A.engine_map(read_table(spark, d, "lineitem"), "l_orderkey", "l_returnflag")
    shown = F.transform(F.map_entries("engines"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.withColumn("engines", F.array_join(shown, ","))


@query("AGG-45", r"""
with m as (select distinct doc_id, source, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2}[,.0-9]'))) as mark from documents)
select mark, count(distinct doc_id) as drawing_count, count(distinct source) as floor_count from m group by 1""")
def mark_index(spark, d):
    return A.mark_index(read_table(spark, d, "documents"), F.col("text"), r"[A-Z][a-z]{2}[,.0-9]", "doc_id", "source")


def _annotations(spark, d):
    k = _k()
    context = F.to_json(F.struct(
        F.concat(F.lit("raw"), k % 10).alias("raw_text"), F.when(F.col("value") > 10, "handdrawn").otherwise("picked").alias("source"),
        F.col("value").alias("span"), (k % 8).cast("string").alias("page_aspect")))
    kind = map_values(F.col("event_type"), {"click": "discipline", "view": "axis", "error": "title_block", "signup": "scale"}, "other")
    return read_table(spark, d, "events").select(
        "event_id", "user_id", "ts", kind.alias("kind"), F.concat(F.lit("w"), k % 25).alias("human_value"),
        F.when(F.col("value") > 20, F.concat(F.lit("w"), k % 20)).alias("auto_value"), context.alias("context"))


_ANNOTATIONS = """a as (select event_id, case event_type when 'click' then 'discipline' when 'view' then 'axis' when 'error' then 'title_block' when 'signup' then 'scale' else 'other' end as kind,
  'w' || (json_extract(props, '$.k')::bigint % 25) as human, case when value > 20 then 'w' || (json_extract(props, '$.k')::bigint % 20) end as auto,
  'raw' || (json_extract(props, '$.k')::bigint % 10) as raw, value, json_extract(props, '$.k')::bigint % 8 as aspect from events)"""


@query("AGG-46", f"""
with {_ANNOTATIONS},
r as (select *, row_number() over (partition by human order by event_id) as rn from a where kind = 'discipline' and auto is null)
select human as word, count(*) as times, string_agg(case when rn <= 5 then raw end, ',' order by rn) as samples, least(0.5::double + round(count(*) * 0.1::double, 4), 0.95::double) as confidence
from r group by 1 having count(*) >= 3""")
def evidence_words(spark, d):
    return E.new_vocabulary(_annotations(spark, d)).withColumn("samples", F.array_join("samples", ","))


@query("AGG-47", f"""
with {_ANNOTATIONS}
select raw, human as corrected, count(*) as times, round(least(0.4::double + count(*) * 0.12::double, 0.9::double), 4) as confidence from a group by 1, 2 having count(*) >= 3""")
def evidence_pairs(spark, d):
    return E.corrections(_annotations(spark, d))


@query("AGG-48", f"""
with {_ANNOTATIONS},
x as (select count(*) as total, count(*) filter (where value > 10) as hand, min(value) filter (where value > 10) as span from a where kind = 'axis')
select 'threshold' as kind, 'min_span' as target, hand as impact, round(span * 0.9::double, 3) as value, round(least(0.4::double + hand / total * 0.5::double, 0.9::double), 4) as confidence
from x where total >= 3 and hand / total >= 0.4
union all select 'algorithm', 'layout ' || aspect, count(*), null, 0.7::double from a where kind = 'title_block' group by aspect having count(*) >= 6
union all select * from (select 'algorithm', 'scale', count(*) as n, null, 0.6::double from a where kind = 'scale' and auto is not null and auto <> human) where n >= 3""")
def evidence_thresholds(spark, d):
    return E.threshold_hints(_annotations(spark, d))


@query("AGG-52", """
with b as (select 6 + 2 * (l_linenumber) as diameter, l_returnflag as grade, l_extendedprice as len, l_quantity::bigint as n from lineitem),
s as (select diameter, grade, sum(n)::bigint as pieces, sum((len * n)::decimal(28,2))::double as length from b group by 1, 2),
w as (select *, case when diameter <= 10 then 0.06::double when diameter <= 16 then 0.045::double when diameter <= 22 then 0.04::double else 0.035::double end as r, diameter * diameter / 162.0::double / 1000 as kg from s)
select diameter, grade, pieces, round(length, 2) as length_mm, round(length * kg, 2) as steel_kg, round(length * r / (1 - r) * kg, 2) as field_waste_kg,
  round(greatest((length * r / (1 - r) - length * 0.015::double / (1 - 0.015::double)) * kg, 0), 2) as saving_kg,
  round(greatest((length * r / (1 - r) - length * 0.015::double / (1 - 0.015::double)) * kg, 0) / 1000 * 4200, 2) as saving_cost from w""")
def rebar_demand(spark, d):
    bars = read_table(spark, d, "lineitem").select(
        (6 + 2 * F.col("l_linenumber")).alias("diameter"), F.col("l_returnflag").alias("grade"),
        F.col("l_extendedprice").alias("len"), F.col("l_quantity").cast("long").alias("n"))
    return A.steel_demand(bars, "diameter", "grade", "len", "n", [(10, 0.06), (16, 0.045), (22, 0.04), (999, 0.035)], 0.015, 4200)


@query("AGG-53", """
select 'suspect_scale' as task, 'high' as severity, count(*) as cnt from orders where o_orderstatus = 'P'
union all select 'component_review', 'medium', count(*) from lineitem where l_discount < 0.02::double
union all select 'story_height', 'medium', count(*) from events where event_type = 'error'""")
def task_board(spark, d):
    return A.task_counts([
        ("story_height", "medium", read_table(spark, d, "events").where("event_type = 'error'")),
        ("component_review", "medium", read_table(spark, d, "lineitem").where(F.col("l_discount") < 0.02)),
        ("suspect_scale", "high", read_table(spark, d, "orders").where("o_orderstatus = 'P'"))])


@query("AGG-54", """
with h as (select l_suppkey, floor(avg(l_extendedprice * 3)) as ms from (
    select *, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc) as r from lineitem where l_linestatus = 'F') where r <= 20 group by 1)
select p_partkey, l_suppkey, case when ms > 0 then greatest(45, least(900, floor(ms / 1000 * 1.25::double))) else greatest(90, least(900, 90 + greatest(1, floor(kb / 1024)) * 6)) end::bigint as eta_seconds
from (select p_partkey, p_partkey % 130 as l_suppkey, p_size * 100 as kb from part) j left join h using (l_suppkey)""")
def eta_estimate(spark, d):
    jobs = read_table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 130).alias("l_suppkey"), (F.col("p_size") * 100).alias("kb"))
    history = read_table(spark, d, "lineitem").where("l_linestatus = 'F'").withColumn("took", F.col("l_extendedprice") * 3)
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")]
    return A.eta(jobs, history, "l_suppkey", "kb", "took", order).drop("kb")


@query("AGG-55", """
with r as (select o_orderstatus, case when o_orderpriority = '5-LOW' then 'not_applicable' when o_totalprice < 50000 then 'defaulted' when o_totalprice > 450000 then 'unresolved' end as reason from orders)
select o_orderstatus, count(*) as total, count(*) filter (where reason is null) as assigned, count(*) filter (where reason = 'not_applicable') as not_applicable,
  count(*) filter (where reason in ('defaulted', 'unresolved')) as actionable from r group by 1""")
def assignment_summary(spark, d):
    from ..operators.projections import with_reason

    rows = with_reason(read_table(spark, d, "orders"), [
        ("not_applicable", F.col("o_orderpriority") == "5-LOW"), ("defaulted", F.col("o_totalprice") < 50000),
        ("unresolved", F.col("o_totalprice") > 450000)])
    return A.reason_summary(rows, ["o_orderstatus"], "reason", ["not_applicable"], ["defaulted", "unresolved"])


@query("AGG-56", """
with a as (select p_brand, p_type, p_retailprice as pos, p_partkey, p_size * 100 as spacing,
   lag(p_retailprice) over (partition by p_brand, p_type order by p_retailprice, p_partkey) as prev from part),
s as (select p_brand, spacing / 1000.0::double / (abs(pos - prev) * 2) as s from a where prev is not null and spacing > 0 and abs(pos - prev) * 2 > 1e-6),
r as (select *, row_number() over (partition by p_brand order by s) - 1 as rn, count(*) over (partition by p_brand) as n from s)
select p_brand, round(max(case when rn = n // 2 then s end), 8) as scale, max(n) as samples, round((max(s) - min(s)) / max(case when rn = n // 2 then s end), 4) as spread from r group by 1""")
def scale_from_spacing(spark, d):
    rows = read_table(spark, d, "part").withColumn("spacing", F.col("p_size") * 100)
    return A.scale_from_spacing(rows, ["p_brand"], "p_type", "p_retailprice", "spacing", "p_partkey", 2.0)


@query("AGG-60", """
select o_orderpriority, count(distinct l_suppkey) as suppliers, count(distinct l_partkey) as parts, count(distinct o_custkey) as customers
from orders join lineitem on o_orderkey = l_orderkey group by 1""")
def exact_distinct(spark, d):
    rows = read_table(spark, d, "orders").join(
        read_table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return A.distinct_counts(rows, ["o_orderpriority"], suppliers="l_suppkey", parts="l_partkey", customers="o_custkey")
