"""Window functions and ordered scans bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as N
from ..sources.tables import read_table
from .catalog import query


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("WIN-01", """
select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1""")
def latest_per_key(spark, d):
    return N.latest(read_table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


_ARCHIVE = """a as (select event_id as id, user_id % 40 as project, case event_type when 'click' then 'elevation' when 'view' then 'dimension' when 'signup' then 'axis' else 'note' end as category,
  value, json_extract(props, '$.k')::bigint as k, case when value > 25 then 'verified' else 'auto' end as kind, event_type <> 'purchase' or value > 1 as active, case when json_extract(props, '$.k')::bigint % 4 <> 0 then value / 500 end as conf from events),
r as (select *, case category when 'elevation' then 'elevation:' || (k % 30)::double when 'dimension' then 'dimension:' || (k % 25)::double when 'axis' then 'axis:L' || k % 20 else 'note:text ' || k % 15 end as key,
  case when kind = 'verified' and category = 'elevation' then 'elevation:' || (k % 30 + 1)::double when kind = 'verified' and category = 'note' then 'note:text ' || (k % 15 + 1) end as sup from a)"""


def _archive(spark, d):
    k = _k()
    rows = read_table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("project"),
        F.when(F.col("event_type") == "click", "elevation").when(F.col("event_type") == "view", "dimension")
        .when(F.col("event_type") == "signup", "axis").otherwise("note").alias("category"),
        F.concat(F.lit(" text "), k % 15).alias("content"), k.alias("k"), F.concat(F.lit("L"), k % 20).alias("label"),
        F.when(F.col("value") > 25, "verified").otherwise("auto").alias("source_kind"),
        ((F.col("event_type") != "purchase") | (F.col("value") > 1)).alias("is_active"),
        F.when(k % 4 != 0, F.col("value") / 500).alias("confidence"))
    number = F.when(F.col("category") == "elevation", F.col("k") % 30).when(F.col("category") == "dimension", F.col("k") % 25).cast("double")
    rows = rows.withColumn("key", N.archive_key(F.col("category"), F.col("content"), number, F.col("label")))
    verified = F.col("source_kind") == "verified"
    return rows.withColumn("supersedes_key", F.when(verified & (F.col("category") == "elevation"), F.concat(F.lit("elevation:"), (F.col("k") % 30 + 1).cast("double")))
                           .when(verified & (F.col("category") == "note"), F.concat(F.lit("note:text "), F.col("k") % 15 + 1)))


@query("WIN-02", f"""
with {_ARCHIVE},
l as (select * from r where active and not (kind = 'auto' and exists (select 1 from r v where v.project = r.project and v.category = r.category and v.kind = 'verified' and v.sup = r.key)))
select project, category, key, id, kind as source_kind from (select *, row_number() over (partition by project, category, key order by kind = 'verified' desc, coalesce(conf, 1) desc, id) as n from l) where n = 1""")
def effective_values(spark, d):
    return N.effective(_archive(spark, d), ["project"], "id").select("project", "category", "key", "id", "source_kind")


@query("WIN-03", """
select l_partkey, l_orderkey, l_linenumber, src from (select *, case l_returnflag when 'A' then 'manual' when 'R' then 'section' else 'default' end as src,
  row_number() over (partition by l_partkey order by case l_returnflag when 'A' then 3 when 'R' then 2 else 0 end desc, l_extendedprice desc, l_orderkey, l_linenumber) as n from lineitem) where n = 1""")
def choose_by_priority(spark, d):
    rows = read_table(spark, d, "lineitem").withColumn(
        "src", F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "R", "section").otherwise("default"))
    return (N.choose(rows, ["l_partkey"], "src", "l_extendedprice", {"manual": 3, "section": 2}, "l_orderkey")
            .select("l_partkey", "l_orderkey", "l_linenumber", "src"))


@query("WIN-04", """
with g as (select (epoch_us(ts) - lag(epoch_us(ts)) over (partition by case when user_id % 3 <> 0 then user_id::varchar else 'unknown' end order by ts, event_id)) / 1e6 as g from events)
select round(median(g), 1) as median_seconds, count(g) as sample_size from g""")
def action_gap_median(spark, d):
    rows = read_table(spark, d, "events").withColumn("reviewer", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return N.gap_median(rows, "reviewer", "ts", "event_id")


_LEVELS = """s as (select l_suppkey, l_partkey % 60 as ord, min(l_extendedprice) / 97 as elev, max(case when l_tax > 0.01::double then l_quantity / 5 end) as h from lineitem group by 1, 2)"""


def _levels(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 60).alias("ord")).agg(
        (F.min("l_extendedprice") / 97).alias("elev"), F.max(F.when(F.col("l_tax") > 0.01, F.col("l_quantity") / 5)).alias("h"))


@query("WIN-05", f"""
with {_LEVELS}, n as (select *, round(lead(elev) over (partition by l_suppkey order by ord) - elev, 3) as height from s)
select l_suppkey, ord, height, height between 2.5 and 9 as reasonable from n""")
def lead_difference(spark, d):
    return N.heights(_levels(spark, d), ["l_suppkey"], ["ord"], "elev").select("l_suppkey", "ord", "height", "reasonable")


@query("WIN-06", f"""
with {_LEVELS},
p as (select *, coalesce(sum(coalesce(h, 0)) over w, 0) as p, coalesce(sum((h is null)::int) over w, 0) as m from s window w as (partition by l_suppkey order by ord rows between unbounded preceding and 1 preceding)),
b as (select l_suppkey, p as bp, m as bm from p where ord = 30)
select p.l_suppkey, ord, round(s_acctbal + p - bp, 3) as elevation from p join b using (l_suppkey) join supplier on s_suppkey = l_suppkey where m = bm""")
def running_from_base(spark, d):
    base = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("base_elevation"))
    return (N.elevations(_levels(spark, d), base, ["l_suppkey"], ["ord"], "h", F.col("ord") == 30)
            .select("l_suppkey", "ord", "elevation"))


@query("WIN-07", f"""
with {_LEVELS}, n as (select *, round(lead(elev) over (partition by l_suppkey order by ord) - elev, 3) as derived from s)
select l_suppkey, ord, derived, h as stated, round(abs(derived - h), 3) as diff from n where derived is not null and h is not null and abs(derived - h) > 2""")
def cross_validate(spark, d):
    rows = _levels(spark, d)
    return N.cross_check(rows, rows, ["l_suppkey"], "ord", ["ord"], "elev", "h", 2.0)


@query("WIN-08")
def monotone_keep(spark, d):
    rows = read_table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("ord")).agg(
        F.min_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_partkey")).alias("elev"), F.count("*").alias("support"))
    return N.monotone(rows, ["l_suppkey"], "ord", "elev", "support")


@query("WIN-09", """
with recursive e as (select user_id, json_extract(props, '$.k')::bigint as k, row_number() over (partition by user_id order by value, event_id) as rn from events),
n as (select user_id, count(*) as n from e group by 1),
t as (select user_id, 0::bigint as rn, []::bigint[] as tails from n
  union all select t.user_id, e.rn, list_concat(list_filter(tails, lambda x: x < k), [k], list_filter(tails, lambda x: x >= k)[2:]) from t join e on e.user_id = t.user_id and e.rn = t.rn + 1),
l as (select user_id, max_by(len(tails), rn) as l from t group by 1)
select user_id, n as total, n - l as outliers, n - l >= 2 and (n - l) / n >= 0.2 as drop from n join l using (user_id)""")
def lis_outliers(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "value", _k().alias("k"), "event_id")
    return N.lis_outliers(rows, ["user_id"], "value", "k", "event_id")


@query("WIN-10", """
with e as (select user_id, json_extract(props, '$.k')::bigint as k, row_number() over (partition by user_id order by ts, event_id) as rn from events),
i as (select a.user_id, count(*) as inv from e a join e b on a.user_id = b.user_id and a.rn < b.rn and a.k > b.k group by 1),
n as (select user_id, count(*) as n from e group by 1)
select user_id, n, case when n >= 3 then round(coalesce(inv, 0) / (n * (n - 1) / 2), 6) end as inversion_rate from n left join i using (user_id)""")
def inversion_rate(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "ts", "event_id", _k().alias("k"))
    return (N.inversions(rows, ["user_id"], ["ts", "event_id"], "k")
            .withColumn("inversion_rate", F.round("inversion_rate", 6)))


@query("WIN-11", """
with g as (select user_id, value, event_id, value - lag(value) over (partition by user_id order by value, event_id) as gap from events),
r as (select user_id, gap, row_number() over (partition by user_id order by gap) as rn, count(*) over (partition by user_id) as n from g where gap is not null),
t as (select user_id, median(gap) as m from r where rn <= greatest(1, n // 2) group by 1),
f as (select g.*, (gap is null or gap > greatest(m * 6, 8))::int as s from g left join t using (user_id))
select user_id, event_id, sum(s) over (partition by user_id order by value, event_id)::bigint as island from f""")
def gaps_and_islands(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "value", "event_id")
    return (N.split_by_gap(rows, ["user_id"], "value", "event_id", 6.0, 8.0)
            .select("user_id", "event_id", "island"))


@query("WIN-12", """
with s as (select user_id, event_id, value as lo, value + json_extract(props, '$.k')::bigint % 3 as hi from events),
r as (select *, max(hi) over (partition by user_id order by lo, event_id rows between unbounded preceding and 1 preceding) as reach from s),
f as (select *, sum((reach is null or lo - reach > 0.5)::int) over (partition by user_id order by lo, event_id) as island from r)
select user_id, island::bigint as island, min(lo) as lo, max(hi) as hi, count(*) as pieces from f group by 1, 2""")
def merge_spans(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("lo"), (F.col("value") + _k() % 3).alias("hi"))
    return N.merge_spans(rows, ["user_id"], "lo", "hi", "event_id", 0.5)


@query("WIN-13", """
with recursive v as (select user_id, list(distinct value order by value) as ys from events group by 1),
b as (select user_id, ys, ys[1] as first, 1 as row_no from v
  union all select user_id, ys, list_filter(ys, lambda y: y - first > 1.5)[1], row_no + 1 from b where len(list_filter(ys, lambda y: y - first > 1.5)) > 0)
select e.user_id, e.event_id, max(row_no)::bigint as row_no from events e join b on b.user_id = e.user_id and b.first <= e.value group by 1, 2""")
def tolerance_rows(spark, d):
    rows = read_table(spark, d, "events").select("user_id", "event_id", "value")
    return N.row_bands(rows, ["user_id"], "value", 1.5).select("user_id", "event_id", "row_no")


@query("WIN-14", """
with p as (select l_suppkey, l_partkey % 30 as cell, l_linenumber as o from lineitem group by 1, 2, 3),
b as (select l_suppkey, cell, min(o) as lo, max(o) as hi, string_agg(o::varchar, ',' order by o) as present from p group by 1, 2),
m as (select b.*, unnest(range(lo, hi + 1)) as o from b)
select l_suppkey, cell, present, string_agg(o::varchar, ',' order by o) as missing from m
where not exists (select 1 from p where p.l_suppkey = m.l_suppkey and p.cell = m.cell and p.o = m.o) group by 1, 2, 3""")
def floor_gap_check(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 30).alias("cell"), "l_linenumber")
    return N.missing_between(rows, ["l_suppkey", "cell"], "l_linenumber").select(
        "l_suppkey", "cell", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@query("WIN-15")
def nearby_dedupe(spark, d):
    rows = read_table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 500).cast("double").alias("y"), (F.col("o_totalprice") % 997).alias("score"))
    return N.dedupe_near(rows, "o_orderkey", "x", "y", "score", 4.0)


@query("WIN-15")
def overlap_dedupe(spark, d):
    boxes = read_table(spark, d, "part").select(
        "p_partkey", "p_type", (F.col("p_partkey") % 97 * 3.0).alias("x0"), (F.col("p_size") * 2.0).alias("y0"),
        (F.col("p_partkey") % 97 * 3.0 + 7).alias("x1"), (F.col("p_size") * 2.0 + 6).alias("y1"), F.col("p_retailprice").alias("score"))
    return N.dedupe_boxes(boxes, "p_partkey", "score", ["p_type"], 0.4)


@query("WIN-16", """
select p_partkey, p_brand, row_number() over (partition by p_brand order by p_name, p_partkey) as seq from part""")
def sequence_numbering(spark, d):
    return N.number_rows(read_table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], ["p_name", "p_partkey"]).select("p_partkey", "p_brand", "seq")


@query("WIN-16", """
with s as (select p_partkey, case when p_size % 3 = 0 then (p_size)::varchar when p_size % 3 = 1 then '2-' || p_size else substr('ABCDEFGHJKLMNPQRSTUVWXY', p_size % 23 + 1, 1) end as start_label, p_size, p_partkey % 9 + 1 as n from part),
e as (select *, unnest(range(0, n)) as idx from s)
select p_partkey, idx::int as idx, case when p_size % 3 = 0 then (p_size + idx)::varchar when p_size % 3 = 1 then '2-' || (p_size + idx)
  else repeat(substr('ABCDEFGHJKLMNPQRSTUVWXY', ((p_size % 23 + idx) % 23 + 1)::int, 1), ((p_size % 23 + idx) // 23 + 1)::int) end as label from e""")
def label_expansion(spark, d):
    size = F.col("p_size")
    letters = F.lit(N.AXIS_LETTERS)
    start = (F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, F.concat(F.lit("2-"), size))
             .otherwise(F.substring(letters, size % 23 + 1, F.lit(1))))
    rows = read_table(spark, d, "part").select("p_partkey", start.alias("start_label"), (F.col("p_partkey") % 9 + 1).cast("int").alias("n"))
    return N.expand_labels(rows, "start_label", "n").select("p_partkey", "idx", "label")


@query("WIN-17", """
with r as (select *, row_number() over (partition by l_returnflag, l_partkey order by l_discount desc, l_extendedprice, l_orderkey, l_linenumber) as n, count(*) over (partition by l_returnflag, l_partkey) - 1 as conflicts from lineitem)
select l_returnflag, l_partkey, l_orderkey, l_extendedprice, conflicts from r where n = 1""")
def label_uniqueness(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_returnflag", F.col("l_partkey").cast("string").alias("label"), "l_orderkey", "l_extendedprice", "l_discount", "l_linenumber")
    out = N.one_per_label(rows, ["l_returnflag"], "label", [F.desc("l_discount"), F.asc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return out.select("l_returnflag", F.col("label").cast("long").alias("l_partkey"), "l_orderkey", "l_extendedprice", "conflicts")


@query("WIN-18", """
with f as (select p_brand, p_size, count(*) as n from part group by 1, 2),
b as (select a.p_brand, a.p_size as lo, (select sum(n) from f where f.p_brand = a.p_brand and f.p_size >= a.p_size and f.p_size < a.p_size + 6) as c from f a),
m as (select p_brand, lo from (select *, row_number() over (partition by p_brand order by c desc, lo) as r from b) where r = 1)
select p_partkey, p.p_brand, p_size::double as size from part p join m on m.p_brand = p.p_brand and p_size >= lo and p_size < lo + 6""")
def majority_mode_cluster(spark, d):
    rows = read_table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"))
    return N.modal_cluster(rows, ["p_brand"], "size", 6.0)


@query("WIN-18", """
with v as (select distinct event_type, value from events),
g as (select *, value - lag(value) over (partition by event_type order by value) as gap from v),
i as (select event_type, value, sum((gap is null or gap > 0.02)::int) over (partition by event_type order by value) as island from g),
s as (select i.event_type, island, count(*) as members, avg(e.value) as m from i join events e on e.event_type = i.event_type and e.value = i.value group by 1, 2)
select event_type, members, round(m, 2) as dominant from (select *, row_number() over (partition by event_type order by members desc, island) as r from s) where r = 1""")
def dominant_chain(spark, d):
    rows = read_table(spark, d, "events").select("event_type", "value")
    out = N.dominant_value(rows, ["event_type"], "value", 0.02)
    return out.select("event_type", "members", "dominant")
