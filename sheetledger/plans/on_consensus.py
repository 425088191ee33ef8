"""Votes, consensus, anomalies, fits and assembly bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggs import noisy_or, unanimous
from ..operators import assembly as B
from ..operators import consensus as C
from ..sources.tables import read_table
from .catalog import query


@query("AGG-18", """
with v as (select l_partkey, l_returnflag || l_linenumber as label, count(*) as votes, max(l_extendedprice) as c from lineitem where l_quantity > 2 group by 1, 2)
select l_partkey, label, votes from (select *, row_number() over (partition by l_partkey order by votes desc, c desc, label) as r from v) where r = 1""")
def majority_vote(spark, d):
    rows = read_table(spark, d, "lineitem").select(
        "l_partkey", "l_extendedprice", F.when(F.col("l_quantity") > 2, F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("label"))
    return C.vote(rows, ["l_partkey"], "label", "l_extendedprice")


_BALLOT = """o as (select distinct l_suppkey, l_orderkey, l_quantity as value from lineitem where l_quantity between -60 and 300),
t as (select l_suppkey, value, count(*) as votes from o group by 1, 2)"""


@query("AGG-19", f"""
with {_BALLOT}, b as (select *, row_number() over (partition by l_suppkey order by votes desc, value) as r from t)
select l_suppkey, case when votes >= 20 then value end as value, case when votes >= 20 then votes else 0 end as support from b where r = 1""")
def supported_vote(spark, d):
    return C.vote_min_support(read_table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", "l_quantity", 20)


@query("AGG-20", f"""
with {_BALLOT}, g as (select value, count(*) as n from t group by 1),
b as (select t.*, votes / n as score, row_number() over (partition by l_suppkey order by votes / n desc, t.value) as r from t join g using (value) where votes >= 15)
select s.l_suppkey, b.value, coalesce(b.votes, 0) as support, round(b.score, 6) as score from (select distinct l_suppkey from t) s left join b on b.l_suppkey = s.l_suppkey and r = 1""")
def idf_vote(spark, d):
    out = C.discriminative_vote(read_table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_quantity", 15)
    return out.withColumn("score", F.round("score", 6))


_WITNESS = """w as (select l_partkey, value, count(*) as witnesses from (select distinct l_partkey, l_orderkey, round(l_discount, 3) as value from lineitem) group by 1, 2),
b as (select * from w where witnesses >= 5)"""


@query("AGG-21", f"with {_WITNESS} select l_partkey, max(value) as value, max(witnesses) as witnesses from b group by 1 having count(*) = 1")
def witness_consensus(spark, d):
    return C.consensus(read_table(spark, d, "lineitem"), ["l_partkey"], "l_orderkey", "l_discount", 5)


@query("AGG-22", f"with {_WITNESS} select b.*, n as rivals from b join (select l_partkey, count(*) as n from b group by 1) using (l_partkey) where n > 1")
def witness_conflict(spark, d):
    return C.conflicts(read_table(spark, d, "lineitem"), ["l_partkey"], "l_orderkey", "l_discount", 5)


@query("AGG-23", """
select o_custkey, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end as status from orders group by 1""")
def unanimous_or_null(spark, d):
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(unanimous("o_orderstatus").alias("status"))


@query("AGG-24", """
select l_orderkey, case when max((l_discount * 10 >= 1)::int) = 1 then 1 else round(1 - exp(sum(case when l_discount * 10 < 1 then ln(1 - l_discount * 10) else 0 end)), 4) end as confidence
from lineitem group by 1""")
def noisy_or_confidence(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(noisy_or(F.col("l_discount") * 10).alias("confidence"))


@query("AGG-25", """
select l_suppkey, round(avg(l_quantity), 3) as cx, round(avg(l_extendedprice), 3) as cy, count(*) as observations,
  arg_max(l_orderkey || ':' || l_partkey, struct_pack(c := l_extendedprice, t := -l_orderkey)) filter (where l_returnflag <> 'N') as outline from lineitem group by 1""")
def centroid_best_outline(spark, d):
    rows = read_table(spark, d, "lineitem").withColumn(
        "geom", F.when(F.col("l_returnflag") != "N", F.concat_ws(":", "l_orderkey", "l_partkey")))
    return C.summarize_obs(rows, ["l_suppkey"], "l_quantity", "l_extendedprice", "geom", "l_extendedprice", "l_orderkey")


@query("AGG-26")
def entity_assembly(spark, d):
    line = read_table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "column").when(F.col("l_returnflag") == "N", "beam").otherwise("pile")
    obs = line.select(
        kind.alias("type"), F.col("l_linestatus").alias("building"), F.concat(F.lit("F"), F.col("l_linenumber")).alias("floor"),
        F.when(F.col("l_suppkey") % 9 != 0, F.concat_ws("-", F.col("l_suppkey") % 9, F.col("l_partkey") % 11)).alias("grid_cell"),
        F.when(F.col("l_tax") < 0.08, (F.col("l_suppkey") % 9) * 8 + F.col("l_discount") * 30).alias("x"),
        F.when(F.col("l_tax") < 0.08, (F.col("l_partkey") % 11) * 8 + F.col("l_quantity") / 20).alias("y"),
        (F.col("l_discount") * 5 + 0.05).alias("confidence"), F.col("l_returnflag").alias("type_label"),
        F.concat_ws(",", "l_orderkey", "l_partkey").alias("outline"), F.col("l_orderkey").alias("drawing_id"),
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("obs_id"))
    return B.assemble(obs)


_AXES = """x as (select user_id % 10 as zone, user_id, json_extract(props, '$.k')::bigint % 20 as label, value from events)"""


def _axes(spark, d):
    return read_table(spark, d, "events").select(
        (F.col("user_id") % 10).alias("zone"), "user_id", (F.get_json_object("props", "$.k").cast("long") % 20).alias("label"), "value")


@query("AGG-27", f"with {_AXES} select zone, label, round(median(value), 6) as pos, count(*) as seen from x group by 1, 2")
def median_consensus(spark, d):
    return C.axis_consensus(_axes(spark, d), ["zone"], "label", "value").withColumn("pos", F.round("pos", 6))


@query("AGG-28", f"""
with {_AXES},
g1 as (select zone, label, median(value) as pos from x group by 1, 2),
o as (select x.zone, user_id, median(pos - value) as off from x join g1 using (zone, label) group by 1, 2),
f as (select x.zone, x.user_id, off, median(abs(off - (pos - value))) as res from x join g1 using (zone, label) join o on o.zone = x.zone and o.user_id = x.user_id group by 1, 2, 3)
select x.zone, label, round(median(value + off), 6) as pos, count(*) as seen from x join f on f.zone = x.zone and f.user_id = x.user_id where res <= 25 group by 1, 2""")
def two_pass_consensus(spark, d):
    return C.robust_consensus(_axes(spark, d), "zone", "user_id", "label", "value", 25.0)[0].withColumn("pos", F.round("pos", 6))


@query("AGG-29")
def frame_clusters(spark, d):
    rows = _axes(spark, d).groupBy("zone", "user_id", "label").agg(F.avg("value").alias("value"))
    return C.frames(rows, "zone", "user_id", "label", "value", 30.0)


@query("AGG-30", """
with s as (select l_orderkey % 50 as grp, l_orderkey, max(l_extendedprice * l_discount) - min(l_extendedprice * l_discount) as span from lineitem group by 1, 2),
m as (select grp, median(span) as md, count(*) as n from s where span > 0 group by 1)
select s.grp, l_orderkey, span, round(md, 6) as median_span from s join m using (grp) where n >= 4 and span > md * 2""")
def span_outliers(spark, d):
    spans = (read_table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("grp"), "l_orderkey")
             .agg((F.max(F.col("l_extendedprice") * F.col("l_discount")) - F.min(F.col("l_extendedprice") * F.col("l_discount"))).alias("span")))
    return C.span_outliers(spans, ["grp"], "l_orderkey", "span", 2.0)


@query("AGG-31", """
with g as (select l_returnflag, l_orderkey, l_quantity as gap from lineitem),
c as (select l_returnflag, median(gap) as consensus from g group by 1),
w as (select l_returnflag, gap, count(distinct l_orderkey) as witnesses from g group by 1, 2)
select g.l_returnflag, l_orderkey, g.gap, round(consensus, 2) as consensus, round(g.gap / consensus, 3) as ratio, witnesses,
  case when g.gap between 2 and 30 then 'scale' else 'detection' end as cause
from g join c using (l_returnflag) join w on w.l_returnflag = g.l_returnflag and w.gap = g.gap
where (g.gap / consensus < 0.5 or g.gap / consensus > 2) and not (g.gap > 30 and witnesses >= 2)""")
def ratio_anomaly(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_quantity").alias("gap"))
    return C.gap_anomaly(rows, ["l_returnflag"], "l_orderkey", "gap")


@query("AGG-32", """
with v as (select l_suppkey, l_extendedprice / 997 as v from lineitem),
e as (select l_suppkey, v, abs(v - round_even(v / 0.05::double, 0) * 0.05::double) * 1000 as dv from v where v > 0),
r as (select *, row_number() over (partition by l_suppkey order by dv) - 1 as rn, count(*) over (partition by l_suppkey) as n from e)
select l_suppkey, max(n) as n, round(max(case when rn = n // 2 then dv end), 2) as p50_mm, round(max(case when rn = least(floor(n * 0.9::double), n - 1) then dv end), 2) as p90_mm,
  round(100 * count(*) filter (where dv > 10) / max(n), 2) as over_10mm_pct, count(distinct round(v, 2)) as distinct_sizes from r group by 1""")
def module_compliance(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 997).alias("v"))
    return C.module_compliance(rows, ["l_suppkey"], "v")


@query("AGG-33", r"""
with t as (select p_brand, 'main 1:' || (p_size * 4) || ' detail 1 : ' || (p_partkey % 120) as text, case when p_type = 'PROMO' then 5 else 1 end as w from part),
f as (select p_brand, w, unnest(regexp_extract_all(text, '1\s*[:：]\s*(\d{1,4})', 1))::int as d from t),
s as (select unnest([5,10,15,20,25,30,40,50,75,100,150,200,250,300,400,500,1000,2000]) as s),
n as (select p_brand, w, d, (select struct_pack(e := abs(s - d)::double / s, s := s) from s order by abs(s - d)::double / s, s limit 1) as b from f where d between 5 and 2000),
v as (select p_brand, case when b.e <= 0.05::double then b.s else d end as denominator, b.e <= 0.05::double as is_standard, sum(w)::bigint as votes from n group by 1, 2, 3)
select *, round(votes / sum(votes) over (partition by p_brand), 3) as share from v""")
def ballot_scale(spark, d):
    text = F.concat(F.lit("main 1:"), F.col("p_size") * 4, F.lit(" detail 1 : "), F.col("p_partkey") % 120)
    rows = read_table(spark, d, "part").select("p_brand", "p_type", text.alias("text"))
    return C.scale_ballot(rows, ["p_brand"], "text", F.col("p_type") == "PROMO")


@query("AGG-34", """
with e as (select user_id, value as ax, json_extract(props, '$.k')::double as ay, event_id % 7 as noise from events),
p as (select user_id, ax, ay, 3 * ax - 2 * ay + 10 + noise * 0.01::double as bx, case when user_id % 2 = 0 then 2 * ax + 3 * ay - 5 else -(2 * ax + 3 * ay) end as "by" from e),
s as (select user_id, count(*) as pairs, avg(ax) as max_, avg(ay) as may, avg(bx) as mbx, avg("by") as mby, covar_pop(ax, bx) as xx, covar_pop(ay, "by") as yy, covar_pop(ax, "by") as xy, covar_pop(ay, bx) as yx,
   var_pop(ax) + var_pop(ay) as den, var_pop(bx) + var_pop("by") as vb from p group by 1),
f as (select *, sqrt((xx + yy) ** 2 + (xy - yx) ** 2) / den as s0, sqrt((xx - yy) ** 2 + (xy + yx) ** 2) / den as s1,
   sqrt(greatest(vb - ((xx + yy) ** 2 + (xy - yx) ** 2) / den, 0)) as r0, sqrt(greatest(vb - ((xx - yy) ** 2 + (xy + yx) ** 2) / den, 0)) as r1 from s where pairs >= 2 and den > 1e-15)
select user_id, pairs, r1 < r0 as mirror, round(case when r1 < r0 then s1 else s0 end, 6) as scale, round(case when r1 < r0 then r1 else r0 end, 4) as rmse,
  round(case when r1 < r0 then (degrees(atan2(xy + yx, xx - yy)) + 360) % 360 else (degrees(atan2(xy - yx, xx + yy)) + 360) % 360 end, 4) as rotation_deg from f""")
def similarity_fit(spark, d):
    ax, ay = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    rows = read_table(spark, d, "events").select(
        "user_id", ax.alias("ax"), ay.alias("ay"), (3 * ax - 2 * ay + 10 + (F.col("event_id") % 7) * 0.01).alias("bx"),
        F.when(F.col("user_id") % 2 == 0, 2 * ax + 3 * ay - 5).otherwise(-(2 * ax + 3 * ay)).alias("by"))
    out = C.fit_similarity(rows, ["user_id"], "ax", "ay", "bx", "by")
    return out.select("user_id", "pairs", "mirror", F.round("scale", 6).alias("scale"), F.round("rmse", 4).alias("rmse"),
                      F.round("rotation_deg", 4).alias("rotation_deg"))


@query("AGG-35", """
with e as (select user_id, json_extract(props, '$.k')::double as x, json_extract(props, '$.k')::double * 0.5::double + 2 + case when value > 40 then value else (event_id % 5) * 0.05::double end as y from events),
p as (select user_id, x, y, count(*) as w, row_number() over (partition by user_id order by x, y) as i from e group by 1, 2, 3),
l as (select p.user_id, p.i, q.i as j, (q.y - p.y) / (q.x - p.x) as a, p.y - (q.y - p.y) / (q.x - p.x) * p.x as b from p join p q on q.user_id = p.user_id and q.i > p.i and abs(q.x - p.x) >= 1e-6),
v as (select l.user_id, l.i, j, a, b, sum(w) as n from l join p on p.user_id = l.user_id and abs(y - (a * x + b)) <= 0.5 group by all),
c as (select * from v qualify row_number() over (partition by user_id order by n desc, i, j) = 1),
f as (select e.user_id, count(*) as inliers, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2 from e join c on c.user_id = e.user_id and abs(y - (a * x + b)) <= 0.5 group by 1)
select t.user_id, points, coalesce(inliers, 0) as inliers, round(case when inliers >= 4 then slope end, 6) as slope, round(case when inliers >= 4 then intercept end, 6) as intercept,
  round(case when inliers >= 4 then r2 else 0 end, 6) as r_squared, coalesce(inliers >= 4 and r2 >= 0.98, false) as ok
from (select user_id, count(*) as points from e group by 1) t left join f using (user_id)""")
def line_fit(spark, d):
    x = F.get_json_object("props", "$.k").cast("double")
    y = x * 0.5 + 2 + F.when(F.col("value") > 40, F.col("value")).otherwise((F.col("event_id") % 5) * 0.05)
    out = C.fit_line(read_table(spark, d, "events").select("user_id", x.alias("x"), y.alias("y")), ["user_id"], "x", "y")
    return out.select("user_id", "points", "inliers", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"),
                      F.round("r_squared", 6).alias("r_squared"), "ok")


@query("AGG-49", """
with c as (select case lang when 'en' then 'unit' when 'fr' then 'zone' else 'space' end as node_type, unnest(string_split(text, ' ')) as key, source, n_chars / (n_chars + 500.0::double) as confidence from documents),
n as (select node_type, key, round(max(confidence), 4) as confidence, count(distinct source) as sources, count(*) as evidence from c group by 1, 2),
t as (select key, count(*) as types, string_agg(node_type, ',' order by node_type) as rival from n group by 1)
select node_type, n.key, confidence, sources, evidence, case when confidence >= 0.88 and sources >= 2 and types = 1 then 'confirmed' else 'candidate' end as status,
  case when types > 1 then rival end as conflict from n join t on t.key = n.key""")
def candidate_resolution(spark, d):
    kind = F.when(F.col("lang") == "en", "unit").when(F.col("lang") == "fr", "zone").otherwise("space")
    rows = read_table(spark, d, "documents").select(
        kind.alias("node_type"), F.explode(F.split("text", " ")).alias("key"), "source", (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("confidence"))
    return C.resolve(rows).withColumn("conflict", F.array_join("conflict", ","))


@query("AGG-50", r"""
with s as (select regexp_extract(p_brand || '-' || p_size || '-' || p_partkey, '^(.+)[-_.\s][^-_.\s]+$', 1) as segment, p_type as role from part),
t as (select segment, role, count(*) as n from s group by 1, 2),
g as (select segment, sum(n)::bigint as samples, max(struct_pack(n := n, role := role)) as top from t group by 1)
select segment, top.role as role, samples, round(top.n / samples, 4) as purity from g where samples >= 3 and top.n / samples >= 0.6""")
def segment_rules(spark, d):
    rows = read_table(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_size", "p_partkey").alias("number"), F.col("p_type").alias("role"))
    return C.learn_segments(rows, "number", "role", 3, 0.6)


@query("AGG-51", r"""
with s as (select regexp_extract(p_name, '^(\w+) (\w+)$', 1) as prefix, regexp_extract(p_name, '^(\w+) (\w+)$', 2) as rest from part)
select prefix, count(distinct rest) as remainders from s where prefix <> '' group by 1 having count(distinct rest) >= 2""")
def prefix_discovery(spark, d):
    return C.discover_prefixes(read_table(spark, d, "part"), "p_name", r"^(\w+) (\w+)$")


@query("AGG-57", """
with v as (select l_suppkey % 20 as grp, l_orderkey, l_partkey, case when l_linenumber = 7 or l_suppkey % 20 = 3 and l_linenumber > 3 then -l_quantity else l_quantity end as v from lineitem),
s as (select grp, count(*) as n, count(*) filter (where v < 0) as neg, count(*) filter (where v > 0) as pos, avg(-v) filter (where v < 0) as rn, avg(v) filter (where v > 0) as rp from v group by 1),
k as (select v.*, case when n < 3 then 0 when neg >= 0.7 * n then -1 when pos >= 0.7 * n then 1 else 0 end as side, rn, rp from v join s using (grp)),
f as (select *, coalesce(side <> 0 and v * side < 0 and abs(abs(v) - case when side < 0 then rn else rp end) <= 0.25 * case when side < 0 then rn else rp end, false) as flipped from k)
select grp, flipped, count(*) as n, sum(case when flipped then -v else v end) as total from f group by 1, 2""")
def sign_repair(spark, d):
    minus = (F.col("l_linenumber") == 7) | ((F.col("l_suppkey") % 20 == 3) & (F.col("l_linenumber") > 3))
    rows = read_table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("grp"), F.when(minus, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("v"))
    return C.repair_sign(rows, ["grp"], "v").groupBy("grp", "flipped").agg(F.count("*").alias("n"), F.sum("repaired").alias("total"))


_VIEWS = """m as (select l_suppkey as key, l_linenumber as section, min(l_orderkey) as seq, max(l_quantity / 2) as top, min(l_quantity / 2) as low from lineitem where l_returnflag = 'A' group by 1, 2),
s as (select key, min(low) as lo, max(top) as hi from m group by 1),
h as (select l_suppkey as key, l_orderkey as view, l_quantity as head from lineitem where l_returnflag <> 'A'),
r as (select key, arg_min(struct_pack(s := section, t := top), struct_pack(q := seq, s := section)) as r from m group by 1),
o as (select m.key, section, top, abs(top - r.r.t) <= 0.6 as ok from m join r using (key) where section <> r.r.s),
c as (select h.key, head between lo - 0.6 and hi + 0.6 as ok from h join s using (key) union all select key, ok from o)"""


def _views(spark, d):
    line = read_table(spark, d, "lineitem")
    marks = line.where("l_returnflag = 'A'").select(
        F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("section"), F.col("l_orderkey").alias("seq"), (F.col("l_quantity") / 2).alias("elevation"))
    openings = line.where("l_returnflag <> 'A'").select(
        F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("view"), F.col("l_quantity").alias("head"))
    return marks, openings


@query("AGG-58", f"""
with {_VIEWS}
select key, count(*) as checked, count(*) filter (where ok) as passed, round(count(*) filter (where ok) / count(*), 4) as score from c group by 1""")
def view_consistency(spark, d):
    return C.view_check(*_views(spark, d), "key")[0]


@query("AGG-58", f"""
with {_VIEWS}
select h.key, 'section_elevation' as kind, view::varchar as item, head as value from h join s using (key) where not (head between lo - 0.6 and hi + 0.6)
union all select key, 'section_section', section::varchar, top from o where not ok""")
def view_conflicts(spark, d):
    return C.view_check(*_views(spark, d), "key")[1]


@query("AGG-59", """
with recursive s as (select l_suppkey as unit, 'S' || (l_linenumber * 3 - 8) as story_key, (l_linenumber * 3 - 8) as story_order, min(case when l_quantity < 45 and l_tax > 0.05::double then l_quantity + 3 * l_linenumber end) as drawn from lineitem group by 1, 2, 3),
o as (select s_suppkey as unit, 'S4' as story_key, s_acctbal / 200 as z from supplier where s_acctbal > 4000),
b as (select s.unit, s.story_key, s.story_order::int as story_order, round(coalesce(o.z, drawn, case when story_order >= 1 then (story_order - 1) * 4.5::double else story_order * 4.2::double end), 3) as z,
   case when o.z is not null then 'override' when drawn is not null then 'drawing' else 'default' end as src, row_number() over (partition by s.unit order by story_order, s.story_key) as rn from s left join o on o.unit = s.unit and o.story_key = s.story_key),
f as (select unit, story_key, story_order, z, src, false as warning, rn from b where rn = 1
  union all select b.unit, b.story_key, b.story_order, case when b.src <> 'override' and b.z - f.z < 2.8::double then round(f.z + 4.5::double, 3) else b.z end,
    case when b.src <> 'override' and b.z - f.z < 2.8::double then 'default' else b.src end, b.src <> 'override' and b.z - f.z < 2.8::double, b.rn from f join b on b.unit = f.unit and b.rn = f.rn + 1)
select unit, story_key, story_order, z as elevation, src as source, warning from f""")
def story_table(spark, d):
    order = F.col("l_linenumber") * 3 - 8
    drawn = F.when((F.col("l_quantity") < 45) & (F.col("l_tax") > 0.05), F.col("l_quantity") + 3 * F.col("l_linenumber"))
    rows = read_table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("unit"), F.concat(F.lit("S"), order).alias("story_key"), order.alias("story_order"), drawn.alias("elevation"))
    overrides = read_table(spark, d, "supplier").where("s_acctbal > 4000").select(
        F.col("s_suppkey").alias("unit"), F.lit("S4").alias("story_key"), (F.col("s_acctbal") / 200).alias("elevation"))
    return B.story_table(rows, overrides)
