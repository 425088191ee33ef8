"""Joins bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import projections as P
from ..operators import spatial as S
from ..operators.similarity import similar_join
from ..session import write_down
from ..sources.tables import read_table
from .catalog import query


@query("JOI-01", """
select p_brand, s_nationkey, count(*) as n, sum(l_quantity) as quantity
from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2""")
def dim_enrich(spark, d):
    fact = read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    dims = [(read_table(spark, d, "part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey"),
            (read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey")]
    return (J.enrich(fact, dims).groupBy("p_brand", "s_nationkey")
            .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))


@query("JOI-02", """
select c_custkey, c_name, o_orderkey from customer left join
  (select * from orders where o_totalprice > 400000) o on o_custkey = c_custkey""")
def left_enrich(spark, d):
    orders = read_table(spark, d, "orders").where("o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.left_enrich(read_table(spark, d, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("JOI-03", """
select c_custkey, c_name from customer where exists (
  select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_orderstatus <> 'F')""")
def semi_membership(spark, d):
    members = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("left_at"))
    return J.visible_to(read_table(spark, d, "customer"), members, "c_custkey", "o_orderpriority", "1-URGENT",
                        "left_at").select("c_custkey", "c_name")


@query("JOI-04", """
select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)""")
def anti_pending(spark, d):
    done = read_table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.pending(read_table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("JOI-05", """
select o_orderkey, strftime(l.l_shipdate, '%Y-%m-%d') as shipdate, l.l_partkey, coalesce(l.l_linenumber, 0) as l_linenumber
from orders left join lateral (select * from lineitem where l_orderkey = o_orderkey
  order by l_shipdate desc, l_linenumber desc, l_partkey desc limit 1) l on true""")
def latest_lateral(spark, d):
    right = read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber", "l_partkey")
    out = J.latest_per(read_table(spark, d, "orders").select("o_orderkey"), right, "o_orderkey",
                       [F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey")],
                       ["l_shipdate", "l_partkey", "l_linenumber"])
    return out.select("o_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"), "l_partkey",
                      F.coalesce("l_linenumber", F.lit(0)).alias("l_linenumber"))


@query("JOI-06", """
with st as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'closed' else 'acknowledged' end as status,
              o_orderpriority as note from orders where o_totalprice > 350000)
select l_orderkey, l_linenumber, l_partkey, note,
  coalesce(status, case l_returnflag when 'R' then 'closed' when 'A' then 'remediated' else 'pending' end) as status
from lineitem left join st on o_orderkey = l_orderkey""")
def overlay_join(spark, d):
    src = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    status = read_table(spark, d, "orders").where("o_totalprice > 350000").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "closed").otherwise("acknowledged").alias("status"),
        F.col("o_orderpriority").alias("note"))
    native = P.map_values(F.col("l_returnflag"), {"R": "closed", "A": "remediated"}, "pending")
    return J.overlay(src, status, ["l_orderkey"], native).drop("l_returnflag")


@query("JOI-07", """
select o_orderstatus, count(*) as n, sum(l_linenumber)::bigint as lines from orders join lineitem
on o_orderkey::varchar = l_orderkey::varchar group by 1""")
def cross_type_key_join(spark, d):
    lines = read_table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_key"), "l_linenumber")
    return (J.join_text(read_table(spark, d, "orders"), lines, "o_orderkey", "l_key").groupBy("o_orderstatus")
            .agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")))


@query("JOI-08", """
with refs as (select p_partkey, lower(p_brand) || ' - ' || (2000 + p_size % 25) as std_no,
    upper(replace(p_brand || '-' || (2000 + p_size % 25), ' ', '')) as fk, upper(p_brand) as bk from part),
lib as (select s_suppkey as book_id, 'Brand#' || s_suppkey || '-' || (2000 + s_nationkey) as lib_std_no,
    upper('Brand#' || s_suppkey || '-' || (2000 + s_nationkey)) as fk, 'BRAND#' || s_suppkey as bk from supplier)
select r.p_partkey, r.std_no,
  case when f.book_id is not null then 'matched' when b.book_id is not null then 'version_mismatch' else 'missing' end as state,
  coalesce(f.lib_std_no, b.lib_std_no) as lib_std_no
from refs r left join lib f on f.fk = r.fk left join lib b on b.bk = r.bk""")
def two_step_match(spark, d):
    year = (F.lit(2000) + F.col("p_size") % 25).cast("string")
    refs = read_table(spark, d, "part").select(
        "p_partkey", F.concat(F.lower("p_brand"), F.lit(" - "), year).alias("std_no"))
    lib = read_table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("book_id"),
        F.concat(F.lit("Brand#"), F.col("s_suppkey"), F.lit("-"), F.lit(2000) + F.col("s_nationkey")).alias("lib_std_no"))
    return J.match_library(refs, lib).drop("book_id")


@query("JOI-09", """
with e as (select o_custkey as k, count(*) as expected from orders where o_orderstatus = 'F' group by 1),
a as (select o_custkey as k, count(*) as actual from orders where o_totalprice > 400000 group by 1)
select coalesce(e.k, a.k) as o_custkey, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual,
  coalesce(expected, 0) - coalesce(actual, 0) as diff from e full join a on e.k = a.k""")
def reconcile_outer(spark, d):
    orders = read_table(spark, d, "orders")
    expected = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("expected"))
    actual = orders.where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("actual"))
    return J.reconcile(actual, expected, "o_custkey")


@query("JOI-10", """
with orgs as (select n_nationkey as org_id, n_name as name, n_regionkey as parent_id from nation)
select o.org_id, o.name, p.name as parent_name,
  (select count(distinct c_custkey) from customer where c_nationkey = o.org_id) as user_count,
  (select count(distinct s_suppkey) from supplier where s_nationkey = o.org_id) as project_count
from orgs o left join orgs p on p.org_id = o.parent_id""")
def self_hierarchy(spark, d):
    orgs = read_table(spark, d, "nation").select(
        F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"))
    users = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"))
    projects = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("org_id"), F.col("s_suppkey").alias("project_id"))
    return J.with_parent(orgs, users, projects)


@query("JOI-11", """
select event_id, user_id, event_type from events where user_id in (
  select o_custkey from orders where o_totalprice > 480000 union select c_custkey from customer where c_acctbal > 9000)""")
def in_union_subquery(spark, d):
    a = read_table(spark, d, "orders").where("o_totalprice > 480000").select("o_custkey")
    b = read_table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey")
    return J.activity(read_table(spark, d, "events"), "user_id", a, b).select("event_id", "user_id", "event_type")


@query("JOI-12", """
with marks as (select user_id, max(ts) as built_at from events where event_type = 'purchase' and value > 40 group by 1)
select e.event_id, e.user_id from events e left join marks m on m.user_id = e.user_id
where m.built_at is null or e.ts > m.built_at""")
def since_join(spark, d):
    events = read_table(spark, d, "events")
    marks = (events.where("event_type = 'purchase' and value > 40").groupBy("user_id").agg(F.max("ts").alias("built_at")))
    return J.changed_since(events, marks, "user_id", "ts", "built_at").select("event_id", "user_id")


@query("JOI-13", """
with p as (select o_orderkey, o_totalprice / 50 as pos from orders),
r as (select s_acctbal as pos, min(s_suppkey) as s_suppkey from supplier group by 1),
best as (select o_orderkey, p.pos as pos, (select struct_pack(g := abs(r.pos - p.pos), q := r.pos, s := r.s_suppkey)
           from r order by abs(r.pos - p.pos), r.pos limit 1) as b from p)
select o_orderkey, case when b.g <= 150 then b.s end as s_suppkey, case when b.g <= 150 then round(b.g, 6) end as gap from best""")
def nearest_tolerance(spark, d):
    points = read_table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 50).alias("pos"))
    refs = read_table(spark, d, "supplier").select(F.col("s_acctbal").alias("pos"), "s_suppkey")
    return (S.nearest_1d(points, refs, [], "pos", "s_suppkey", 150.0)
            .select("o_orderkey", "s_suppkey", F.round("gap", 6).alias("gap")))


@query("JOI-13", """
with p as (select o_orderkey, o_totalprice / 1000 as x, o_custkey / 3.0::double as y from orders),
r as (select p_retailprice % 500 as x, (p_partkey * 7) % 500 as y, p_partkey from part),
h as (select o_orderkey, min(struct_pack(d := sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2), k := p_partkey)) as b
      from p join r on abs(p.x - r.x) < 20 and abs(p.y - r.y) < 20
      where sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2) < 20 group by 1)
select p.o_orderkey, b.k as p_partkey, round(b.d, 6) as gap from p left join h using (o_orderkey)""")
def nearest_in_plane(spark, d):
    points = read_table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") / 3.0).alias("y"))
    refs = read_table(spark, d, "part").select(
        (F.col("p_retailprice") % 500).alias("x"), ((F.col("p_partkey") * 7) % 500).cast("double").alias("y"), "p_partkey")
    return (S.nearest_2d(points, refs, "o_orderkey", "p_partkey", 20.0)
            .select("o_orderkey", "p_partkey", F.round("gap", 6).alias("gap")))


@query("JOI-13", """
with p as (select c_custkey, c_acctbal as x, c_nationkey * 10 as y from customer),
rx as (select s_acctbal as pos, min(s_suppkey) as lab from supplier group by 1),
ry as (select n_nationkey * 20 as pos, 'N' || n_nationkey as lab from nation),
bx as (select c_custkey, (select struct_pack(g := abs(pos - x), l := lab) from rx order by abs(pos - x), pos limit 1) as b from p),
byy as (select c_custkey, (select struct_pack(g := abs(pos - y), l := lab) from ry order by abs(pos - y), pos limit 1) as b from p),
j as (select c_custkey, case when bx.b.g <= 30 then 'S' || bx.b.l end as xl, case when byy.b.g <= 5 then byy.b.l end as yl
      from bx join byy using (c_custkey))
select c_custkey, case when xl is not null or yl is not null then coalesce(xl, '?') || '-' || coalesce(yl, '?') end as grid_cell from j""")
def grid_cell(spark, d):
    points = read_table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("pos"), (F.col("c_nationkey") * 10.0).alias("y"))
    xs = read_table(spark, d, "supplier").select(F.col("s_acctbal").alias("pos"), "s_suppkey")
    ys = read_table(spark, d, "nation").select((F.col("n_nationkey") * 20.0).alias("pos"),
                                               F.concat(F.lit("N"), F.col("n_nationkey")).alias("label"))
    on_x = S.nearest_1d(points, xs, [], "pos", "s_suppkey", 30.0).drop("gap", "pos").withColumnRenamed("y", "pos")
    both = S.nearest_1d(on_x, ys, [], "pos", "label", 5.0)
    return both.select("c_custkey", S.grid_cell(F.concat(F.lit("S"), F.col("s_suppkey")), F.col("label")).alias("grid_cell"))


_POINTS = "p as (select o_orderkey, o_custkey // 10 as sheet, o_totalprice / 1000 as x, (o_custkey % 100)::double as y from orders)"
_RECTS = """r as (select p_partkey, p_partkey // 13 as sheet, p_retailprice % 450 as x0, (p_partkey * 13 % 90)::double as y0,
  p_retailprice % 450 + 1 + p_size as x1, (p_partkey * 13 % 90 + 0.5 + p_size % 8)::double as y1 from part)"""


def _points(spark, d):
    return read_table(spark, d, "orders").select(
        "o_orderkey", F.floor(F.col("o_custkey") / 10).alias("sheet"), (F.col("o_totalprice") / 1000).alias("x"),
        (F.col("o_custkey") % 100).cast("double").alias("y"))


def _rects(spark, d):
    x0, y0 = F.col("p_retailprice") % 450, (F.col("p_partkey") * 13) % 90
    return read_table(spark, d, "part").select(
        "p_partkey", F.floor(F.col("p_partkey") / 13).alias("sheet"), x0.alias("x0"), y0.cast("double").alias("y0"), (x0 + 1 + F.col("p_size")).alias("x1"),
        (y0 + 0.5 + F.col("p_size") % 8).alias("y1"))


@query("JOI-14", f"""
with {_POINTS}, {_RECTS},
h as (select o_orderkey, min(struct_pack(a := (x1 - x0) * (y1 - y0), k := p_partkey)) as b
      from p join r on p.sheet = r.sheet and x between x0 and x1 and y between y0 and y1 where x1 - x0 >= 3 and y1 - y0 >= 1 group by 1)
select p.o_orderkey, b.k as p_partkey, round(b.a, 6) as area from p left join h using (o_orderkey)""")
def containment_join(spark, d):
    wide = _rects(spark, d).where("x1 - x0 >= 3")
    return (S.enclosing(_points(spark, d), wide, "o_orderkey", "p_partkey", 1.0, ["sheet"])
            .select("o_orderkey", "p_partkey", F.round("area", 6).alias("area")))


@query("JOI-14", f"""
with {_POINTS}, w as (select p_partkey, p_partkey // 13 as sheet, p_retailprice % 450 as ax, (p_partkey * 13 % 90)::double as ay,
    p_retailprice % 450 + p_size as bx, (p_partkey * 13 % 90 + p_size % 5)::double as "by", (p_size % 3)::double as width from part),
c as (select o_orderkey, p_partkey, x, y, ax, ay, bx, "by", width,
        ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) ** 2 + ("by" - ay) ** 2) as t
      from p join w on p.sheet = w.sheet and x between least(ax, bx) - 4 and greatest(ax, bx) + 4 and y between least(ay, "by") - 4 and greatest(ay, "by") + 4),
dd as (select *, sqrt((x - ax - least(greatest(t, 0), 1) * (bx - ax)) ** 2 + (y - ay - least(greatest(t, 0), 1) * ("by" - ay)) ** 2) as dist from c),
h as (select o_orderkey, min(struct_pack(d := dist, k := p_partkey)) as b, count(*) as n from dd
      where dist <= width / 2 + 0.3::double and t between -0.05::double and 1.05::double group by 1)
select p.o_orderkey, b.k as p_partkey, case when n is null then 0.2::double when n = 1 then 0.95::double else 0.7::double end as confidence,
  n is null as orphan from p left join h using (o_orderkey)""")
def opening_host(spark, d):
    x0, y0 = F.col("p_retailprice") % 450, (F.col("p_partkey") * 13) % 90
    walls = read_table(spark, d, "part").select(
        "p_partkey", F.floor(F.col("p_partkey") / 13).alias("sheet"), x0.alias("ax"), y0.cast("double").alias("ay"), (x0 + F.col("p_size")).alias("bx"),
        (y0 + F.col("p_size") % 5).cast("double").alias("by"), (F.col("p_size") % 3).cast("double").alias("width"))
    return S.opening_hosts(_points(spark, d), walls, "o_orderkey", "p_partkey", ["sheet"]).drop("x", "y", "sheet")


@query("JOI-15", f"""
with {_POINTS}, {_RECTS},
g as (select *, 0.15::double + 0.5::double * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as m from r),
c as (select o_orderkey, struct_pack(d := sqrt((x - (x0 + x1) / 2) ** 2 + (y - (y0 + y1) / 2) ** 2), k := p_partkey,
        i := x between x0 and x1 and y between y0 and y1) as s
      from p join g on p.sheet = g.sheet and x between x0 - m and x1 + m and y between y0 - m and y1 + m)
select o_orderkey, b.k as p_partkey, case when b.i then 0.9::double else 0.7::double end as confidence
from (select o_orderkey, min(s) as b from c group by 1)""")
def box_support(spark, d):
    return S.supports(_points(spark, d), _rects(spark, d), ["o_orderkey"], "p_partkey", ["sheet"])


@query("JOI-15", """
with b as (select p_partkey, p_partkey // 13 as sheet, p_retailprice % 450 as ax, (p_partkey * 13 % 90)::double as ay, p_retailprice % 450 + p_size as bx, (p_partkey * 13 % 90 + p_size % 3)::double as "by" from part),
e as (select c_custkey, c_custkey // 10 as sheet, c_acctbal / 25 as ax, (c_custkey % 90)::double as ay, c_acctbal / 25 + 60 as bx, (c_custkey % 90 + c_nationkey % 4)::double as "by" from customer),
j as (select c_custkey, p_partkey, (b.ax + b.bx) / 2 as mx, (b.ay + b."by") / 2 as my, b.bx - b.ax as vx, b."by" - b.ay as vy, e.ax, e.ay, e.bx - e.ax as wx, e."by" - e.ay as wy from b join e on b.sheet = e.sheet),
t as (select *, ((mx - ax) * wx + (my - ay) * wy) / (wx * wx + wy * wy) as t, abs(vx * wy - vy * wx) / (sqrt(vx * vx + vy * vy) * sqrt(wx * wx + wy * wy)) as sine from j)
select distinct c_custkey, p_partkey from t where sine <= 0.2 and t between -0.05 and 1.05 and sqrt((mx - ax - least(greatest(t, 0), 1) * wx) ** 2 + (my - ay - least(greatest(t, 0), 1) * wy) ** 2) <= 0.3""")
def slab_support(spark, d):
    x0, y0 = F.col("p_retailprice") % 450, (F.col("p_partkey") * 13) % 90
    beams = read_table(spark, d, "part").select(
        "p_partkey", F.floor(F.col("p_partkey") / 13).alias("sheet"), x0.alias("ax"), y0.cast("double").alias("ay"), (x0 + F.col("p_size")).alias("bx"),
        (y0 + F.col("p_size") % 3).cast("double").alias("by"))
    bal, k = F.col("c_acctbal") / 25, F.col("c_custkey") % 90
    edges = read_table(spark, d, "customer").select(
        "c_custkey", F.floor(F.col("c_custkey") / 10).alias("sheet"), bal.alias("ax"), k.cast("double").alias("ay"), (bal + 60).alias("bx"), (k + F.col("c_nationkey") % 4).cast("double").alias("by"))
    return S.slab_supports(edges, beams, "c_custkey", "p_partkey", ["sheet"])


@query("JOI-15")
def level_pairs(spark, d):
    side = lambda kind, name: (read_table(spark, d, "events").where(f"event_type = '{kind}'").select(
        "user_id", F.col("event_id").alias(name), (F.col("value") * 4).alias("x0"), (F.col("value") * 4 + 20).alias("x1"),
        F.get_json_object("props", "$.k").cast("double").alias("y")))
    return S.row_pairs(side("click", "name_id"), side("view", "value_id"), ["user_id"])


@query("JOI-16")
def iou_pairing(spark, d):
    a = read_table(spark, d, "part").select(
        "p_partkey", (F.col("p_partkey") % 97 * 3.0).alias("x0"), (F.col("p_size") * 2.0).alias("y0"),
        (F.col("p_partkey") % 97 * 3.0 + 4 + F.col("p_partkey") % 3).alias("x1"), (F.col("p_size") * 2.0 + 5).alias("y1"))
    b = read_table(spark, d, "customer").select(
        "c_custkey", (F.col("c_custkey") % 101 * 3.0 + 0.5).alias("x0"), (F.col("c_nationkey") * 4.0).alias("y0"),
        (F.col("c_custkey") % 101 * 3.0 + 4.5 + F.col("c_custkey") % 4).alias("x1"), (F.col("c_nationkey") * 4.0 + 5).alias("y1"))
    return S.pair_boxes(a, b, "p_partkey", "c_custkey", 0.3)


@query("JOI-17")
def fuzzy_text_join(spark, d):
    lines = (read_table(spark, d, "documents")
             .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
             .select(F.concat_ws(":", "doc_id", "line").alias("id"), F.lit(None).cast("string").alias("ref"), "text"))
    items = (read_table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
             .select(F.concat_ws(":", "item_id", "line").alias("id"), F.lit(None).cast("string").alias("ref"), "text"))
    return similar_join(lines, items, 0.8)


@query("JOI-18", """
with t as (select p_partkey as id, p_brand || ' - ' || p_name as title, lower(replace(replace(p_brand || p_name, ' ', ''), '-', '')) as nt from part),
e as (select distinct p_name as entry, lower(replace(p_name, ' ', '')) as k from part
      union select distinct p_brand || ' ' || p_name, lower(replace(p_brand || p_name, ' ', '')) from part
      union select distinct p_type, lower(p_type) from part),
x as (select k, min(id) as id from e join t on nt = k group by 1),
s as (select k, min(struct_pack(n := length(title), t := title, i := id)) as b from e join t on ends_with(nt, k) group by 1)
select entry, coalesce(x.id, s.b.i) as id, case when x.id is not null then 'exact' when s.b is not null then 'suffix' end as how
from e left join x using (k) left join s using (k)""")
def suffix_match(spark, d):
    from ..functions.strings import norm_title

    part = read_table(spark, d, "part")
    titles = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" - ", "p_brand", "p_name").alias("title"))
    entries = (part.select(F.col("p_name").alias("entry")).union(part.select(F.concat_ws(" ", "p_brand", "p_name")))
               .union(part.select("p_type")))
    return J.match_entries(entries, titles, norm_title)


@query("JOI-19", """
with t as (select user_id, event_id, event_type as text, epoch(ts) % 86400 / 100 as x, value as y from events),
l as (select user_id, arg_min(struct_pack(x := x, y := y), event_id) as l from t where text = 'signup' group by 1)
select t.user_id, arg_min(event_id || ':' || text, struct_pack(x := t.x, e := event_id)) as value
from t join l using (user_id) where text not in ('signup', 'error') and t.x > l.l.x and abs(t.y - l.l.y) <= 6 group by 1""")
def right_neighbour(spark, d):
    # centres and height as they are: half of (value - 2.5) + (value + 2.5) is not always the value again, which moves rows that lie exactly 6 apart
    tokens = read_table(spark, d, "events").where("user_id is not null").select(
        "user_id", F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
        .otherwise(F.concat("event_id", F.lit(":"), "event_type")).alias("text"),
        (F.unix_micros("ts") / 1e6 % 86400 / 100).alias("x"), F.col("value").alias("y"), F.lit(5.0).alias("h"))
    return J.field_value_at(tokens, ["user_id"], "signup", ["error"])


@query("JOI-20", """
with t as (select distinct p_name || ' ' || p_partkey as title, case when p_size % 10 = 1 then 'PROMO' when p_size % 10 <> 0 then p_type || ' ' || p_partkey end as unit from part),
a as (select distinct split_part(p_name, ' ', 1) as alias from part union select distinct right(p_name, 3) from part
      union select distinct p_name || ' ' || p_partkey from part),
v as (select distinct alias, unit from a join t on contains(title, alias) where unit is not null and unit <> 'PROMO'),
o as (select alias, min(unit) as unit from v group by 1 having count(distinct unit) = 1)
select alias, unit from o where unit in (select unit from o group by 1 having count(*) = 1)""")
def contains_learn(spark, d):
    part = read_table(spark, d, "part")
    title = F.concat_ws(" ", "p_name", "p_partkey")
    titled = part.select(title.alias("title"), F.when(F.col("p_size") % 10 == 1, "PROMO").when(F.col("p_size") % 10 != 0, F.concat_ws(" ", "p_type", "p_partkey")).alias("unit"))
    aliases = (part.select(F.split("p_name", " ")[0].alias("alias")).union(part.select(F.expr("right(p_name, 3)")))
               .union(part.select(title)))
    return J.learn_aliases(aliases, titled, ["PROMO"])


@query("JOI-21", """
with c as (select item_id, case when item_id % 5 = 0 then 'general' when item_id % 5 = 1 then 'en' when item_id % 5 = 2 then 'fr' else 'es' end as cd,
             item_id % 7 = 0 as mandatory from benchmark)
select doc_id, count(*) as n_clauses, count(*) filter (where mandatory) as n_mandatory, sum(item_id)::bigint as item_sum
from documents join c on cd = lang or cd = 'general' or mandatory group by 1""")
def rules_cross(spark, d):
    k = F.col("item_id") % 5
    clauses = read_table(spark, d, "benchmark").select(
        "item_id", F.when(k == 0, "general").when(k == 1, "en").when(k == 2, "fr").otherwise("es").alias("clause_discipline"),
        (F.col("item_id") % 7 == 0).alias("mandatory"))
    docs = read_table(spark, d, "documents").select("doc_id", F.col("lang").alias("discipline"))
    return J.screen(docs, clauses).groupBy("doc_id").agg(
        F.count("*").alias("n_clauses"), F.count_if("mandatory").alias("n_mandatory"), F.sum("item_id").alias("item_sum"))


@query("JOI-22", """
with i as (select distinct l_orderkey, 'D' || (l_suppkey % 9) as item, l_orderkey % 40 as project from lineitem)
select a.item as item_a, b.item as item_b, count(distinct a.l_orderkey) as n_groups, count(distinct a.project) as n_projects
from i a join i b on a.l_orderkey = b.l_orderkey and a.item < b.item group by 1, 2""")
def pair_cooccur(spark, d):
    rows = read_table(spark, d, "lineitem").select(
        "l_orderkey", F.concat(F.lit("D"), F.col("l_suppkey") % 9).alias("item"), (F.col("l_orderkey") % 40).alias("project"))
    return J.cooccur(rows, "l_orderkey", "item", "project")


@query("JOI-23", """
with a as (select user_id, json_extract(props, '$.k')::bigint as label, avg(value) as pos from events group by 1, 2),
g as (select json_extract(props, '$.k')::bigint as label, median(value) as gpos from events group by 1),
s as (select user_id, gpos - pos as diff from a join g using (label)),
o as (select user_id, median(diff) as o, count(*) as n from s group by 1)
select user_id, round(o, 6) as "offset", n as shared, round(median(abs(o - diff)), 6) as residual from s join o using (user_id) group by 1, 2, 3""")
def label_align_join(spark, d):
    from ..operators.quantiles import median_by

    rows = read_table(spark, d, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("label"), "value")
    a = rows.groupBy("user_id", "label").agg(F.avg("value").alias("pos"))
    b = median_by(rows, ["label"], "value", "gpos")
    return J.align(a, b, "user_id", "label", "pos", "gpos").select(
        "user_id", F.round("offset", 6).alias("offset"), "shared", F.round("residual", 6).alias("residual"))


def _quantities(spark, d):
    """Quantities of every order's lines in their order, written down: the lines are shuffled once, as plain rows, however often a query asks."""
    lines = read_table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_quantity").repartition("l_orderkey")
    return write_down(lines.groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity"))), lambda s: s["l_quantity"]).alias("gaps")))


@query("JOI-24")
def gap_sequence_match(spark, d):
    lines = _quantities(spark, d)
    anchors = lines.select(F.col("l_orderkey").alias("anchor_id"), "gaps")
    merged = F.array_compact(F.concat(F.array(F.get("gaps", F.lit(1)) + F.get("gaps", F.lit(2))), F.slice("gaps", 4, F.size("gaps"))))
    targets = lines.select(F.col("l_orderkey").alias("target_id"), merged.alias("gaps"))
    return J.match_gaps(targets, anchors)


@query("JOI-24")
def zone_propagation(spark, d):
    """Zone labels of customers' longest-known sheets for orders whose gaps lie on one of them only, with scale and review mark."""
    lines = _quantities(spark, d)
    anchors = lines.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("drawing_id"), F.lit(0).alias("zone_index"), F.lit("x").alias("direction"),
                                                       F.concat(F.lit("Z"), F.col("l_orderkey") % 7).alias("zone_label"), "gaps")
    scaled = F.transform("gaps", lambda g: g * (1 + (F.col("l_orderkey") % 3) * 0.006))
    candidates = lines.select((-F.col("l_orderkey")).alias("drawing_id"), F.lit(0).alias("zone_index"), scaled.alias("gaps"))
    return J.propagate_zones(candidates, anchors)
