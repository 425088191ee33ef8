"""Retrieval, graph and evaluation operators bound to the driver's tables."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from ..operators import compliance as K
from ..operators import evaluation as V
from ..operators import fusion as U
from ..operators import retrieval as R
from ..operators.spatial import pair_boxes
from ..sources.tables import read_table
from .catalog import query


@query("RET-01", """
with e as (select vec_id, label, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, b.vec_id as match_id, q.label, round(list_cosine_similarity(q.e, b.e), 6) as score, list_cosine_similarity(q.e, b.e) as raw from e q join e b on q.label = b.label and q.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by round(raw, 12) desc, match_id) as rank from s)
select query_id, match_id, label, score, rank::int as rank from r where rank <= 5""")
def vector_topk(spark, d):
    vecs = read_table(spark, d, "embeddings")
    return R.topk_cosine(vecs, vecs, "vec_id", "embedding", "label", 5, skip_self=True).withColumn("score", F.round("score", 6))


_RECALL = """k as (select o_custkey, case when o_totalprice > 60000 then 'R' || o_orderkey % 40 else '' end as ref, o_orderpriority as snippet, case o_orderstatus when 'F' then 'info' when 'O' then 'minor' else 'critical' end as severity from orders),
r as (select o_custkey, 'R' || l_partkey % 40 as ref, l_returnflag as snippet, 'info' as severity from lineitem join orders on o_orderkey = l_orderkey)"""


@query("RET-02", f"""
with {_RECALL},
a as (select *, 'kg' as s, 0 as o from k union all select *, 'rag', 1 from r),
m as (select o_custkey, case when ref <> '' then 'r:' || ref else 't:' || snippet end as key, min(struct_pack(o := o, snippet := snippet, severity := severity, ref := ref)) as f, string_agg(distinct s, '+' order by s) as sources, count(distinct s) as n from a group by 1, 2)
select o_custkey, f.ref as ref, f.snippet as snippet, case when n = 2 then case f.severity when 'info' then 'minor' when 'minor' then 'major' else f.severity end else f.severity end as severity, sources from m""")
def hybrid_fusion(spark, d):
    orders = read_table(spark, d, "orders")
    kg = orders.select("o_custkey", F.when(F.col("o_totalprice") > 60000, F.concat(F.lit("R"), F.col("o_orderkey") % 40)).otherwise("").alias("ref"),
                       F.col("o_orderpriority").alias("snippet"), F.when(F.col("o_orderstatus") == "F", "info").when(F.col("o_orderstatus") == "O", "minor").otherwise("critical").alias("severity"))
    rag = read_table(spark, d, "lineitem").join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(
        "o_custkey", F.concat(F.lit("R"), F.col("l_partkey") % 40).alias("ref"), F.col("l_returnflag").alias("snippet"), F.lit("info").alias("severity"))
    return R.fuse_candidates(kg, rag, ["o_custkey"])


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_NOTES = (*_PRIORITIES, *(f"{p} {f}" for p in _PRIORITIES for f in "ANR"))


def _alike_values(left, right) -> str:
    """Pairs of the tables' few texts that are alike, for the SQL form: SQL has no such ratio."""
    return ", ".join(f"('{a}', '{b}')" for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= U.SIMILAR_TEXT)


@query("RET-02", f"""
with recursive s(later, earlier) as (values {_alike_values(_NOTES, _NOTES)}),
a as (select later, list(earlier) as alike from s group by 1),
k as (select distinct o_custkey, 0 as o, o_orderkey as id, 0 as n, 0 as part, case when o_totalprice > 60000 then 'R' || o_orderkey % 40 else '' end as ref, o_orderpriority as snippet,
  case o_orderstatus when 'F' then 'info' when 'O' then 'minor' else 'critical' end as severity, 'kg' as source from orders),
r as (select distinct o_custkey, 1, l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then 'R' || l_partkey % 40 else '' end, o_orderpriority || ' ' || l_returnflag, 'info', 'rag' from lineitem join orders on o_orderkey = l_orderkey),
c as (select u.*, alike, row_number() over (partition by o_custkey order by o, id, n, part, snippet) as turn from (from k union all from r) u join a on later = snippet),
g as (select o_custkey, 0::bigint as turn, []::struct(turn bigint, ref varchar, snippet varchar, severity varchar, sources varchar[])[] as held from c group by 1
  union all select o_custkey, turn, case when hit > 0 then list_transform(held, lambda x, i: case when i = hit and not list_contains(x.sources, source)
      then struct_pack(turn := x.turn, ref := x.ref, snippet := x.snippet, severity := x.severity, sources := list_append(x.sources, source)) else x end)
    else list_append(held, struct_pack(turn := turn, ref := ref, snippet := snippet, severity := severity, sources := [source])) end
  from (select c.*, held, list_position(list_transform(held, lambda x: (c.ref <> '' and x.ref = c.ref) or list_contains(c.alike, x.snippet)), true) as hit from g join c on c.o_custkey = g.o_custkey and c.turn = g.turn + 1)),
f as (select o_custkey, unnest(max_by(held, turn)[:20]) as x from g group by 1)
select o_custkey, x.ref as ref, x.snippet as snippet, case when len(x.sources) = 2 then case x.severity when 'info' then 'minor' when 'minor' then 'major' else x.severity end else x.severity end as severity,
  array_to_string(x.sources, '+') as sources from f""")
def merged_candidates(spark, d):
    """Recalls of all customers, merged in their order by reference or by similar text."""
    orders = read_table(spark, d, "orders")
    kg = orders.select("o_custkey", F.lit(0).alias("o"), F.col("o_orderkey").alias("id"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("part"),
                       F.when(F.col("o_totalprice") > 60000, F.concat(F.lit("R"), F.col("o_orderkey") % 40)).otherwise("").alias("ref"), F.col("o_orderpriority").alias("snippet"),
                       F.when(F.col("o_orderstatus") == "F", "info").when(F.col("o_orderstatus") == "O", "minor").otherwise("critical").alias("severity"), F.lit("kg").alias("source"))
    lines = read_table(spark, d, "lineitem").join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    rag = lines.select("o_custkey", F.lit(1).alias("o"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("long").alias("part"),
                       F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("R"), F.col("l_partkey") % 40)).otherwise("").alias("ref"),
                       F.concat_ws(" ", "o_orderpriority", "l_returnflag").alias("snippet"), F.lit("info").alias("severity"), F.lit("rag").alias("source"))
    rows = kg.unionByName(rag).withColumn("at", F.struct("o", "id", "n", "part", "snippet"))  # equal rows fold where candidates do
    return U.merge_candidates(rows, ["o_custkey"], "at").drop("at")


@query("RET-03", """
select r_name as discipline, n_name as standard, s_suppkey from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey and s_acctbal > 4000""")
def graph_pattern(spark, d):
    requires = (read_table(spark, d, "nation").join(read_table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
                .select(F.col("r_name").alias("discipline"), F.col("n_nationkey").alias("standard"), "n_name"))
    clauses = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("standard"), "s_suppkey", "s_acctbal")
    return R.match_path(requires, clauses, F.col("s_acctbal") > 4000).select("discipline", F.col("n_name").alias("standard"), "s_suppkey")


def _tree(spark, d):
    regions = read_table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    nations = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"))
    suppliers = read_table(spark, d, "supplier").select((F.col("s_suppkey") + 5000).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("parent_id"))
    nodes = regions.union(nations).union(suppliers).withColumn("status", F.lit("candidate"))
    s = read_table(spark, d, "supplier")
    at = (F.col("s_suppkey") + 5000).alias("id")
    ops = (s.where("s_acctbal < 1000").select(at, F.lit("reject").alias("kind"), F.lit("").alias("value"), F.lit(1).alias("seq"))
           .union(s.where("s_acctbal > 7000").select(at, F.lit("rename"), F.concat(F.lit("Renamed "), F.col("s_nationkey")), F.lit(2)))
           .union(s.where("s_acctbal > 8000").select(at, F.lit("reparent"), ((F.col("s_nationkey") + 1) % 25).cast("string"), F.lit(3)))
           .union(s.where("s_acctbal < 500").select(at, F.lit("confirm"), F.lit(""), F.lit(4))))
    return R.tree(nodes, ops)


@query("RET-04", """
with n as (select r_regionkey + 1000 as id, r_name as name, null::bigint as parent_id, null::double as bal, null::bigint as nk from region union all select n_nationkey, n_name, n_regionkey + 1000, null, null from nation
  union all select s_suppkey + 5000, s_name, s_nationkey, s_acctbal, s_nationkey from supplier),
t as (select id::bigint as id, case when bal > 7000 then 'Renamed ' || nk else name end as name, case when bal > 8000 then (nk + 1) % 25 else parent_id end::bigint as parent_id,
  case when bal < 500 then 'confirmed' when bal < 1000 then 'rejected' when bal > 7000 then 'confirmed' else 'candidate' end as status,
  1 + coalesce((bal < 1000)::int + (bal > 7000)::int + (bal > 8000)::int + (bal < 500)::int, 0) as version from n)
select id, name, parent_id, status, version::bigint as version from t""")
def semantic_tree(spark, d):
    return _tree(spark, d).select("id", "name", "parent_id", "status", F.col("version").cast("long").alias("version"))


@query("RET-04", """
with n as (select r_regionkey + 1000 as id, r_name as name, null::bigint as p, null::double as bal, null::bigint as nk from region union all select n_nationkey, n_name, n_regionkey + 1000, null, null from nation
  union all select s_suppkey + 5000, s_name, s_nationkey, s_acctbal, s_nationkey from supplier),
t as (select id, case when bal > 7000 then 'Renamed ' || nk else name end as name, case when bal > 8000 then (nk + 1) % 25 else p end as p from n where coalesce(bal, 2000) >= 1000 or bal < 500)
select a.id::bigint as id, case when a.p is null then a.name when b.p is null then b.name || '/' || a.name else c.name || '/' || b.name || '/' || a.name end as path, (case when a.p is null then 1 when b.p is null then 2 else 3 end)::int as depth
from t a left join t b on b.id = a.p left join t c on c.id = b.p""")
def semantic_paths(spark, d):
    return R.tree_paths(spark, _tree(spark, d))


@query("RET-05")
def connected_zones(spark, d):
    """Orders that parts connect: every line joins its order to its part.  SQL's recursion over whole tables is too slow; the tests compare with union-find."""
    edges = read_table(spark, d, "lineitem").select("l_orderkey", (-F.col("l_partkey") - 1).alias("part_node"))
    return R.components(edges, "l_orderkey", "part_node")


@query("RET-06", """
with n as (select o_orderkey as id from orders), e as (select case when l_quantity > 40 then l_orderkey else -l_linenumber end as src, case when l_quantity > 40 then l_orderkey + l_linenumber else -l_linenumber - 1 end as dst from lineitem),
i as (select id from n where id not in (select src from e) and id not in (select dst from e))
select (select count(*) from n) as nodes, (select count(*) from i) as isolated, round((select count(*) from i) / (select count(*) from n), 4) as isolated_ratio, (select count(*) from e where dst not in (select id from n)) as dangling""")
def isolated_ratio(spark, d):
    nodes = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    linked = F.col("l_quantity") > 40  # other lines join two keys that no order has
    edges = read_table(spark, d, "lineitem").select(F.when(linked, F.col("l_orderkey")).otherwise(-F.col("l_linenumber")).alias("src"),
                                                    F.when(linked, F.col("l_orderkey") + F.col("l_linenumber")).otherwise(-F.col("l_linenumber") - 1).alias("dst"))
    out = R.isolation(nodes, edges, "id")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("nodes", "isolated")], "isolated_ratio", F.col("dangling").cast("long").alias("dangling"))


@query("RET-07")
def generation_propagation(spark, d):
    anchors = read_table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    pairs = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), ((F.col("l_orderkey") * 31 + F.col("l_partkey")) % 15000).alias("dst"), (F.col("l_discount") * 10).alias("residual"))
    confirmed = read_table(spark, d, "orders").where("o_totalprice < 20000").select(F.col("o_orderkey").alias("id"))
    return R.propagate(anchors, pairs, confirmed, 0.5)


@query("RET-08", """
select o_orderkey, count(l_returnflag) as facts, count(distinct l_returnflag) as categories from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def lineage_forward(spark, d):
    facts = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return R.trace_forward(read_table(spark, d, "orders"), facts, "o_orderkey", "l_returnflag")


@query("RET-08", """
with s as (select l_partkey, l_orderkey, count(*) as n from lineitem group by 1, 2)
select p_partkey, l_orderkey as o_orderkey, n as observations, o_orderstatus from part join s on l_partkey = p_partkey left join orders on o_orderkey = l_orderkey""")
def lineage_back(spark, d):
    obs = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("o_orderkey"))
    return R.trace_back(read_table(spark, d, "part"), obs, read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "p_partkey", "o_orderkey")


_SPLIT = """s as (select source, count(*) as n, md5('42|' || source) as h from documents group by 1),
c as (select *, sum(n) over (order by h rows between unbounded preceding and 1 preceding) as before, sum(n) over () as total from s),
p as (select source, case when (coalesce(before, 0) + n / 2) / total <= 0.7::double / (0.7::double + 0.15::double + 0.15::double) then 'train' when (coalesce(before, 0) + n / 2) / total <= (0.7::double + 0.15::double) / (0.7::double + 0.15::double + 0.15::double) then 'val' else 'test' end as split from c)"""


def _split(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return V.split_groups(docs, "source")


@query("EVL-01", f"with {_SPLIT} select doc_id, source, split from documents join p using (source)")
def group_split(spark, d):
    return _split(spark, d).select("doc_id", "source", "split")


@query("EVL-02", f"with {_SPLIT} select lang, count(distinct split) as splits from documents join p using (source) group by 1 having count(distinct split) > 1")
def leakage_check(spark, d):
    return V.leaks(_split(spark, d), "lang")


@query("EVL-03", f"""with {_SPLIT} select split, count(distinct source) as projects, count(*) as samples, count(*) filter (where lang = 'en') as class_en, count(*) filter (where lang = 'fr') as class_fr,
 count(*) filter (where lang = 'de') as class_de, count(*) filter (where lang = 'es') as class_es from documents join p using (source) group by 1""")
def split_stats(spark, d):
    return V.split_stats(_split(spark, d), "source", "lang", ["en", "fr", "de", "es"])


LAYER_RULES = [{"kind": "column", "aliases": ["Brand#1"], "substrings": ["gear"]}, {"kind": "beam", "prefixes": ["Brand#2"], "patterns": ["^hot .*t$"]},
               {"kind": "wall", "substrings": ["widget"], "prefixes": ["Brand#3"]}]


@query("EVL-04", """
with p as (select p_partkey, upper(p_brand) as l, upper(p_name) as b from part),
c as (select p_partkey, case when l = 'BRAND#1' then 'column|layer' when b like 'BRAND#2%' then 'beam|block' when b like 'BRAND#3%' then 'wall|block' when contains(b, 'GEAR') then 'column|block' when regexp_matches(b, '(?i)^hot .*t$') then 'beam|block' when contains(b, 'WIDGET') then 'wall|block'
  when l like 'BRAND#2%' then 'beam|layer' when l like 'BRAND#3%' then 'wall|layer' else '|none' end as x from p)
select p_partkey, nullif(split_part(x, '|', 1), '') as label, split_part(x, '|', 2) as label_source from c""")
def weak_labels(spark, d):
    return V.weak_label(read_table(spark, d, "part"), "p_brand", "p_name", LAYER_RULES).select("p_partkey", "label", "label_source")


@query("EVL-05", """
with a as (select user_id, json_extract(props, '$.k')::bigint % 30 as t, case event_type when 'error' then 'reject' when 'click' then 'confirm' else 'reclass' end as action,
  case when event_type = 'view' then '{"severity": "critical", "obligation_level": "may"}' when event_type = 'click' then 'broken' else '{"severity": "odd", "snippet": "s' || event_id || '"}' end as note, ts, event_id from events),
l as (select user_id, t, arg_max(action, struct_pack(t := ts, e := event_id)) as action, arg_max(note, struct_pack(t := ts, e := event_id)) as note from a group by 1, 2)
select user_id, 'T' || t as ref, case when note like '%critical%' then 'critical' else 'major' end as severity, case when note like '%may%' then 'MAY' else 'SHOULD' end as obligation_level,
  case when note like '%snippet%' then json_extract_string(note, '$.snippet') else '' end as snippet from l where action <> 'reject'""")
def gold_from_actions(spark, d):
    kind = F.col("event_type")
    note = (F.when(kind == "view", '{"severity": "critical", "obligation_level": "may"}').when(kind == "click", "broken")
            .otherwise(F.concat(F.lit('{"severity": "odd", "snippet": "s'), F.col("event_id"), F.lit('"}'))))
    rows = read_table(spark, d, "events").select(
        "user_id", F.concat(F.lit("t "), F.get_json_object("props", "$.k").cast("long") % 30).alias("target"), F.when(kind == "error", "reject").when(kind == "click", "confirm").otherwise("reclass").alias("action"),
        note.alias("note"), "ts", "event_id")
    return V.gold(rows, ["user_id"], "target", "action", "note", ["ts", "event_id"])


_GT = """g as (select doc_id, case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end as g from labels),
p as (select doc_id, case when n_chars > 3000 then 'good' when n_chars < 500 then 'toxic' else 'poor' end as p from documents),
b as (select coalesce(g.doc_id, p.doc_id) as doc_id, g, p from g full join p on p.doc_id = g.doc_id)"""


def _gold_and_pred(spark, d):
    gt = read_table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("gt_class"))
    pred = read_table(spark, d, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 3000, "good").when(F.col("n_chars") < 500, "toxic").otherwise("poor").alias("pred_class"))
    return gt, pred


@query("EVL-06", f"""
with {_GT},
m as (select g as cls, 'tp' as m from b where g = p union all select p, 'fp' from b where p is not null and g is distinct from p union all select g, 'fn' from b where g is not null and g is distinct from p),
s as (select coalesce(cls, '*') as cls, count(*) filter (where m = 'tp') as tp, count(*) filter (where m = 'fp') as fp, count(*) filter (where m = 'fn') as fn from m group by rollup (cls))
select cls, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) as recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) as f1 from s""")
def prf_by_key(spark, d):
    return V.prf(*_gold_and_pred(spark, d), ["doc_id"])


_LEVELS = ("[MUST] ", "[MAY] ", "")
_SAID = tuple(f"{level}{p} {f}" for level in _LEVELS for p in _PRIORITIES for f in "ANR")


@query("EVL-06", f"""
with s(description, snippet) as (values {_alike_values(_SAID, _PRIORITIES)}),
g as (select o_custkey, o_orderkey as id, 'GB' || o_orderkey % 23 as ref, o_orderpriority as snippet, case o_orderstatus when 'F' then 0 when 'O' then 2 else 3 end as sev, case o_orderkey % 3 when 0 then 'MUST' else 'SHOULD' end as level from orders),
p as (select o_custkey, l_orderkey * 100 + l_linenumber as id, 'GB' || min(l_partkey) % 23 as ref, case l_linenumber % 3 when 0 then '[MUST] ' when 1 then '[MAY] ' else '' end || o_orderpriority || ' ' || min(l_returnflag) as description,
  case when l_linenumber % 4 = 0 then 0 else 2 end as sev, case l_linenumber % 3 when 0 then 'MUST' when 1 then 'MAY' else 'SHOULD' end as level from lineitem join orders on o_orderkey = l_orderkey group by o_custkey, l_orderkey, l_linenumber, o_orderpriority),
u as (select distinct o_custkey, 'GB' || o_orderkey % 29 as ref from orders where o_orderkey % 2 = 0),
gn as (select *, row_number() over (partition by o_custkey, ref order by id) as n from g), pn as (select *, row_number() over (partition by o_custkey, ref order by id) as n from p),
m as (select gn.o_custkey, gn.id as g, pn.id as p, case when abs(gn.sev - pn.sev) <= 1 then 'tp' else 'wrong_severity' end as mark, gn.level as gl, pn.level as pl from gn join pn on gn.o_custkey = pn.o_custkey and gn.ref = pn.ref and gn.n = pn.n),
x as (select o_custkey, mark, gl, pl from m
  union all select p.o_custkey, case when exists (select 1 from s join g on g.snippet = s.snippet where g.o_custkey = p.o_custkey and s.description = p.description) then 'wrong_ref' else 'spurious' end, null, null from p where id not in (select p from m)
  union all select g.o_custkey, case when exists (select 1 from u where u.o_custkey = g.o_custkey and u.ref = g.ref) then 'dropped' else 'missed' end, null, null from g where id not in (select g from m)),
c as (select o_custkey, count(*) filter (where mark = 'tp') as tp, count(*) filter (where mark in ('spurious', 'wrong_ref', 'wrong_severity')) as fp, count(*) filter (where mark in ('missed', 'dropped')) as fn,
  count(*) filter (where mark = 'spurious') as spurious, count(*) filter (where mark = 'wrong_ref') as wrong_ref, count(*) filter (where mark = 'wrong_severity') as wrong_severity, count(*) filter (where mark = 'missed') as missed,
  count(*) filter (where mark = 'dropped') as dropped, count(*) filter (where mark = 'tp' and gl = 'MUST') as must, count(*) filter (where mark = 'tp' and gl = 'MUST' and pl <> 'MUST') as down from x group by 1)
select o_custkey, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) as recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) as f1, tp as ref_hits,
  case when tp > 0 then 1.0 else 0.0 end::double as hit_rate, spurious, wrong_ref, wrong_severity, missed, dropped, coalesce(round(down / nullif(must, 0), 4), 0) as downgrade_rate from c""")
def compliance_scores(spark, d):
    """Found issues of all customers against gold ones: matches by reference, causes of the rest."""
    orders = read_table(spark, d, "orders")
    key = F.col("o_orderkey")
    gold = orders.select("o_custkey", key.alias("gold_id"), F.concat(F.lit("GB"), key % 23, F.lit("-2010")).alias("ref"), F.col("o_orderpriority").alias("snippet"),
                         F.when(F.col("o_orderstatus") == "F", "info").when(F.col("o_orderstatus") == "O", "major").otherwise("critical").alias("severity"), F.when(key % 3 == 0, "MUST").alias("obligation"))
    lines = read_table(spark, d, "lineitem").join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").groupBy("o_custkey", "l_orderkey", "l_linenumber", "o_orderpriority").agg(
        F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"))
    number = F.col("l_linenumber")
    level = F.when(number % 3 == 0, _LEVELS[0]).when(number % 3 == 1, _LEVELS[1]).otherwise(_LEVELS[2])
    found = lines.select("o_custkey", (F.col("l_orderkey") * 100 + number).alias("found_id"), F.concat(F.lit(" gb"), F.col("part") % 23, F.lit("-2015")).alias("ref"),
                         F.concat(level, "o_orderpriority", F.lit(" "), "flag").alias("description"), F.when(number % 4 == 0, "info").otherwise("major").alias("severity"))
    recalled = orders.where(key % 2 == 0).select("o_custkey", key.alias("found_id"), F.concat(F.lit("GB"), key % 29).alias("ref"), F.lit("").alias("description"))
    return K.issue_scores(K.match_issues(gold, found, ["o_custkey"], recalled), ["o_custkey"])


@query("EVL-07")
def panoptic_quality(spark, d):
    box = lambda k, x, y: [(x).alias("x0"), (y).alias("y0"), (x + 5).alias("x1"), (y + 4).alias("y1")]
    part, customer = read_table(spark, d, "part"), read_table(spark, d, "customer")
    gt = part.select("p_partkey", (F.col("p_size") % 5).alias("cls"), *box("p", F.col("p_partkey") % 89 * 2.0, F.col("p_size") * 2.0))
    pred = customer.select("c_custkey", (F.col("c_nationkey") % 5).alias("cls"), *box("c", F.col("c_custkey") % 97 * 2.0 + 0.5, F.col("c_nationkey") * 4.0 + 0.5))
    matches = pair_boxes(gt, pred, "p_partkey", "c_custkey", 0.5, ["cls"])
    count = lambda df: df.groupBy("cls").agg(F.count("*").alias("n"))
    return V.panoptic(matches, count(gt), count(pred), "cls")


@query("EVL-08", f"""
with {_GT} select coalesce(g, '__spurious__') as gt_class, count(*) filter (where p = 'good') as pred_good, count(*) filter (where p = 'poor') as pred_poor, count(*) filter (where p = 'toxic') as pred_toxic, count(*) filter (where p is null) as pred___missed__ from b group by 1""")
def confusion_matrix(spark, d):
    return V.confusion(*_gold_and_pred(spark, d), ["doc_id"], ["good", "poor", "toxic"])


@query("EVL-09", f"""
with {_GT}, s as (select doc_id % 37 as sample, count(*) filter (where g = p) as tp, count(*) filter (where p is not null and g is distinct from p) as fp, count(*) filter (where g is not null and g is distinct from p) as fn from b group by 1),
t as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, count(*) as samples from s)
select tp, fp, fn, round(tp / (tp + fp), 4) as precision, round(tp / (tp + fn), 4) as recall, round(2 * tp / (2 * tp + fp + fn), 4) as f1, samples from t""")
def micro_average(spark, d):
    both = V.outcome(*_gold_and_pred(spark, d), ["doc_id"])
    hit = F.coalesce(F.col("gt_class") == F.col("pred_class"), F.lit(False))
    per = both.groupBy((F.col("doc_id") % 37).alias("sample")).agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit & F.col("pred_class").isNotNull()).alias("fp"), F.count_if(~hit & F.col("gt_class").isNotNull()).alias("fn"))
    return V.micro(per)


@query("EVL-10", """
with g as (select doc_id, case when toxic = 1 then 'toxic' when quality = 1 then 'good' else 'poor' end as g from labels),
p as (select doc_id, 'rule' as method, case when n_chars > 3000 then 'good' when n_chars < 500 then 'toxic' else 'poor' end as p from documents union all select doc_id, 'model', case when lang = 'en' then 'good' else 'poor' end from documents
  union all select doc_id, 'fusion', case when n_chars > 1000 or lang = 'en' then 'good' when n_chars < 300 then 'toxic' else 'poor' end from documents),
m(method) as (values ('rule'), ('model'), ('fusion'), ('silent')), o as (select doc_id, method, g from g, m),
s as (select method, count(*) filter (where g = p) as tp, count(*) filter (where p is not null and g is distinct from p) as fp, count(*) filter (where g is not null and g is distinct from p) as fn from o full join p using (doc_id, method) group by 1)
select method, tp, fp, fn, coalesce(round(tp / nullif(tp + fp, 0), 4), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 4), 0) as recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 4), 0) as f1 from s""")
def method_comparison(spark, d):
    docs, (gt, _) = read_table(spark, d, "documents"), _gold_and_pred(spark, d)
    n, en = F.col("n_chars"), F.col("lang") == "en"
    named = lambda df, m, c: df.select("doc_id", F.lit(m).alias("method"), c.alias("pred_class"))
    preds = (named(docs, "rule", F.when(n > 3000, "good").when(n < 500, "toxic").otherwise("poor"))
             .union(named(docs, "model", F.when(en, "good").otherwise("poor")))
             .union(named(docs, "fusion", F.when((n > 1000) | en, "good").when(n < 300, "toxic").otherwise("poor"))))
    return V.compare(preds, gt, ["doc_id"], "method", ["rule", "model", "fusion", "silent"])


@query("EVL-11")
def tolerance_match(spark, d):
    pred = read_table(spark, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("pred_id"), (F.col("o_totalprice") / 10000).alias("value"), (F.col("o_orderkey") % 100 / 100).alias("confidence"))
    gold = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(
        F.col("o_custkey").alias("sample"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("gold_id"), F.col("l_quantity").alias("gold"))
    return V.match_values(pred, gold, ["sample"], 0.2)


@query("EVL-12")
def order_fidelity(spark, d):
    words = F.split("text", " ")
    rows = read_table(spark, d, "documents").select("doc_id", F.array_distinct(words).alias("found"), F.array_sort(F.array_distinct(words)).alias("wanted"))
    return V.order_fidelity(rows, "found", "wanted").select("doc_id", F.round("fidelity", 6).alias("fidelity"))


@query("EVL-13", """
with p as (select l_orderkey, l_linenumber, l_partkey, case l_returnflag when 'A' then 'column' when 'N' then 'pipe' else 'stair' end as rc, l_discount * 10 as rf, case l_linestatus when 'F' then 'column' else 'pipe' end as mc, l_quantity / 50 as mf from lineitem),
d as (select *, case when rc = mc then 'consensus' when rf >= 0.85::double then 'rule_protected' when mf >= 0.45::double and mf > rf + 0.2::double * (case rc when 'column' then 10 else 5 end / 10) then 'model_override' else 'rule_wins' end as decision from p)
select decision, case when decision = 'model_override' then mc else rc end as final_class, count(*) as n, round(sum(case when decision = 'consensus' then least(greatest(rf, mf) + 0.1::double, 1) when decision = 'model_override' then mf else rf end), 4) as conf from d group by 1, 2""")
def rule_model_arbitration(spark, d):
    flag = F.col("l_returnflag")
    pairs = read_table(spark, d, "lineitem").select(
        F.when(flag == "A", "column").when(flag == "N", "pipe").otherwise("stair").alias("rule_class"), (F.col("l_discount") * 10).alias("rule_conf"),
        F.when(F.col("l_linestatus") == "F", "column").otherwise("pipe").alias("model_class"), (F.col("l_quantity") / 50).alias("model_conf"))
    return V.arbitrate(pairs).groupBy("decision", "final_class").agg(F.count("*").alias("n"), F.round(F.sum("final_conf"), 4).alias("conf"))


@query("EVL-14", """
with b as (select o_orderkey, o_totalprice / 499979 as cx, (o_custkey % 1000) / 1000.0::double as cy, 0.01::double + (o_orderkey % 7) * 0.02::double as w, 0.02::double as h from orders),
t as (select x.i as tx, y.i as ty, x.i * 540 as x0, y.i * 540 as y0, least(x.i * 540 + 640, 4000) as x1, least(y.i * 540 + 640, 3000) as y1 from range(0, 8) x(i), range(0, 6) y(i) where x.i <= ceil((4000 - 640) / 540.0) and y.i <= ceil((3000 - 640) / 540.0)),
c as (select o_orderkey, tx, ty, x0, y0, x1, y1, (w * 4000) * (h * 3000) as area, greatest(cx * 4000 - w * 2000, x0) as bx0, greatest(cy * 3000 - h * 1500, y0) as by0, least(cx * 4000 + w * 2000, x1) as bx1, least(cy * 3000 + h * 1500, y1) as by1 from b join t on cx * 4000 between x0 and x1 and cy * 3000 between y0 and y1)
select o_orderkey, tx, ty, round(((bx0 + bx1) / 2 - x0) / (x1 - x0), 6) as cx, round((by1 - by0) / (y1 - y0), 6) as h from c where bx1 > bx0 and by1 > by0 and (bx1 - bx0) * (by1 - by0) >= 0.5 * area""")
def tile_assign(spark, d):
    boxes = read_table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 499979).alias("cx"), (F.col("o_custkey") % 1000 / 1000.0).alias("cy"), (0.01 + F.col("o_orderkey") % 7 * 0.02).alias("w"), F.lit(0.02).alias("h"))
    return V.tiles(boxes, 4000, 3000, 640, 100).select("o_orderkey", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), F.round("cx", 6).alias("cx"), F.round("h", 6).alias("h"))


@query("EVL-15", """
with e as (select p_brand, count(*) as total, round(count(*) filter (where l_shipdate > timestamp '1997-01-01' and l_returnflag <> 'N') / count(*), 4) as vr, round(count(*) filter (where l_quantity > 5) / count(*), 4) as lr, round(count(*) filter (where l_linestatus = 'F') / count(*), 4) as cr
  from lineitem join part on p_partkey = l_partkey group by 1),
b as (select p_brand, sum(p_size)::bigint as expected from part where p_size > 1 group by 1)
select p_brand, coalesce(total, 0) as total, coalesce(vr, 0) as vertical_rate, coalesce(lr, 0) as location_rate, coalesce(cr, 0) as confirmed_rate, case when expected > 0 then round(1 - abs(expected - coalesce(total, 0)) / expected, 4) end as count_accuracy from e full join b using (p_brand)""")
def acceptance_metrics(spark, d):
    part = read_table(spark, d, "part")
    entities = read_table(spark, d, "lineitem").join(part.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").select(
        "p_brand", F.when(F.col("l_shipdate") > F.lit("1997-01-01").cast("timestamp"), F.when(F.col("l_returnflag") == "N", "story_default").otherwise("section")).alias("z_source"),
        F.when(F.col("l_quantity") > 5, "C-3").alias("grid_ref"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("auto").alias("review_state"))
    bom = part.where("p_size > 1").groupBy("p_brand").agg(F.sum("p_size").alias("expected"))
    return V.acceptance(entities, bom, "p_brand")
