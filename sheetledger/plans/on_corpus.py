"""Text corpus jobs and gates bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import gates as G
from ..operators.common import literal_table

from ..sources.tables import read_table
from .catalog import query
from .on_functions import CLOSURES, TOKENS

# Words that do occur in the test prose; a caller passes its own.
MODAL = ("there", "mente", "nicht", "der ", "que ")
PROBLEMS = {"sequence": (r"there", 5.8, 15), "change": (r"tion le", 4.81, 11), "table": (r"\|", 3.18, 16), "clash": (r"the", 9.9, 2)}


@query("TXT-01", r"""
with l as (select doc_id, i, trim(line) as l from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
           where not regexp_matches(line, '^\s*\d{1,3}\s*$') and regexp_replace(line, '\s+', '', 'g') <> ''),
h as (select *, regexp_matches(l, '^[A-E][a-z]+') as head from l), g as (select *, sum(head::int) over (partition by doc_id order by i) as grp from h),
a as (select doc_id, grp, string_agg(l, '' order by i) as t from g where grp > 0 group by 1, 2),
b as (select doc_id, grp, regexp_extract(t, '^[A-E][a-z]+', 0) as article_no, trim(regexp_replace(t, '^[A-E][a-z]+', '')) as body from a),
r as (select *, regexp_replace(body, '^[\d.．\s]+', '') as rest from b),
k as (select * from r where length(body) >= 6 and not regexp_matches(body, '^\d+$') and length(rest) >= 4 and (contains(rest, 'there') or contains(rest, 'mente') or contains(rest, 'nicht') or contains(rest, 'der ') or contains(rest, 'que ') or length(rest) >= 12 and regexp_matches(rest, '[.]')))
select doc_id, (row_number() over (partition by doc_id order by grp) - 1)::int as idx, article_no, md5(body) as body_md5 from k""")
def article_split(spark, d):
    out = C.split_articles(read_table(spark, d, "documents"), "doc_id", "text", "[A-E][a-z]+", MODAL, "[.]")
    return out.select("doc_id", "idx", "article_no", F.md5("body").alias("body_md5"))


@query("TXT-02", r"""
with l as (select doc_id, i, line, case when contains(line, 'there') or contains(line, 'nicht') then 'watermark' when regexp_matches(line, '^\s*\d{1,3}\s*$') then 'page_number' when regexp_matches(line, '\|.*\|') then 'contents' else 'keep' end as k
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))
select doc_id, md5(coalesce(string_agg(case when k = 'keep' then line end, chr(10) order by i), '')) as text_md5, (count(*) filter (where k = 'watermark'))::int as watermark, (count(*) filter (where k = 'page_number'))::int as page_number, (count(*) filter (where k = 'contents'))::int as contents from l group by 1""")
def boilerplate_filter(spark, d):
    out = C.strip_boilerplate(read_table(spark, d, "documents"), "doc_id", "text", ("there", "nicht"), r"\|.*\|")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "watermark", "page_number", "contents")


@query("TXT-03", """
select page_id, page_id % 9 > 0 and length(html) / (page_id % 9) < 900 as scanned from pages""")
def scan_detector(spark, d):
    return read_table(spark, d, "pages").select("page_id", C.is_scanned(F.length("html"), F.col("page_id") % 9, 900).alias("scanned"))


@query("TXT-04", r"""
with f as (select doc_id, 0 as n, 'source' as source, 0.9::double as confidence, source as t from documents union all select doc_id, 1, 'text', 0.7::double, text from documents),
h as (select doc_id, n, source, confidence, 'building_unit' as node_type, unnest(list_distinct(regexp_extract_all(t, '[A-F][a-z]{3}\b'))) as label from f
  union all select doc_id, n, source, confidence, 'sub_zone', unnest(list_distinct(regexp_extract_all(t, 'src1[0-9]|[0-9]{2,}'))) from f)
select doc_id, node_type, label, arg_min(source, n) as source, arg_min(confidence, n) as confidence from h group by 1, 2, 3""")
def semantic_candidates(spark, d):
    return C.semantic_candidates(read_table(spark, d, "documents"), "doc_id", {"source": 0.9, "text": 0.7},
                                 {"building_unit": r"[A-F][a-z]{3}(?![A-Za-z0-9_])", "sub_zone": r"src1[0-9]|[0-9]{2,}"})


@query("TXT-05")
def reading_order(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    tokens = read_table(spark, d, "events").select(
        "user_id", "event_id", (k * 8).alias("x"), (F.col("value") * 4).alias("y"), F.col("event_type").alias("text"))
    return C.to_lines(tokens, ["user_id"], "event_id")


@query("TXT-06", """
select doc_id, n_chars > 1000 as is_mandatory, substr(text, 1, 300) as preview from documents where text ilike '%then%' or source ilike '%then%' order by 2 desc, doc_id limit 20""")
def keyword_search(spark, d):
    return C.search_articles(read_table(spark, d, "documents"), "then", ["text", "source"], F.col("n_chars") > 1000, [F.asc("doc_id")], 20, "text").select(
        "doc_id", "is_mandatory", "preview")


@query("TXT-07", r"""
select doc_id, array_to_string(list_filter([case when regexp_matches(text, 'there') then 'sequence' end, case when regexp_matches(text, 'tion le') then 'change' end, case when regexp_matches(text, '\|') then 'table' end, case when regexp_matches(text, 'the') then 'clash' end], lambda x: x is not null), ',') as problem_types,
  greatest(0, case when regexp_matches(text, 'there') then 5.8::double else 0 end, case when regexp_matches(text, 'tion le') then 4.81::double else 0 end, case when regexp_matches(text, '\|') then 3.18::double else 0 end) as max_lift,
  regexp_matches(text, '(?:the|der) [a-z]{0,6}(?:tion|sch)') as responsible_party, regexp_matches(text, '[0-9]{2}') as deadline, regexp_matches(text, 'worth|cost') as cost_consequence from documents""")
def risk_profile(spark, d):
    out = C.risk_profile(read_table(spark, d, "documents"), "doc_id", "text", PROBLEMS, CLOSURES, "worth|cost")
    return out.select("doc_id", F.array_join("problem_types", ",").alias("problem_types"), "max_lift", "responsible_party", "deadline", "cost_consequence")


ITEMS = [("en", "scope", "meta", []), ("en", "place", "location", []), ("en", "pipes", "interface", ["there", "thand"]), ("en", "order", "constructability", ["tion the"]),
         ("en", "danger", "risk", []), ("en", "words", "concern", ["her", "ble"]), ("fr", "scope", "meta", []), ("fr", "lift", "concern", ["tion le"]),
         ("fr", "danger", "risk", []), ("de", "place", "location", []), ("de", "words", "concern", ["sch", "ung"])]


@query("TXT-08", """
with d as (select doc_id, lang, text, n_chars > 200 as meta, contains(text, '|') as loc, contains(text, 'other') as conf, case when n_chars > 5000 then 'high' when n_chars > 1500 then 'medium' else 'low' end as risk from documents),
i as (select * from (values ('en', 'scope', 'meta'), ('en', 'place', 'location'), ('en', 'pipes', 'interface'), ('en', 'order', 'constructability'), ('en', 'danger', 'risk'), ('en', 'words', 'concern'), ('fr', 'scope', 'meta'), ('fr', 'lift', 'concern'), ('fr', 'danger', 'risk'), ('de', 'place', 'location'), ('de', 'words', 'concern')) t(lang, item, kind)),
h as (select d.*, item, kind, case item when 'pipes' then contains(text, 'there') or contains(text, 'thand') when 'order' then contains(text, 'tion the') when 'words' then case d.lang when 'en' then contains(text, 'her') or contains(text, 'ble') else contains(text, 'sch') or contains(text, 'ung') end when 'lift' then contains(text, 'tion le') else false end as hit from d join i on i.lang = d.lang),
a as (select *, case kind when 'interface' then conf or hit when 'risk' then risk <> 'low' when 'constructability' then hit when 'concern' then hit else true end as applies,
  case kind when 'meta' then meta when 'location' then loc when 'interface' then hit and loc when 'risk' then risk = 'high' when 'constructability' then hit and meta else hit end as cov from h)
select doc_id, count(*) filter (where applies) as checked, count(*) filter (where applies and cov) as covered, coalesce(round(count(*) filter (where applies and cov) / nullif(count(*) filter (where applies), 0), 2), 0) as ratio,
  coalesce(string_agg(case when applies and not cov then item end, ',' order by item), '') as uncovered from a group by 1""")
def checklist_screen(spark, d):
    items = literal_table(spark, ITEMS, "discipline string, item string, kind string, words array<string>")
    docs = read_table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("discipline"), "text", (F.col("n_chars") > 200).alias("has_meta"), F.col("text").contains("|").alias("has_location"),
        F.col("text").contains("other").alias("interface_conflict"), F.when(F.col("n_chars") > 5000, "high").when(F.col("n_chars") > 1500, "medium").otherwise("low").alias("risk_level"))
    return C.checklist_summary(C.checklist(docs, "doc_id", items), "doc_id").withColumn("uncovered", F.array_join("uncovered", ","))


AUDIT = dict(
    disciplines={"EN": {"terms": ["the ", "ing"], "objects": ["thand", "onthe", "ered"], "interfaces": ["there", "hand"]},
                 "FR": {"terms": ["que ", "eau"], "objects": ["ment", "tre"], "interfaces": ["leau", "paaux"]}, "DE": {"terms": ["sch", "und"], "objects": ["ung"], "interfaces": []}},
    concerns={"sequence": ["there", "thre"], "change": ["tion le", "tion the"], "table": ["|"]}, high_signals=["worth"], medium_signals=["other", "avec"],
    scenarios=[("conflict", ["there"]), ("landing", ["avec"]), ("acceptance", ["und "])], patterns=TOKENS)


@query("TXT-09")
def audit_text_batch(spark, d):
    docs = read_table(spark, d, "documents")
    out = C.audit(docs, "doc_id", "text", F.when(F.col("n_chars") > 8000, F.upper("lang")), **AUDIT)
    return out.select("doc_id", "discipline.code", "discipline.basis", F.array_join("objects", ",").alias("objects"), F.array_join("concerns", ",").alias("concerns"),
                      "risk", "scenario", F.array_join("questions", " ").alias("questions"), F.array_join("gaps", ",").alias("gaps"))


@query("TXT-09", """
select role, count(*) as turns, count(*) filter (where contains(text, 'there')) as conflict, count(*) filter (where not contains(text, 'there') and contains(text, 'avec')) as landing,
  count(*) filter (where contains(text, 'worth') or contains(text, 'there') and contains(text, 'hand') and contains(text, 'there') and (contains(text, 'the ')::int + contains(text, 'ing')::int) >= greatest(1, contains(text, 'que ')::int + contains(text, 'eau')::int, contains(text, 'sch')::int + contains(text, 'und')::int)
   or contains(text, 'leau') and contains(text, 'paaux') and contains(text, 'que ')::int + contains(text, 'eau')::int > contains(text, 'the ')::int + contains(text, 'ing')::int and contains(text, 'que ')::int + contains(text, 'eau')::int >= contains(text, 'sch')::int + contains(text, 'und')::int) as high
from conversations group by 1""")
def audit_minutes(spark, d):
    out = C.audit(read_table(spark, d, "conversations"), "role", "text", F.lit(None).cast("string"), **AUDIT)
    return out.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.col("scenario") == "conflict").alias("conflict"),
                                   F.count_if(F.col("scenario") == "landing").alias("landing"), F.count_if(F.col("risk") == "high").alias("high"))


@query("DQ-01", """
with e as (select l_orderkey, max(case when l_returnflag = 'A' then l_shipdate end) as signed, max(case when l_quantity > 45 then 1 end) as sheet from lineitem group by 1)
select o_orderkey, o_orderstatus, 'ECONOMIC_REVIEW_NOT_SIGNED' as violation from orders left join e on l_orderkey = o_orderkey where o_orderstatus in ('F', 'P') and signed is null
union all select o_orderkey, o_orderstatus, 'QUOTA_SHEET_MISSING' from orders left join e on l_orderkey = o_orderkey where o_orderstatus = 'F' and sheet is null""")
def publish_gates(spark, d):
    evidence = read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("signed"), F.max(F.when(F.col("l_quantity") > 45, 1)).alias("sheet"))
    gates = [("ECONOMIC_REVIEW_NOT_SIGNED", ("F", "P"), "signed"), ("QUOTA_SHEET_MISSING", ("F",), "sheet")]
    return G.gate_violations(read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), evidence, "o_orderkey", "o_orderstatus", gates)


_ROLES = ("A", "N", "R")


def _approvals(spark, d):
    role = F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).otherwise("witness")  # nobody asks for a witness
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), role.alias("role"), F.col("l_shipdate").alias("signed_at"))


@query("DQ-02", """
with r(role) as (values ('A'), ('N'), ('R'))
select o_orderkey, role from orders, r where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = role and l_quantity > 10)""")
def sign_completion(spark, d):
    return G.missing_signers(read_table(spark, d, "orders"), _approvals(spark, d), "o_orderkey", _ROLES)


@query("DQ-02", """
select l_orderkey as o_orderkey, strftime(max(l_shipdate) + interval 7 day, '%Y-%m-%d') as notice_ends_at from lineitem where l_quantity > 10 group by 1 having count(distinct l_returnflag) = 3""")
def notice_period(spark, d):
    out = G.notice_ends(read_table(spark, d, "orders"), _approvals(spark, d), "o_orderkey", _ROLES, 7)
    return out.select("o_orderkey", F.date_format("notice_ends_at", "yyyy-MM-dd").alias("notice_ends_at"))


@query("DQ-03", """
with m as (select user_id, event_id, event_type as to_state, lag(event_type) over (partition by user_id order by ts, event_id) as from_state from events)
select user_id, event_id, from_state, to_state, list_position(['signup', 'view', 'click', 'purchase', 'error'], to_state) < list_position(['signup', 'view', 'click', 'purchase', 'error'], from_state) as backward
from m where from_state is not null and (from_state, to_state) not in (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('error', 'view'))""")
def transition_check(spark, d):
    allowed = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("error", "view")]
    out = G.bad_transitions(read_table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", allowed,
                            ["signup", "view", "click", "purchase", "error"])
    return out.drop("ts")


@query("DQ-04", """
with p as (select p_brand, case when p_size = 50 then 'coordinate_base' when p_size % 17 = 0 then 'floor_skeleton' when p_size > 45 then 'elevation_reference' when p_size < 40 then 'component_source' end as role, p_type from part),
c as (select p_brand, p_type, count(*) filter (where role = 'coordinate_base') > 0 as b, count(*) filter (where role = 'floor_skeleton') > 0 as s, count(*) filter (where role = 'component_source') > 0 as c, count(*) filter (where role = 'elevation_reference') > 0 as e from p group by 1, 2)
select p_brand, p_type, case when b then 'full' else 'none' end as world_coords, case when s then 'full' when c then 'partial' else 'none' end as floors, case when e then 'full' else 'none' end as elevations, s or c as can_build,
 array_to_string(list_filter([case when not b then 'relative geometry only' end, case when not s and c then 'floors from titles' end, case when not s and not c then 'no floors' end, case when not e then 'default heights' end, case when not s and not c then 'cannot build' end], lambda x: x is not null), ';') as degradations from c""")
def set_capability(spark, d):
    size = F.col("p_size")
    rows = read_table(spark, d, "part").withColumn(
        "role", F.when(size == 50, "coordinate_base").when(size % 17 == 0, "floor_skeleton").when(size > 45, "elevation_reference").when(size < 40, "component_source"))
    return G.capability(rows, ["p_brand", "p_type"], "role").withColumn("degradations", F.array_join("degradations", ";"))


@query("DQ-05", """
with f as (select l_suppkey, l_partkey % 5 as floor, l_extendedprice / 100 as x, l_quantity as y, l_discount > 0.08::double as placed from lineitem),
s as (select l_suppkey, floor, count(*) filter (where placed) as p, count(*) filter (where not placed) as u, avg(x) filter (where placed) as px, avg(y) filter (where placed) as py, avg(x) filter (where not placed) as ux, avg(y) filter (where not placed) as uy from f group by 1, 2),
d as (select *, sqrt((px - ux) ** 2 + (py - uy) ** 2) as dist from s where p > 0 and u > 0)
select l_suppkey, floor, p as placed_count, u as unplaced_count, round(p / (p + u), 3) as placed_ratio, round(dist, 1) as distance from d where dist is null or dist >= 50""")
def coordinate_conflict(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 5).alias("floor"), (F.col("l_extendedprice") / 100).alias("x"),
                                                   F.col("l_quantity").alias("y"), (F.col("l_discount") > 0.08).alias("placed"))
    return G.floor_conflict(rows, ["l_suppkey", "floor"], "x", "y", F.col("placed"))


@query("DQ-06", r"""
with l as (select p_brand, case when p_partkey % 10 = 0 then 'I' || p_size when p_partkey % 10 = 1 then '2-' || p_size when p_partkey % 10 = 2 then '1/' || p_size when p_partkey % 10 = 3 then substr('ABCDEFGH', p_size % 8 + 1, 1) else (p_size * 2)::varchar end as t, p_partkey % 10 as k, p_size from part),
v as (select p_brand, case when k = 1 then p_size else p_size * 2 end as n from l where k = 1 or k >= 4),
s as (select p_brand, n, lag(n) over (partition by p_brand order by n) as prev from (select distinct p_brand, n from v))
select p_brand, 'unparsable' as rule, t as detail from l where k = 0
union all select p_brand, 'kind', t from l where k = 3
union all select p_brand, 'zones', '2' from l group by p_brand having count(*) filter (where k = 1) > 0 and count(*) filter (where k not in (0, 1)) > 0
union all select p_brand, 'duplicate', n::varchar from v group by p_brand, n having count(*) > 1
union all select p_brand, 'gap', prev || '-' || n from s where n - prev > 1""")
def label_rule_check(spark, d):
    k, size = F.col("p_partkey") % 10, F.col("p_size")
    label = (F.when(k == 0, F.concat(F.lit("I"), size.cast("string"))).when(k == 1, F.concat(F.lit("2-"), size.cast("string"))).when(k == 2, F.concat(F.lit("1/"), size.cast("string")))
             .when(k == 3, F.substring(F.lit("ABCDEFGH"), size % 8 + 1, F.lit(1))).otherwise((size * 2).cast("string")))
    rows = read_table(spark, d, "part").select("p_brand", label.alias("label"))
    return G.label_violations(rows, ["p_brand"], "label", F.lit("numeric"))
