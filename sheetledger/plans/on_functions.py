"""String, date, math and nested functions bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import maths as M
from ..functions import nested as A
from ..functions import strings as S
from ..operators.projections import fmt
from ..operators.spatial import iou
from ..sources.tables import read_table
from .catalog import query


@query("STR-01", r"""
select p_partkey, upper(regexp_replace(p_brand || '12 - ' || p_size, '\s+', '', 'g')) as ref,
  regexp_replace(upper(regexp_replace('gb' || p_partkey || ' - 20' || (p_size % 90 + 10), '\s+', '', 'g')), '^([A-Z]+[0-9.]+)-[0-9]{2,4}', '\1') as base from part""")
def normalize_ref(spark, d):
    return read_table(spark, d, "part").select(
        "p_partkey", S.norm_ref(F.concat("p_brand", F.lit("12 - "), F.col("p_size").cast("string")), False).alias("ref"),
        S.norm_ref(F.concat(F.lit("gb"), F.col("p_partkey").cast("string"), F.lit(" - 20"), (F.col("p_size") % 90 + 10).cast("string"))).alias("base"))


@query("STR-02", r"""
select p_partkey, lower(regexp_replace('(' || p_type || ') ' || p_name || ' - ' || p_brand || '.', '[\s()（）\-—_,、.]', '', 'g')) as title from part""")
def normalize_title(spark, d):
    raw = F.concat(F.lit("("), F.col("p_type"), F.lit(") "), F.col("p_name"), F.lit(" - "), F.col("p_brand"), F.lit("."))
    return read_table(spark, d, "part").select("p_partkey", S.norm_title(raw).alias("title"))


_REF_SQL = """
t as (select p_brand as doc, p_partkey, p_partkey % 100 + 1000 as num, 1970 + p_size as y, p_size, p_name from part),
h as (select doc, p_partkey * 2 as pos, 'GB ' || num as base, case when p_size % 3 <> 0 and y between 1980 and 2035 then y::varchar end as year,
         case when p_size % 2 = 0 then p_name end as title from t
  union all select doc, p_partkey * 2 + 1, 'GB ' || num, null, null from t),
r as (select doc, case when year is not null then base || '-' || year else base end as std_no, base, year, count(*) as count, arg_min(title, pos) filter (where title is not null) as title from h group by 1, 2, 3, 4)"""


def _refs(spark, d):
    num = (F.col("p_partkey") % 100 + 1000).cast("string")
    year = F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("-"), (F.lit(1970) + F.col("p_size")).cast("string"))).otherwise("")
    title = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("《"), F.col("p_name"), F.lit("》("))).otherwise("")
    line = F.concat(title, F.lit("gb"), num, year, F.lit(") and GB "), num, F.lit("; GB 12 not GB12345678, xGB 5000, C30-C50\n"))
    texts = read_table(spark, d, "part").groupBy(F.col("p_brand").alias("doc")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda s: s["l"]), "").alias("text"))
    return S.extract_refs(texts, "doc", "text")


@query("STR-03", f"with {_REF_SQL} select doc, std_no, year, count, title from r")
def extract_standards(spark, d):
    return _refs(spark, d).select("doc", "std_no", "year", "count", "title")


@query("STR-04", f"""
with {_REF_SQL},
n as (select doc, base, max(year) as y from r where year is not null group by 1, 2)
select r.doc, case when r.year is null and n.y is not null then r.base || '-' || n.y else r.std_no end as std_no, sum(r.count)::bigint as count
from r left join n on n.doc = r.doc and n.base = r.base group by 1, 2""")
def consolidate_years(spark, d):
    return S.consolidate(_refs(spark, d), "doc").select("doc", "std_no", "count")


def _measured(texts):
    """Kinds and totals over texts; a text is parsed once, however often it occurs."""
    parsed = texts.groupBy("text").agg(F.count("*").alias("_n")).withColumn("m", S.parse_measures(F.col("text")))
    return parsed.groupBy("m.kind").agg(F.sum("_n").alias("n"), F.round(F.sum(F.col("m.value") * F.col("_n")), 3).alias("total"))


@query("STR-05", r"""
with t as (select l_orderkey, l_linenumber, l_partkey, case l_linenumber when 1 then 'DN' || l_quantity::int when 2 then '1:' || l_quantity::int when 3 then (l_quantity::int - 20) || '.' || (l_partkey % 900 + 100)
  when 4 then 'KL' || l_quantity::int when 5 then 'h = ' || l_partkey when 6 then (l_partkey + 90)::varchar else 'F' || l_quantity::int end as t from lineitem),
k as (select *, case when regexp_matches(t, '^KL[1-9]\d{0,2}$') then 'component_mark' when regexp_matches(t, '^DN\d{1,4}$') then 'pipe_diameter' when regexp_matches(t, '^1:\d{1,4}$') then 'scale'
  when regexp_matches(t, '^[+-]?\d{1,3}\.\d{3}$') then 'elevation' when regexp_matches(t, '^h = \d{2,4}$') then 'thickness' when regexp_matches(t, '^F\d{1,2}$') then 'level_name' when regexp_matches(t, '^\d{1,2}$') then 'axis' when regexp_matches(t, '^\d{2,5}$') then 'dimension' else 'other' end as kind from t)
select kind, count(*) as n, round(sum(case kind when 'pipe_diameter' then substr(t, 3)::double when 'scale' then substr(t, 3)::double when 'elevation' then t::double when 'thickness' then substr(t, 5)::double when 'dimension' then t::double end), 3) as total from k group by 1""")
def parse_measures(spark, d):
    q, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    part = F.col("l_partkey")
    text = (F.when(line == 1, F.concat(F.lit("DN"), q)).when(line == 2, F.concat(F.lit("1:"), q))
            .when(line == 3, F.concat((F.col("l_quantity").cast("int") - 20).cast("string"), F.lit("."), (part % 900 + 100).cast("string")))
            .when(line == 4, F.concat(F.lit("KL"), q)).when(line == 5, F.concat(F.lit("h = "), part.cast("string")))
            .when(line == 6, (part + 90).cast("string")).otherwise(F.concat(F.lit("F"), q)))
    return _measured(read_table(spark, d, "lineitem").select(text.alias("text")))


@query("STR-05", r"""
with t as (select l_linenumber as line, case l_linenumber when 1 then '标高' || (l_quantity::int - 20) || '.' || (l_partkey % 900 + 100) when 2 then '窗顶标高' || l_quantity::int || '.100，窗底标高42.350' when 3 then '地下' || (l_quantity::int % 9 + 1) || '层'
  when 4 then '大厅' || l_quantity::int || 'F' when 5 then case when l_partkey % 2 = 0 then '审核' else 'Drawing  No.' end when 6 then '办公室' || l_partkey % 10 else l_quantity::int || '厚防水层' end as t from lineitem)
select case line when 1 then 'elevation' when 2 then 'note' when 3 then 'level_name' when 4 then 'level_name' when 5 then 'title_block_label' when 6 then 'room_name' else 'construction_layer' end as kind, count(*) as n,
  round(sum(case when line = 1 then replace(t, '标高', '')::double when line = 7 then replace(t, '厚防水层', '')::double end), 3) as total from t group by 1""")
def short_texts(spark, d):
    """Kinds of Chinese notes: levels against prose, storeys with and without a place, title-block labels, rooms, layers."""
    q, line, part = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_partkey")
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    text = (F.when(line == 1, say("标高", q - 20, ".", part % 900 + 100)).when(line == 2, say("窗顶标高", q, ".100，窗底标高42.350")).when(line == 3, say("地下", q % 9 + 1, "层"))
            .when(line == 4, say("大厅", q, "F")).when(line == 5, F.when(part % 2 == 0, "审核").otherwise("Drawing  No.")).when(line == 6, say("办公室", part % 10)).otherwise(say(q, "厚防水层")))
    return _measured(read_table(spark, d, "lineitem").select(text.alias("text")))


@query("STR-06", r"""
with u as (select page_id, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) as f0, url from pages),
s as (select page_id, regexp_replace(coalesce(regexp_extract(url, '^https?://([^?#]*)', 1), ''), '\.[A-Za-z0-9]{1,5}$', '') as stem from u),
n as (select *, regexp_extract(stem, '[A-Za-z]{1,4}[-_ ]?\d{1,4}', 0) as num from s)
select page_id, case when num <> '' then num else stem end as number,
  case when regexp_matches(stem, '^(?:m\.|www)') then 'structure' when regexp_matches(stem, 'blog') then 'mep' when regexp_matches(stem, 'org|net') then 'architecture' else 'general' end as discipline,
  case when regexp_matches(stem, '(?i)/en') then 'plan' when regexp_matches(stem, '(?i)/fr') then 'section' else 'unknown' end as view from n""")
def parse_filename(spark, d):
    name = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    parsed = S.parse_name(name, (("structure", (r"m\.", "www")),), (("mep", ("blog",)), ("architecture", ("org", "net"))), (("plan", "(?i)/en"), ("section", "(?i)/fr")),
                          numbers=(r"[A-Za-z]{1,4}[-_ ]?\d{1,4}",))
    return read_table(spark, d, "pages").select("page_id", parsed.alias("p")).select("page_id", "p.number", "p.discipline", "p.view")


@query("STR-07", """
with t as (select p_partkey, p_size, case when p_partkey % 7 = 0 then 'B' || p_size || ' plan' when p_partkey % 7 = 1 then '地下' || p_size % 12 || '层' when p_partkey % 7 = 2 then p_size * 3 || 'F layout'
   when p_partkey % 7 = 3 then '十' || substr('一二三四五六七八九', p_size % 9 + 1, 1) || '层' when p_partkey % 7 = 4 then '屋面' when p_partkey % 7 = 5 then '基础' else 'notes' end as t from part)
select p_partkey, case when p_partkey % 7 = 0 and p_size between 1 and 9 then 'B' || p_size when p_partkey % 7 = 1 and p_size % 12 between 1 and 9 then 'B' || p_size % 12 when p_partkey % 7 = 2 and p_size * 3 <= 120 then 'F' || p_size * 3
   when p_partkey % 7 = 3 then 'F' || (11 + p_size % 9) when p_partkey % 7 = 4 then 'RF' when p_partkey % 7 = 5 then 'FD' end as key,
 (case when p_partkey % 7 = 0 and p_size between 1 and 9 then -p_size when p_partkey % 7 = 1 and p_size % 12 between 1 and 9 then -(p_size % 12) when p_partkey % 7 = 2 and p_size * 3 <= 120 then p_size * 3
   when p_partkey % 7 = 3 then 11 + p_size % 9 when p_partkey % 7 = 4 then 99 when p_partkey % 7 = 5 then -98 end)::int as floor_order from t""")
def parse_floor(spark, d):
    size, k = F.col("p_size"), F.col("p_partkey") % 7
    text = (F.when(k == 0, F.concat(F.lit("B"), size.cast("string"), F.lit(" plan"))).when(k == 1, F.concat(F.lit("地下"), (size % 12).cast("string"), F.lit("层")))
            .when(k == 2, F.concat((size * 3).cast("string"), F.lit("F layout")))
            .when(k == 3, F.concat(F.lit("十"), F.substring(F.lit("一二三四五六七八九"), size % 9 + 1, F.lit(1)), F.lit("层")))
            .when(k == 4, "屋面").when(k == 5, "基础").otherwise("notes"))
    return read_table(spark, d, "part").select("p_partkey", S.parse_floor(text).alias("f")).select("p_partkey", "f.key", F.col("f.order").alias("floor_order"))


WORDS = {"sequence": ["there", "thre"], "change": ["tion le", "tion the"], "embed": ["sch", "der "], "table": ["|"]}


@query("STR-08", """
with s as (select doc_id, 'sequence' as label, 1 as p, 0 as i, contains(text, 'there')::int + contains(text, 'thre')::int as hits from documents
  union all select doc_id, 'change', 1, 1, contains(text, 'tion le')::int + contains(text, 'tion the')::int from documents
  union all select doc_id, 'embed', 1, 2, contains(text, 'sch')::int + contains(text, 'der ')::int from documents
  union all select doc_id, 'table', 0, 3, contains(text, '|')::int from documents),
r as (select *, row_number() over (partition by doc_id order by p, hits desc, i) as rank from s where hits > 0)
select doc_id, label, hits::int as hits, rank::int as rank from r where rank <= 2""")
def keyword_classify(spark, d):
    return S.classify(read_table(spark, d, "documents"), "doc_id", "text", WORDS, ["table"], 2)


TOKENS = {"numbers": (r"[0-9]{3,}", r"[0-9]+-[0-9]+"), "caps": (r"[A-Z][a-z]{1,2}[.,]",), "marks": (r"[a-z]+\|",)}


@query("STR-09", r"""
select doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{1,2}[.,]')).list_sort(), ' ') as caps, len(list_distinct(regexp_extract_all(text, '[a-z]+\|')))::int as marks,
  len(list_distinct(list_concat(regexp_extract_all(text, '[0-9]{3,}'), regexp_extract_all(text, '[0-9]+-[0-9]+'))))::int as numbers from documents""")
def locate_tokens(spark, d):
    return read_table(spark, d, "documents").select("doc_id", S.locations(F.col("text"), TOKENS).alias("l")).select(
        "doc_id", F.array_join(F.array_sort("l.caps"), " ").alias("caps"), F.size("l.marks").alias("marks"), F.size("l.numbers").alias("numbers"))


CLOSURES = {"responsible_party": r"(?:the|der) [a-z]{0,6}(?:tion|sch)", "deadline": r"[0-9]{2}", "authoritative_drawing": r"as [a-z]{2,25} th",
            "pending_decision": r"(?i)que la|et les", "liability": r"er[a-z]{2,12}nd"}


@query("STR-10", r"""
select doc_id, regexp_matches(text, '(?:the|der) [a-z]{0,6}(?:tion|sch)') as responsible_party, regexp_matches(text, '[0-9]{2}') as deadline, regexp_matches(text, 'as [a-z]{2,25} th') as authoritative_drawing,
  regexp_matches(text, '(?i)que la|et les') as pending_decision, regexp_matches(text, 'er[a-z]{2,12}nd') as liability, regexp_matches(text, 'worth|cost') as cost_consequence from documents""")
def closure_signals(spark, d):
    return read_table(spark, d, "documents").select("doc_id", *S.closure(F.col("text"), CLOSURES, r"worth|cost"))


@query("STR-11", r"""
with t as (select doc_id, case when doc_id % 5 = 0 then '[MAY] ' || text else text end as t, quality from documents left join labels using (doc_id)),
l as (select doc_id, quality, case when regexp_matches(t, '^\s*\[MAY\]') then 'MAY' when regexp_matches(t, 'nicht|never') then 'MUST_NOT' when regexp_matches(t, 'there|mente') then 'MUST' when regexp_matches(t, 'the ') then 'SHOULD' when regexp_matches(t, 'que ') then 'MAY' else 'SHOULD' end as lv from t)
select doc_id, case when coalesce(quality = 1, false) and lv not in ('MUST', 'MUST_NOT') then 'MUST' else lv end as level from l""")
def obligation_level(spark, d):
    modal = (("MUST_NOT", "nicht|never"), ("MUST", "there|mente"), ("SHOULD", "the "), ("MAY", "que "))
    rows = read_table(spark, d, "documents").join(read_table(spark, d, "labels"), "doc_id", "left")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("[MAY] "), F.col("text"))).otherwise(F.col("text"))
    return rows.select("doc_id", S.obligation(text, F.col("quality") == 1, modal).alias("level"))


@query("STR-12", r"""
with t as (select doc_id, case when doc_id % 11 = 0 then '' when doc_id % 11 = 1 then repeat('(cid:12)', (n_chars // (10 + doc_id % 13))::int) || text when doc_id % 11 = 2 then repeat(chr(57600), (n_chars // (2 + doc_id % 2))::int) || text else text end as t from documents),
m as (select doc_id, t, length(t) as n, length(t) - length(regexp_replace(t, '[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{3400}-\x{4dbf}\x{e000}-\x{f8ff}\x{fffd}\x{f0000}-\x{10fffd}]', '', 'g')) as bad, length(t) - length(regexp_replace(t, '\(cid:\d+\)', '', 'g')) as cid from t)
select doc_id, n::bigint as length, round(coalesce(bad / nullif(n, 0), 0), 3) as bad_ratio, round(coalesce(cid / nullif(n, 0), 0), 3) as cid_ratio,
  case when regexp_replace(t, '\s+', '', 'g') = '' then 'empty' when cid / n > 0.3 or case when n < 8 then bad > 0 else bad / n > 0.3 end then 'mojibake' else 'ok' end as verdict from m""")
def text_integrity(spark, d):
    k = F.col("doc_id") % 11
    text = (F.when(k == 0, "").when(k == 1, F.concat(F.expr("repeat('(cid:12)', int(n_chars div (10 + doc_id % 13)))"), "text"))
            .when(k == 2, F.concat(F.expr("repeat('', int(n_chars div (2 + doc_id % 2)))"), "text")).otherwise(F.col("text")))
    return read_table(spark, d, "documents").select("doc_id", S.integrity(text).alias("i")).select("doc_id", "i.*")


@query("STR-13", """
select o_orderkey, case o_orderpriority when '1-URGENT' then 'urgent' when '5-LOW' then 'low' else o_orderpriority end as corrected,
  replace(replace(o_orderpriority, 'NOT SPECIFIED', 'none'), 'E', 'e') as text from orders""")
def apply_corrections(spark, d):
    rows = S.correct(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", [("1-URGENT", "urgent"), ("5-LOW", "low")])
    text = S.correct_text(F.col("o_orderpriority"), [("E", "e"), ("NOT SPECIFIED", "none")])
    return rows.select("o_orderkey", "corrected", text.alias("text"))


@query("STR-14", """
select o_orderkey, 'order ' || o_orderkey || ' is ' || coalesce(case when o_orderstatus <> 'P' then o_orderstatus end, '') || '.' as message, 'see {drawing_no} of {o_orderkey}' as kept from orders""")
def message_format(spark, d):
    rows = read_table(spark, d, "orders").withColumn("state", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    rows = rows.withColumn("number", F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", fmt(rows, "order {number} is {state}.").alias("message"), fmt(rows, "see {drawing_no} of {o_orderkey}").alias("kept"))


@query("DAT-01", """
select event_type, count(*) filter (where ts >= timestamp '2024-01-01') as this_year, count(*) filter (where ts >= timestamp '2024-01-20 12:00:00' - interval 7 day) as last_week, count(distinct strftime(ts, '%Y-%m-%d')) as days from events group by 1""")
def period_filters(spark, d):
    ts, now = F.col("ts"), "2024-01-20 12:00:00"
    return read_table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(D.this_year(ts, now)).alias("this_year"), F.count_if(D.last_days(ts, now, 7)).alias("last_week"), F.count_distinct(D.day_key(ts)).alias("days"))


@query("DAT-02", """
select event_id from events where event_type <> 'purchase' and epoch_us(timestamp '2024-01-20') - epoch_us(ts) > 6.5 * 3600000000""")
def staleness(spark, d):
    return read_table(spark, d, "events").where(D.stale(F.col("ts"), F.col("event_type") != "purchase", "2024-01-20", 6.5)).select("event_id")


@query("DAT-03", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate + interval 30 day <= timestamp '1998-06-01'")
def expiry(spark, d):
    ends = F.col("o_orderdate") + F.make_interval(days=F.lit(30))
    return read_table(spark, d, "orders").where(D.expired(ends, F.col("o_orderstatus") == "O", "1998-06-01")).select("o_orderkey")


@query("DAT-04", """
select user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1) as seconds, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 2) as hours from events group by 1""")
def duration_units(spark, d):
    spans = read_table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", D.seconds_between(F.col("a"), F.col("b")).alias("seconds"), D.hours_between(F.col("a"), F.col("b")).alias("hours"))


@query("MTH-01", """
with p as (select o_orderkey, o_totalprice::decimal(18,2) as s, round(o_totalprice::decimal(18,2) * 0.15::decimal(4,2), 2)::decimal(18,2) as pool from orders where o_totalprice > 0),
t as (select *, round(pool * 0.50::decimal(4,2), 2)::decimal(18,2) as team, round(pool * 0.30::decimal(4,2), 2)::decimal(18,2) as prop from p)
select o_orderkey, pool::double as bonus_pool, team::double as team_pool, prop::double as proposer_amount, (pool - team - prop)::double as group_amount from t""")
def bonus_split(spark, d):
    out = M.split_bonus(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return out.select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("bonus_pool", "team_pool", "proposer_amount", "group_amount")])


@query("MTH-02", """
with t(steel, fy, alpha) as (values ('HPB300', 270e0, 0.16::double), ('HRB400', 400e0, 0.14::double), ('HRB500', 500e0, 0.14::double)),
c(concrete, ft) as (values ('C20', 1.10::double), ('C30', 1.43::double), ('C45', 1.80::double)),
p as (select p_partkey, p_size as d, case p_partkey % 3 when 0 then 'HPB300' when 1 then 'HRB400' else 'HRB500' end as steel, case p_size % 3 when 0 then 'C20' when 1 then 'C30' else 'C45' end as concrete, p_partkey % 4 + 1 as seismic from part),
r as (select *, alpha * (fy / ft) * d as raw, case seismic when 3 then 1.05::double when 4 then 1 else 1.15::double end as z from p join t using (steel) join c using (concrete)),
l as (select *, greatest(ceil(raw / 5) * 5, 200)::bigint as la, greatest(ceil(z * raw / 5) * 5, 250)::bigint as lae from r)
select p_partkey, la, lae, (ceil(1.2::double * case when seismic <= 3 then lae else la end / 5) * 5)::bigint as ll_25, (ceil(1.4::double * case when seismic <= 3 then lae else la end / 5) * 5)::bigint as ll_50, (ceil(1.6::double * case when seismic <= 3 then lae else la end / 5) * 5)::bigint as ll_100 from l""")
def anchor_length(spark, d):
    k, s = F.col("p_partkey") % 3, F.col("p_size") % 3
    rows = read_table(spark, d, "part").select(
        "p_partkey", F.col("p_size").alias("diameter"), F.when(k == 0, "HPB300").when(k == 1, "HRB400").otherwise("HRB500").alias("steel"),
        F.when(s == 0, "C20").when(s == 1, "C30").otherwise("C45").alias("concrete"), (F.col("p_partkey") % 4 + 1).cast("int").alias("seismic"))
    return M.anchor_lengths(rows, "diameter", "steel", "concrete", "seismic").select("p_partkey", "la", "lae", "ll_25", "ll_50", "ll_100")


@query("MTH-03", """
with e as (select vec_id, embedding::double[] as e from embeddings), p as (select vec_id, e, unnest(range(1, 32)) as i from e),
s as (select vec_id, e[2*i-1] as x, e[2*i] as y, e[2*(i%31)+1] as nx, e[2*(i%31)+2] as ny from p)
select vec_id, round(abs(sum(x * ny - nx * y)) / 2, 6) as area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 6) as perimeter, round(min(x), 6) as x0, round(max(y), 6) as y1 from s group by 1""")
def polygon_measures(spark, d):
    points = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.struct(
        F.element_at("embedding", (2 * i - 1).cast("int")).cast("double").alias("x"), F.element_at("embedding", (2 * i).cast("int")).cast("double").alias("y")))
    rows = read_table(spark, d, "embeddings").select("vec_id", M.polygon(points).alias("p"))
    return rows.select("vec_id", *[F.round(f"p.{c}", 6).alias(c) for c in ("area", "perimeter", "x0", "y1")])


@query("MTH-03", """
with v as (select l_linestatus, l_linenumber % 4 as k, l_quantity as a, l_extendedprice / 1000 as len, l_tax as t from lineitem),
g as (select l_linestatus, case k when 0 then 'column' when 1 then 'wall' when 2 then 'beam' else 'slab' end as kind,
  case k when 0 then a * 3 when 1 then len * case when t > 0.04::double then t else 0.2::double end * 3 when 2 then len * case when t > 0.04::double then t else 0.3::double end * 0.6::double else a * 0.12::double end as gross,
  case k when 0 then 20 * 3 when 1 then 2 * len * 3 when 2 then (2 * 0.6::double + case when t > 0.04::double then t else 0.3::double end) * len else a + 20 * 0.12::double end as contact from v)
select l_linestatus, kind, count(*) as n, round(sum(gross), 4) as gross, round(sum(contact), 4) as contact from g group by 1, 2""")
def element_volumes(spark, d):
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "column").when(k == 1, "wall").when(k == 2, "beam").otherwise("slab")
    width = F.when(F.col("l_tax") > 0.04, F.col("l_tax"))
    v = M.volumes(kind, F.col("l_quantity"), F.lit(20.0), F.col("l_extendedprice") / 1000, width, F.lit(None).cast("double"), F.lit(3.0))
    return (read_table(spark, d, "lineitem").select("l_linestatus", kind.alias("kind"), v.alias("v")).groupBy("l_linestatus", "kind")
            .agg(F.count("*").alias("n"), F.round(F.sum("v.gross"), 4).alias("gross"), F.round(F.sum("v.contact"), 4).alias("contact")))


@query("MTH-04", """
with t as (select s_suppkey, 0.01::double + s_nationkey * 0.001::double as sc, s_acctbal / 100 as ox, s_nationkey * 3 as oy from supplier),
m as (select l_suppkey, round((l_extendedprice / 90 - ox) * sc, 3) as x, round((841 - l_quantity - oy) * sc, 3) as y from lineitem join t on s_suppkey = l_suppkey)
select l_suppkey, count(*) as n, round(sum(x), 3) as sx, round(sum(y), 3) as sy from m group by 1""")
def affine_apply(spark, d):
    t = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (0.01 + F.col("s_nationkey") * 0.001).alias("sc"),
                                                (F.col("s_acctbal") / 100).alias("ox"), (F.col("s_nationkey") * 3).alias("oy"))
    rows = read_table(spark, d, "lineitem").join(t, "l_suppkey")
    met = rows.select("l_suppkey", *M.to_meters(F.col("l_extendedprice") / 90, F.col("l_quantity"), F.col("sc"), F.col("ox"), F.col("oy"), F.lit(841)))
    return met.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("x_m"), 3).alias("sx"), F.round(F.sum("y_m"), 3).alias("sy"))


@query("MTH-05", """
with s as (select unnest([0.20,0.25,0.30,0.35,0.40,0.45,0.50,0.55,0.60,0.65,0.70,0.75,0.80,0.90,1.00,1.10,1.20,1.30,1.40,1.50,1.60,1.80,2.00]::double[]) as s),
v as (select l_orderkey, l_partkey, l_linenumber, l_extendedprice / 43000 as v from lineitem), d as (select distinct v from v),
n as (select v, (select struct_pack(g := abs(s - v), s := s) from s order by abs(s - v), s limit 1) as b, round_even(v / 0.05::double, 0) * 0.05::double as st from d),
r as (select v, case when v <= 0 then v when b.g <= 0.03::double then round(b.s, 3) when st > 0 and abs(st - v) <= 0.03::double then round(st, 3) else v end as value, v > 0 and (b.g <= 0.03::double or st > 0 and abs(st - v) <= 0.03::double) as snapped from n)
select snapped, round(case when snapped then value end, 3) as size, count(*) as n from v join r using (v) group by 1, 2""")
def module_snap(spark, d):
    rows = read_table(spark, d, "lineitem").select(M.snap(F.col("l_extendedprice") / 43000).alias("s"))
    return rows.groupBy("s.snapped", F.round(F.when(F.col("s.snapped"), F.col("s.value")), 3).alias("size")).agg(F.count("*").alias("n"))


@query("MTH-06", """
with b as (select l_orderkey, l_quantity as ax0, l_linenumber as ay0, l_quantity + 10 as ax1, l_linenumber + l_discount * 50 as ay1, l_quantity + l_tax * 100 - 4 as bx0, l_linenumber + 1 as by0, l_quantity + 9 as bx1, l_linenumber + 4 as by1 from lineitem),
i as (select *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0) as inter from b),
u as (select l_orderkey, inter, greatest(ax1 - ax0, 0) * greatest(ay1 - ay0, 0) + greatest(bx1 - bx0, 0) * greatest(by1 - by0, 0) - inter as un from i)
select l_orderkey, round(max(case when un > 0 then inter / un else 0 end), 6) as best_iou from u group by 1""")
def iou_column(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    boxes = read_table(spark, d, "lineitem").select(
        "l_orderkey", q.alias("ax0"), n.alias("ay0"), (q + 10).alias("ax1"), (n + F.col("l_discount") * 50).alias("ay1"),
        (q + F.col("l_tax") * 100 - 4).alias("bx0"), (n + 1).alias("by0"), (q + 9).alias("bx1"), (n + 4).alias("by1"))
    score = iou(["ax0", "ay0", "ax1", "ay1"], ["bx0", "by0", "bx1", "by1"])
    return boxes.groupBy("l_orderkey").agg(F.round(F.max(score), 6).alias("best_iou"))


@query("MTH-07", """
select l_returnflag, round(sum(l_extendedprice / 1000000 * p_retailprice + l_quantity * 100 / 1000000 * p_size), 4) as cost from lineitem join part on p_partkey = l_partkey group by 1""")
def call_cost(spark, d):
    rows = read_table(spark, d, "lineitem").join(read_table(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    cost = M.call_cost(F.col("l_extendedprice"), F.col("l_quantity") * 100, F.col("p_retailprice"), F.col("p_size"))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum(cost), 4).alias("cost"))


@query("ARR-01", """
with p as (select event_id, case when event_type = 'error' then '{broken' when event_type = 'view' then '[1, 2]' when event_type <> 'signup' then props end as j from events)
select event_id, case when j like '{"k%' then json_extract(j, '$.k')::bigint else -1 end as k from p""")
def json_safe(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "error", "{broken").when(kind == "view", "[1, 2]").when(kind != "signup", F.col("props"))
    value = A.json_or(raw, "struct<k:long>", F.struct(F.lit(-1).cast("long").alias("k")))
    return read_table(spark, d, "events").select("event_id", value.alias("v")).select("event_id", "v.k")


@query("ARR-02", """
select doc_id, len(string_split(text, chr(10)))::int as lines_count, 0 as gone_count from documents""")
def json_sizes(spark, d):
    rows = read_table(spark, d, "documents").select("doc_id", F.to_json(F.split("text", "\n")).alias("lines"), F.lit(None).cast("string").alias("gone"))
    return rows.select("doc_id", *A.sizes("lines", "gone"))


@query("ARR-03", """
select event_id, json_extract(m, '$.k')::bigint as k, json_extract_string(m, '$.t') as t, json_extract(m, '$.u')::bigint as u
from (select event_id, json_merge_patch(props, case when event_type = 'view' then '{"k": ' || user_id || ', "t": "seen"}' else '{"u": ' || user_id || '}' end) as m from events)""")
def json_merge(spark, d):
    delta = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.col("user_id").alias("k"), F.lit("seen").alias("t")))).otherwise(F.to_json(F.struct(F.col("user_id").alias("u"))))
    rows = read_table(spark, d, "events").select("event_id", A.patch(F.col("props"), delta).alias("m"))
    get = lambda f: F.get_json_object("m", f"$.{f}")
    return rows.select("event_id", get("k").cast("long").alias("k"), get("t").alias("t"), get("u").cast("long").alias("u"))


@query("ARR-04", """
with l as (select source, doc_id, trim(line) as t from (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents)),
f as (select source, t, min(doc_id) as s from l where t <> '' group by 1, 2),
r as (select *, row_number() over (partition by source order by s, t) as n from f)
select source, string_agg(substr(t, 1, 40), ';' order by n) as samples from r where n <= 5 group by 1""")
def sample_lists(spark, d):
    lines = read_table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return A.samples(lines, ["source"], "line", "doc_id", 5, 40).withColumn("samples", F.array_join("samples", ";"))


@query("ARR-05", """
with w as (select doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') as words from documents)
select doc_id, array_to_string(words, '_') as words, len(words)::bigint as n from w""")
def explode_codes(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    rows = A.explode_keep(read_table(spark, d, "documents").select("doc_id", words.alias("codes")), "codes", "code")
    back = A.collect_keep(rows, ["doc_id"], "pos", "code", "codes")
    return back.select("doc_id", F.array_join("codes", "_").alias("words"), F.size("codes").cast("long").alias("n"))


@query("ARR-06", """
with c as (select l_orderkey, l_linenumber // 4 as page, string_agg(l_linenumber || ':' || l_partkey || ':' || l_quantity::int, ',' order by l_linenumber, l_partkey, l_quantity) as children, count(*) as listed from lineitem group by 1, 2)
select o_orderkey, coalesce(page, 0)::bigint as page, coalesce(children, '') as children, coalesce(listed, 0) as listed from orders left join c on l_orderkey = o_orderkey""")
def nest_children(spark, d):
    children = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    out = A.nest(read_table(spark, d, "orders").select("o_orderkey"), children, "o_orderkey", "l_linenumber", ["l_partkey", "q"], 4)
    shown = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string"), c["q"].cast("string"))), ",")
    return out.select("o_orderkey", "page", shown.alias("children"), "listed")


@query("ARR-06", "select count(*) as unlisted from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def nest_unlisted(spark, d):
    parents = read_table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.unlisted(parents, read_table(spark, d, "lineitem"), "l_orderkey")
