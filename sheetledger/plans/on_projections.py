"""Projections, filters and predicates bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as P
from ..operators.common import literal_table
from ..sources.tables import read_table
from .catalog import query

# Severity words an order priority stands for.
PRIORITY_SEVERITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
PRIORITY_CASE = ("case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' "
                 "when '3-MEDIUM' then 'medium' else 'low' end")


@query("PRJ-01", """
select o_orderkey, o_orderstatus, o_orderpriority from orders
where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')""")
def optional_filters(spark, d):
    return P.where_all(read_table(spark, d, "orders"), o_orderstatus="F", o_custkey=None,
                       o_orderpriority=["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("PRJ-02", """
select doc_id from documents where text ilike '%THERE%' or source ilike '%THERE%' or lang ilike '%THERE%'""")
def multi_col_search(spark, d):
    return P.search(read_table(spark, d, "documents"), "THERE", ["text", "source", "lang"]).select("doc_id")


@query("PRJ-03", f"select o_orderkey, {PRIORITY_CASE} as severity from orders")
def value_map(spark, d):
    return read_table(spark, d, "orders").select(
        "o_orderkey", P.map_values(F.col("o_orderpriority"), PRIORITY_SEVERITY, "low").alias("severity"))


@query("PRJ-04", """
select case when l_tax > 0.07 then 'high' when l_returnflag = 'N' then 'medium'
            when l_discount * 10 < 0.5 then 'high' when l_discount * 10 < 0.8 then 'medium' else 'low' end as severity,
       count(*) as n from lineitem group by 1""")
def confidence_bucket(spark, d):
    conf = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)
    return (read_table(spark, d, "lineitem")
            .groupBy(P.severity_of(conf, F.col("l_tax") > 0.07).alias("severity")).agg(F.count("*").alias("n")))


# Literal rule set in the shape of a rule file.
RULES = [
    {"id": "T-001", "severity": "major", "category": "meta", "condition":
        {"type": "regex", "field": "source", "pattern": "^src1\\d$", "negate": True},
     "message": "source {source} is not in the second ten", "regulation_ref": "R 3.2"},
    {"id": "T-002", "severity": "critical", "category": "text", "condition":
        {"type": "regex", "field": "text", "pattern": "^the ", "negate": False}, "message": "line starts with the"},
    {"id": "T-003", "severity": "minor", "category": "meta", "condition":
        {"type": "not_in", "field": "lang", "values": ["en", "fr", "de"]}, "message": "language {lang} {unknown}"},
    {"id": "T-004", "severity": "info", "category": "text", "condition": {"type": "and", "conditions": [
        {"type": "contains", "field": "text", "value": "HERE"}, {"type": "gte", "field": "n_chars", "value": 900}]},
     "message": "{n_chars} characters in {lang}", "suggestion": "split {source}"},
    {"id": "T-005", "severity": "major", "category": "text", "condition": {"type": "or", "conditions": [
        {"type": "lt", "field": "n_chars", "value": 60}, {"type": "eq", "field": "source", "value": "src3"},
        {"type": "contains", "field": "text", "value": "Is ", "case_sensitive": True}]}, "message": "short or src3"},
    {"id": "T-006", "severity": "odd", "category": "meta", "condition": {"type": "empty", "field": "title"},
     "message": "no title"},
    {"id": "T-007", "severity": "info", "category": "meta", "condition": {"type": "unheard of"}, "message": "never"},
]


@query("PRJ-05", r"""
select doc_id, 'T-001' as rule_id, 'major' as severity, 'source ' || source || ' is not in the second ten' as message, '' as suggestion
  from documents where not regexp_matches(source, '(?im)^src1\d$')
union all select doc_id, 'T-002', 'critical', 'line starts with the', '' from documents where regexp_matches(text, '(?im)^the ')
union all select doc_id, 'T-003', 'minor', 'language {lang} {unknown}', '' from documents where lang not in ('en', 'fr', 'de')
union all select doc_id, 'T-004', 'info', n_chars || ' characters in ' || lang, 'split ' || source from documents
  where contains(lower(text), 'here') and n_chars >= 900
union all select doc_id, 'T-005', 'major', 'short or src3', '' from documents
  where n_chars < 60 or source = 'src3' or contains(text, 'Is ')
union all select doc_id, 'T-006', 'info', 'no title', '' from documents""")
def rule_dsl(spark, d):
    return (P.apply_rules(read_table(spark, d, "documents"), RULES, ["doc_id"])
            .select("doc_id", "rule_id", "severity", "message", "suggestion"))


@query("PRJ-06", """
select doc_id from documents
where (lang = 'en' or lang = 'fr') and (contains(text, 'there') or contains(text, 'tion le'))""")
def saving_flag(spark, d):
    severity = F.when(F.col("lang") == "en", "critical").when(F.col("lang") == "fr", "high").otherwise("low")
    return (read_table(spark, d, "documents")
            .where(P.has_saving(severity, F.col("text"), ["there", "tion le"])).select("doc_id"))


@query("PRJ-07", """
select case when p_size > 25 then p_brand else p_type end as label, count(*) as n from part group by 1""")
def label_fallback(spark, d):
    fine = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return (read_table(spark, d, "part").groupBy(P.coalesce_label(fine, F.col("p_type")).alias("label"))
            .agg(F.count("*").alias("n")))


@query("PRJ-08", """
with t as (select *, l_quantity / 1000 as scale, case when l_returnflag <> 'N' then l_discount * 10 end as conf from lineitem)
select l_linestatus, count(*) as n from t
where coalesce(scale / (0.0254::double / 72) between 1 and 100, false) and coalesce(conf >= 0.5, false) group by 1""")
def scale_trust_gate(spark, d):
    conf = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)
    return (read_table(spark, d, "lineitem").where(P.trusted(F.col("l_quantity") / 1000, conf, 1, 100))
            .groupBy("l_linestatus").agg(F.count("*").alias("n")))


@query("PRJ-09", """
select l_returnflag, coalesce(l_quantity between 2.2 and 12, false) as plausible, count(*) as n from lineitem group by 1, 2""")
def plausible_range(spark, d):
    return (read_table(spark, d, "lineitem")
            .groupBy("l_returnflag", P.in_range(F.col("l_quantity"), 2.2, 12).alias("plausible"))
            .agg(F.count("*").alias("n")))


@query("PRJ-10", """
select l_returnflag, count(*) filter (where l_discount >= 0.06::double) as kept,
  count(*) filter (where not l_discount >= 0.06::double) as dropped from lineitem group by 1""")
def confidence_threshold(spark, d):
    return P.min_conf_audit(read_table(spark, d, "lineitem"), ["l_returnflag"], 0.06, "l_discount")


@query("PRJ-11", """
select doc_id, case when n_chars = 0 then 'empty' when lang not in ('en', 'fr') then 'language'
  when contains(text, '|') then 'table' when n_chars < 300 then 'short' end as reason from documents""")
def skip_reason(spark, d):
    ladder = [("empty", F.col("n_chars") == 0), ("language", ~F.col("lang").isin("en", "fr")),
              ("table", F.col("text").contains("|")), ("short", F.col("n_chars") < 300)]
    return P.with_reason(read_table(spark, d, "documents"), ladder).select("doc_id", "reason")


@query("PRJ-12", """
with first_layer as (select l_partkey, max(l_quantity) as height, max(l_linenumber) as width, count(*) as samples,
    coalesce(bool_and(case when l_quantity > 45 then l_returnflag = 'N' end), false) as estimated from lineitem group by 1)
select l_partkey, case when estimated and p_size >= 10 then p_retailprice else height end as height,
  case when estimated and p_size >= 10 then p_size else width end as width,
  case when estimated and p_size >= 10 then 'secondary' else 'primary' end as layer
from first_layer left join part on p_partkey = l_partkey""")
def layered_fill(spark, d):
    first = (read_table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.max("l_quantity").alias("height"), F.max("l_linenumber").alias("width"),
        F.coalesce(F.bool_and(F.when(F.col("l_quantity") > 45, F.col("l_returnflag") == "N")), F.lit(False)).alias("estimated")))
    second = read_table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("height"), F.col("p_size").alias("width"))
    return (P.fill_from(first, second, ["l_partkey"], ["height", "width"], F.col("estimated"), F.col("width") >= 10)
            .drop("estimated"))


@query("PRJ-13", """
with own as (select c_nationkey as project_id, c_mktsegment as key, max(c_acctbal) as value from customer
             where c_acctbal > 9500 group by 1, 2),
shared as (select c_mktsegment as key, min(c_acctbal) as value from customer where c_mktsegment < 'H' group by 1),
def as (select distinct c_mktsegment as key from customer where c_mktsegment <> 'BUILDING' union all select 'OTHER')
select n_nationkey as project_id, d.key, coalesce(o.value, g.value, 1) as value,
  case when o.value is not null then 'project' when g.value is not null then 'global' else 'default' end as scope
from nation cross join def d left join own o on o.project_id = n_nationkey and o.key = d.key left join shared g on g.key = d.key""")
def scoped_override(spark, d):
    customer = read_table(spark, d, "customer")
    own = (customer.where("c_acctbal > 9500")
           .groupBy(F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("key"))
           .agg(F.max("c_acctbal").alias("value")))
    shared = (customer.where("c_mktsegment < 'H'").groupBy(F.col("c_mktsegment").alias("key"))
              .agg(F.min("c_acctbal").alias("value")).withColumn("project_id", F.lit(None).cast("int")))
    defaults = literal_table(spark, [(k, 1.0) for k in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER")],
                             "key string, value double")
    projects = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"))
    return P.resolve_params(projects, own.unionByName(shared), defaults)
