"""Pluggable surface bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggs import noisy_or
from ..operators import evidence as E
from ..plugins.registry import Registry, mock_model, nearest_rank, register_table_functions, with_model
from ..sources.tables import read_table
from .catalog import query
from .on_aggregates import _ANNOTATIONS, _annotations


@query("UDF-01", """
select 'short' as engine, doc_id, 'minor' as severity, 'only ' || n_chars || ' characters' as description from documents where n_chars < 300
union all select 'table', doc_id, 'info', 'holds a table' from documents where contains(text, '|')
union all select 'copy', d.doc_id, 'major', 'text occurs ' || n || ' times' from documents d join (select text, count(*) as n from documents group by 1 having count(*) > 1) c on c.text = d.text""")
def engine_plugins(spark, d):
    checks = Registry(["doc_id", "severity", "description"])
    make = lambda df, sev, text: df.select("doc_id", F.lit(sev).alias("severity"), text.alias("description"))
    checks.register("short", lambda docs: make(docs.where("n_chars < 300"), "minor", F.concat(F.lit("only "), F.col("n_chars").cast("string"), F.lit(" characters"))))
    checks.register("table", lambda docs: make(docs.where(F.col("text").contains("|")), "info", F.lit("holds a table")))

    @checks.register("copy")
    def copies(docs):
        keyed = docs.select("doc_id", F.md5("text").alias("_m"))
        counts = keyed.groupBy("_m").agg(F.count("*").alias("_n")).where("_n > 1")
        return make(keyed.join(counts, "_m"), "major", F.concat(F.lit("text occurs "), F.col("_n").cast("string"), F.lit(" times")))

    @checks.register("broken")
    def broken(docs):
        return docs.select("no_such_column")

    issues, _ = checks.run(read_table(spark, d, "documents"), "engine")
    return issues


@query("UDF-02", f"""
with {_ANNOTATIONS}
select 'corrections' as analyzer, 'ocr_correction' as kind, raw || '>' || human as target, count(*) as impact, round(least(0.4::double + count(*) * 0.12::double, 0.9::double), 4) as confidence from a group by raw, human having count(*) >= 3
union all select 'vocabulary', 'vocabulary', human, count(*), least(0.5::double + round(count(*) * 0.1::double, 4), 0.95::double) from a where kind = 'discipline' and auto is null group by human having count(*) >= 3""")
def analyzer_plugins(spark, d):
    analyzers = Registry(["kind", "target", "impact", "confidence"])
    analyzers.register("corrections", lambda e: E.corrections(e).select(
        F.lit("ocr_correction").alias("kind"), F.concat_ws(">", "raw", "corrected").alias("target"), F.col("times").alias("impact"), "confidence"))
    analyzers.register("vocabulary", lambda e: E.new_vocabulary(e).select(
        F.lit("vocabulary").alias("kind"), F.col("word").alias("target"), F.col("times").alias("impact"), "confidence"))
    analyzers.register("broken", lambda e: e.select("no_such_column"))
    return analyzers.run(_annotations(spark, d), "analyzer")[0]


@query("UDF-03")
def vector_backend(spark, d):
    return with_model(read_table(spark, d, "documents").select("doc_id", "text"), "text", mock_model).select("doc_id", "label")


@query("UDF-04")
def text_udtfs(spark, d):
    register_table_functions(spark)
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("select doc_id, s.idx, s.sentence from {docs}, lateral split_sentences(text) s", docs=docs)


@query("UDF-05", """
with s as (select l_partkey, l_quantity, l_discount, row_number() over (partition by l_partkey order by l_quantity) - 1 as rn, count(*) over (partition by l_partkey) as n from lineitem)
select l_partkey, round(1 - exp(sum(ln(1 - l_discount * 2))), 4) as confidence, max(case when rn = least(floor(n * 0.9::double), n - 1) then l_quantity end) as p90, max(case when rn = n // 2 then l_quantity end) as p50 from s group by 1""")
def custom_aggregates(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_partkey").agg(
        noisy_or(F.col("l_discount") * 2).alias("confidence"), nearest_rank("l_quantity", 0.9).alias("p90"), nearest_rank("l_quantity", 0.5).alias("p50"))
