"""Suggestions learned from human corrections (AGG evidence operators).

Events: ``kind``, ``human_value``, ``auto_value``, ``context`` (JSON), ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Evidence needed, samples shown, hand-drawn share, slack on the span.
MIN_EVIDENCE, MAX_SAMPLES, HANDDRAWN_SHARE, SPAN_SLACK, DEFAULT_SPAN = 3, 5, 0.4, 0.9, 0.15


def _blank(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) == ""


def new_vocabulary(events: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """Words people enter where the system has none, with the first few raw texts."""
    rows = events.where((F.col("kind") == "discipline") & ~_blank(F.col("human_value")) & _blank(F.col("auto_value"))).select(
        F.trim("human_value").alias("word"), "event_id", F.trim(F.get_json_object("context", "$.raw_text")).alias("raw"))
    counts = rows.groupBy("word").agg(F.count("*").alias("times")).where(F.col("times") >= min_evidence)
    rank = F.row_number().over(W.partitionBy("word").orderBy("event_id"))
    shown = (rows.where(~_blank(F.col("raw"))).withColumn("_r", rank).where(F.col("_r") <= MAX_SAMPLES)
             .groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "raw"))), lambda s: s["raw"]).alias("samples")))
    return counts.join(shown, "word", "left").select(
        "word", "times", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        F.round(F.least(F.lit(0.5) + F.col("times") * 0.1, F.lit(0.95)), 4).alias("confidence"))


def corrections(events: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """Stable (raw → corrected) pairs."""
    raw, human = F.trim(F.get_json_object("context", "$.raw_text")), F.trim("human_value")
    return (events.select(raw.alias("raw"), human.alias("corrected")).where(
        ~_blank(F.col("raw")) & ~_blank(F.col("corrected")) & (F.col("raw") != F.col("corrected")))
        .groupBy("raw", "corrected").agg(F.count("*").alias("times")).where(F.col("times") >= min_evidence)
        .withColumn("confidence", F.round(F.least(F.lit(0.4) + F.col("times") * 0.12, F.lit(0.9)), 4)))


def span_hint(events: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """Many hand-drawn axes: suggest a smaller minimum span (at most one row)."""
    hand = F.get_json_object("context", "$.source") == "handdrawn"
    span = F.get_json_object("context", "$.span").try_cast("double")
    stats = events.where("kind = 'axis'").agg(
        F.count("*").alias("total"), F.count_if(hand).alias("handdrawn"), F.min(F.when(hand, span)).alias("_span"))
    share = F.col("handdrawn") / F.col("total")
    return stats.where((F.col("total") >= min_evidence) & (F.col("handdrawn") > 0) & (share >= HANDDRAWN_SHARE)).select(
        F.lit("threshold").alias("kind"), F.lit("min_span").alias("target"), F.col("handdrawn").alias("impact"),
        F.coalesce(F.round(F.col("_span") * SPAN_SLACK, 3), F.lit(DEFAULT_SPAN)).alias("value"),
        F.round(F.least(F.lit(0.4) + share * 0.5, F.lit(0.9)), 4).alias("confidence"))


def template_gaps(events: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """Page layouts that still need a manual box, twice the usual evidence."""
    aspect = F.get_json_object("context", "$.page_aspect")
    return (events.where("kind = 'title_block'").select(aspect.alias("target")).where("target is not null")
            .groupBy("target").agg(F.count("*").alias("impact")).where(F.col("impact") >= 2 * min_evidence)
            .select(F.lit("algorithm").alias("kind"), F.concat(F.lit("layout "), F.col("target")).alias("target"), "impact",
                    F.lit(None).cast("double").alias("value"), F.lit(0.7).alias("confidence")))


def scale_disagreement(events: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    """Confirmed scales that differ from the automatic ones (at most one row)."""
    off = (F.col("kind") == "scale") & ~_blank(F.col("auto_value")) & ~_blank(F.col("human_value")) & (
        F.col("auto_value") != F.col("human_value"))
    return events.agg(F.count_if(off).alias("impact")).where(F.col("impact") >= min_evidence).select(
        F.lit("algorithm").alias("kind"), F.lit("scale").alias("target"), "impact", F.lit(None).cast("double").alias("value"),
        F.lit(0.6).alias("confidence"))


def threshold_hints(events: DataFrame, min_evidence: int = MIN_EVIDENCE) -> DataFrame:
    return (span_hint(events, min_evidence).unionByName(template_gaps(events, min_evidence))
            .unionByName(scale_disagreement(events, min_evidence)))
