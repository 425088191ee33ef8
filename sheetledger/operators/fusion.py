"""Recalled candidates merged in their order: each joins the earliest group whose first candidate it matches."""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_written, shared_folder, write_down
from .common import null_safe_join
from .retrieval import ESCALATE
from .similarity import similar_texts

# How alike two texts must be, groups kept per recall.
SIMILAR_TEXT, MAX_GROUPS = 0.72, 20

_LEADER, _FOLLOWER, _LATER = 1, 2, 3  # the last: a follower whose leader is not known yet


def _states(nodes: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Per value of ``col``: the first leader and the first open candidate that has it."""
    return nodes.where(F.col(col) != "").groupBy(*keys, col).agg(
        F.min(F.when(F.col("_is") == _LEADER, F.col("_o"))).alias("_lead"), F.min(F.when(F.col("_is") == 0, F.col("_o"))).alias("_open"))


def _around(asking: DataFrame, nodes: DataFrame, links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates (keys, _o, _ref, _text) with the first leader and the first open one among those that they match.

    Similar texts are followed once per text of ``keys``, not per candidate.
    """
    texts = _states(nodes, keys, "_text")
    linked = texts.withColumnRenamed("_text", "_other").join(links, "_other").select(*keys, "_text", "_lead", "_open")
    by_text = texts.unionByName(linked).groupBy(*keys, "_text").agg(F.min("_lead").alias("_lead_t"), F.min("_open").alias("_open_t"))
    near = null_safe_join(null_safe_join(asking, _states(nodes, keys, "_ref"), [*keys, "_ref"], "left"), by_text, [*keys, "_text"], "left")
    return near.select(*keys, "_o", "_ref", "_text", F.least("_lead", "_lead_t").alias("_lead"), F.least("_open", "_open_t").alias("_open"))


def merge_candidates(rows: DataFrame, keys: Sequence[str], order: str, threshold: float = SIMILAR_TEXT, most: int | None = MAX_GROUPS) -> DataFrame:
    """keys, order, ref, snippet, severity, sources: candidates (ref, snippet, severity, source) merged per ``keys``, first come first kept.

    In ``order`` (unique within keys) each candidate joins the earliest group whose first candidate has the same, non-empty reference or
    a similar text (ratio of matching characters, later text against earlier one); else it opens a group.  A group keeps its first candidate's
    reference, text and severity and lists its sources in order of appearance, ``+`` between; two sources or more lift the severity by a step.  The first ``most`` groups
    of ``keys`` stay (all: None).  Null references and texts count as empty, and empty ones match nothing.

    Candidates that agree in reference and text are folded.  The rest is settled in rounds: who matches an earlier leader follows; who matches no
    earlier candidate that is a leader or still open leads.  References and texts meet through their first leader and first open candidate, so no
    pairs are made within a reference or a text; pairs of similar distinct texts come from ``similar_texts``.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    given = rows.select(*keys, F.col(order).alias("_at"), blank("ref").alias("_ref"), F.coalesce("snippet", F.lit("")).alias("_text"), "severity", "source")
    # what later steps ask of the rows: per candidate and source the first place, with its severity; then numbers in the order of all places
    # stand for the places, which may be wide
    alone = F.when((F.col("_ref") == "") & (F.col("_text") == ""), F.col("_at"))
    first = write_down(given.groupBy(*keys, "_ref", "_text", alone.alias("_alone"), "source").agg(F.min(F.struct("_at", "severity")).alias("_m")))
    told = write_down(first.select(*keys, "_ref", "_text", "source", "_m.*").orderBy("_at").withColumn("_n", F.monotonically_increasing_id()))
    drop_written(first)
    alone = F.when((F.col("_ref") == "") & (F.col("_text") == ""), F.col("_n"))
    nodes = write_down(told.groupBy(*keys, "_ref", "_text", alone.alias("_alone")).agg(F.min("_n").alias("_o"), F.collect_list(F.struct("_n", "source")).alias("_s")).drop("_alone"))
    texts = nodes.where("_text <> ''").select(F.col("_text").alias("text")).distinct()
    links = write_down(similar_texts(texts, texts, threshold).where("text_a <> text_b").select(F.col("text_a").alias("_text"), F.col("text_b").alias("_other")))
    # a round writes the candidates still open, and once those that it settles
    folder = f"{shared_folder(rows.sparkSession)}/settled-{uuid.uuid4().hex}"
    waiting = nodes.drop("_s").withColumns({"_is": F.lit(0), "_group": F.lit(None).cast("long")}).select(*keys, "_o", "_ref", "_text", "_is", "_group")
    read = lambda kind: rows.sparkSession.read.schema(waiting.schema).parquet(f"{folder}/{kind}")
    for kind in (_LEADER, _FOLLOWER, _LATER):
        waiting.limit(0).write.parquet(f"{folder}/{kind}")
    judged = None
    while not waiting.isEmpty():
        seen = _around(waiting.select(*keys, "_o", "_ref", "_text"), read(_LEADER).unionByName(waiting), links, keys)
        follows, leads = F.col("_lead") < F.col("_o"), F.coalesce(F.col("_open") >= F.col("_o"), F.lit(True))
        sure = F.coalesce(F.col("_open") > F.col("_lead"), F.lit(True))  # nothing that is still open can lead before its leader
        before, judged = judged, write_down(seen.select(
            *keys, "_o", "_ref", "_text", F.when(follows & sure, _FOLLOWER).when(follows, _LATER).when(leads, _LEADER).otherwise(0).alias("_is"), F.when(follows & sure, F.col("_lead")).alias("_group")))
        for kind in (_LEADER, _FOLLOWER, _LATER):
            judged.where(F.col("_is") == kind).write.mode("append").parquet(f"{folder}/{kind}")
        waiting = judged.where("_is = 0")
        if before is not None:
            drop_written(before)
    leaders, followers, later = read(_LEADER), read(_FOLLOWER), read(_LATER)
    found = _around(later.select(*keys, "_o", "_ref", "_text"), leaders, links, keys).select("_o", F.col("_lead").alias("_group"))
    named = leaders.select("_o", F.col("_o").alias("_group")).unionByName(followers.select("_o", "_group")).unionByName(found)
    source = named.join(nodes.select("_o", "_s"), "_o").select("_group", F.explode("_s").alias("_s")).groupBy("_group", "_s.source").agg(F.min("_s._n").alias("_n"))
    sources = write_down(source.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_n", "source"))).alias("_s")))
    out = told.withColumnRenamed("_n", "_group").drop("source").join(sources, "_group")  # one group per leader, told of under its number
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_group"))).where(F.col("_n") <= most)
    return out.select(*keys, F.col("_at").alias(order), F.col("_ref").alias("ref"), F.col("_text").alias("snippet"),
                      _lifted(F.col("severity"), F.size("_s") > 1).alias("severity"), F.array_join(F.transform("_s", lambda s: s["source"]), "+").alias("sources"))


def _lifted(severity: Column, when: Column) -> Column:
    up = severity
    for low, high in ESCALATE.items():
        up = F.when(when & (severity == low), F.lit(high)).otherwise(up)
    return up
