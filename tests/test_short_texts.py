"""Kinds of short texts and propagated zone labels, by literal rows."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sheetledger.functions.strings import parse_measures
from sheetledger.operators.joins import match_gaps, propagate_zones

# Texts with the kinds and values that must come out.
KINDS = [
    ("±0.000", "elevation", 0.0), ("+3.600", "elevation", 3.6), ("-1.500", "elevation", -1.5), ("标高10.800", "elevation", 10.8), ("建筑标高±0.000", "elevation", 0.0),
    ("33.330标高钢桁架轮廓", "note", None), ("窗顶标高43.100，窗底标高42.350", "note", None), ("窗底标高：34250", "note", None),
    ("地下二层", "level_name", None), ("首层", "level_name", None), ("4F", "level_name", None), ("b1", "level_name", None), ("RF", "level_name", None), ("小剧厅B1", "level_name", None),
    ("大剧厅屋顶层", "level_name", None), ("6F（设备层）", "level_name", None), ("2层12mm厚不", "note", None), ("3一层防火分区图", "note", None), ("一层平面图", "title", None),
    ("图", "title_block_label", None), ("东", "other", None), ("审核：", "title_block_label", None), ("PROJECT:", "title_block_label", None), ("Drawing  No.", "title_block_label", None),
    ("A", "axis", None), ("12", "axis", None), ("1/A", "axis", None), ("3600", "dimension", 3600.0), ("DN100", "pipe_diameter", 100.0), ("d25mm", "pipe_diameter", 25.0),
    ("20厚水泥砂浆", "construction_layer", 20.0), ("预制板斜墙100厚", "construction_layer", 100.0), ("1:100", "scale", 100.0), ("h=120", "thickness", 120.0),
    ("男卫", "room_name", None), ("这是一段比较长的说明文字", "title", None), ("这是一段比较长的普通文字", "note", None), ("KL1", "component_mark", None), ("", "other", None), (None, "other", None), ("x1y2", "other", None)]


def test_kinds_of_short_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(KINDS)], "i int, t string")
    got = {r["i"]: (r["m"]["kind"], r["m"]["value"]) for r in df.select("i", parse_measures(F.col("t")).alias("m")).collect()}
    assert {KINDS[i][0]: v for i, v in got.items()} == {t: (k, v) for t, k, v in KINDS}


# An anchor's gaps and how far a ratio may lie from 1.
ANCHOR = [8.4, 6.0, 7.2, 9.3, 5.1, 4.4, 8.8]


def zones(spark, sequences, anchors, **more):
    cands = spark.createDataFrame([(f"d{i}", 0, s) for i, s in enumerate(sequences)], "drawing_id string, zone_index int, gaps array<double>")
    known = spark.createDataFrame([(n, 0, "x", label, s) for n, label, s in anchors], "drawing_id string, zone_index int, direction string, zone_label string, gaps array<double>")
    return {r["drawing_id"]: r for r in propagate_zones(cands, known, **more).collect()}


def test_zone_labels_spread_with_a_review_mark(spark):
    one = [("a", " 3 ", ANCHOR)]
    got = zones(spark, [ANCHOR, [g * 1.015 for g in ANCHOR], [g * 1.04 for g in ANCHOR], [14.4, 7.2, 9.3, 5.1, 4.4], ANCHOR[:4]], one)
    assert sorted(got) == ["d0", "d1", "d3"]
    assert (got["d0"]["zone_label"], got["d0"]["anchor_drawing_id"], got["d0"]["scale_ratio"], got["d0"]["needs_review"]) == ("3", "a", 1.0, False)
    assert got["d1"]["scale_ratio"] == pytest.approx(1.015) and got["d1"]["needs_review"]
    shared = ANCHOR[:5]
    assert zones(spark, [shared], [("a", "1", [3.0, *shared]), ("b", "2", [11.0, *shared])]) == {}
    assert zones(spark, [ANCHOR], [("d0", "1", ANCHOR)]) == {}
    confirmed = spark.createDataFrame([("d0", 0)], "drawing_id string, zone_index int")
    assert zones(spark, [ANCHOR], one, confirmed=confirmed) == {}


def test_spans_tell_which_gaps_were_taken(spark):
    targets = spark.createDataFrame([(1, [14.4, 7.2, 9.3, 5.1, 13.2])], "target_id int, gaps array<double>")
    anchors = spark.createDataFrame([(7, [2.0, *ANCHOR])], "anchor_id int, gaps array<double>")
    assert rows(match_gaps(targets, anchors).select("start", "end", F.array_join("spans", ",").alias("s"), F.round("scale_ratio", 6).alias("r"))) == [(1, 8, "2,1,1,1,2", 1.0)]
