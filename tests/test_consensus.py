"""Votes, consensus, assembly and evidence on the literal rows of the fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from sheetledger.functions.aggs import noisy_or
from sheetledger.operators import aggregates as A
from sheetledger.operators import assembly as B
from sheetledger.operators import consensus as C
from sheetledger.operators import evidence as E

from conftest import rows


def elevations(spark, by_drawing):
    return spark.createDataFrame([("F1", d, float(v)) for d, vs in by_drawing.items() for v in vs], "floor string, d string, v double")


@pytest.mark.parametrize("given, want", [
    ({"d1": [-4.2, 2.1], "d2": [-4.2, 9.9], "d3": [-4.2]}, (-4.2, 3)),
    ({"d1": [7.5, 7.5, 7.5, 7.5]}, (None, 0)),
    ({"d1": [5000.0, 3.6], "d2": [5000.0, 3.6]}, (3.6, 2)),
    ({"d1": [0.0, 3.0], "d2": [0.0, 3.0]}, (0.0, 2)),
    ({"d1": [-4.198], "d2": [-4.202]}, (-4.2, 2)),
])
def test_supported_vote(spark, given, want):
    assert rows(C.vote_min_support(elevations(spark, given), ["floor"], "d", "v"), "value", "support") == [want]


def test_idf_vote_damps_the_value_every_floor_has(spark):
    data = [(f, f"{f}{i}", v) for f, own in (("B1", -4.2), ("F1", 0.6)) for i in range(3) for v in (0.0, own)]
    df = spark.createDataFrame(data, "floor string, d string, v double")
    assert rows(C.discriminative_vote(df, "floor", "d", "v"), "floor", "value", "support") == [("B1", -4.2, 3), ("F1", 0.6, 3)]


def test_witnesses_adopt_or_conflict(spark):
    data = [("L1", "a", 4.5), ("L1", "b", 4.5), ("L2", "a", 9.0), ("L3", "a", 1.0), ("L3", "b", 1.0), ("L3", "c", 2.0), ("L3", "d", 2.0)]
    df = spark.createDataFrame(data, "k string, d string, v double")
    assert rows(C.consensus(df, ["k"], "d", "v")) == [("L1", 4.5, 2)]
    assert rows(C.conflicts(df, ["k"], "d", "v"), "k", "value", "rivals") == [("L3", 1.0, 2), ("L3", 2.0, 2)]


def test_noisy_or_with_certainty_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0), (2, 0.3), (3, None), (4, 1.7)], "k int, c double")
    assert rows(df.groupBy("k").agg(noisy_or("c").alias("c"))) == [(1, 0.75), (2, 1.0), (3, 0.0), (4, 1.0)]


def observations(spark, data):
    full = [(t, "", "", g, x, y, c, lab, None, d, str(i)) for i, (t, g, x, y, c, lab, d) in enumerate(data)]
    return spark.createDataFrame(full, "type string, building string, floor string, grid_cell string, x double, y double, confidence double, "
                                       "type_label string, outline string, drawing_id string, obs_id string")


@pytest.mark.parametrize("data, entities", [
    ([("column", "C-3", None, None, .9, None, "a"), ("column", "C-3", None, None, .8, None, "b")], 1),
    ([("pipe", "3-BY", 0.0, 0.0, .9, None, "a"), ("pipe", "3-BY", 5.0, 5.0, .9, None, "b")], 2),
    ([("column", "C-3", 10.0, 10.0, .9, None, "a"), ("column", "C-3", 10.2, 10.1, .9, None, "b")], 1),
    ([("column", "C-3", 0.0, 0.0, .9, None, "a"), ("column", "C-3", 5.0, 5.0, .9, None, "b")], 2),
    ([("beam", None, None, None, .9, None, "a"), ("beam", None, None, None, .9, None, "b")], 2),
])
def test_assembly_merges_by_grid_and_distance(spark, data, entities):
    out = B.assemble(observations(spark, data)).collect()
    assert len(out) == entities and sum(r.observations for r in out) == len(data)


def test_assembly_votes_and_state(spark):
    data = [("column", "C-3", 1.0, 1.0, .9, "steel", "a"), ("column", "C-3", 1.1, 1.0, .2, "pile", "b"), ("column", "C-3", 1.0, 1.1, .2, "pile", "c"),
            ("beam", "X-?", 50.0, 1.0, .3, None, "a")]
    out = {r.type: r for r in B.assemble(observations(spark, data)).collect()}
    assert out["column"].type_label == "pile" and out["column"].drawings == 3 and out["column"].review_state == "auto"
    assert out["column"].semantic_key.startswith("column@::C-3@")
    assert out["beam"].semantic_key is None and out["beam"].review_state == "conflict"


def test_story_table_repairs_small_steps(spark):
    df = spark.createDataFrame([("u", "F1", 1, 0.0), ("u", "F2", 2, 1.0), ("u", "F3", 3, None), ("u", "F4", 4, 30.0)], "unit string, story_key string, story_order int, elevation double")
    over = spark.createDataFrame([("u", "F4", 10.0)], "unit string, story_key string, elevation double")
    out = [(r.story_key, r.elevation, r.source, r.warning) for r in B.story_table(df, over).orderBy("story_order").collect()]
    assert out == [("F1", 0.0, "drawing", False), ("F2", 4.5, "default", True), ("F3", 9.0, "default", False), ("F4", 10.0, "override", False)]


def test_frames_separate_two_grids(spark):
    grid_a, grid_b = {"1": 0.0, "2": 8.0, "3": 16.0}, {"1": 0.0, "2": 30.0, "3": 60.0}
    data = [("z", s, lab, pos + off) for s, grid, off in (("a1", grid_a, 0), ("a2", grid_a, 100), ("a3", grid_a, -7), ("b1", grid_b, 3), ("b2", grid_b, 50))
            for lab, pos in grid.items()]
    df = spark.createDataFrame(data, "g string, s string, lab string, pos double")
    out = {}
    for r in C.frames(df, "g", "s", "lab", "pos").collect():
        out.setdefault(r.frame, set()).add(r.s)
    assert out == {0: {"a1", "a2", "a3"}, 1: {"b1", "b2"}}


def test_critical_path_drops_negatives_and_gives_null_without_sample(spark):
    a = spark.createDataFrame([("p1", "2024-01-01 00:00:00"), ("p2", "2024-01-01 00:00:00"), ("p3", "2024-01-09 00:00:00")], "p string, ts string").withColumn("ts", F.to_timestamp("ts"))
    b = spark.createDataFrame([("p1", "2024-01-02 00:00:00"), ("p2", "2024-01-03 00:00:00"), ("p3", "2024-01-01 00:00:00")], "p string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(A.first_to_first(a, b, "p", "ts")) == [(36.0, 2)]
    assert rows(A.first_to_first(a.limit(0), b, "p", "ts")) == [(None, 0)]


def test_source_lists_are_paged(spark):
    df = spark.createDataFrame([("k", str(i % 25)) for i in range(200)] + [("empty", None)], "k string, s string")
    out = A.with_sources(df, ["k"], "s", page=10).collect()
    pages = [r for r in out if r.k == "k"]
    assert len(pages) > 1 and sorted(x for r in pages for x in r.source_list) == sorted(str(i) for i in range(25))
    assert {(r.observations, r.sources) for r in pages} == {(200, 25)}
    assert [(r.sources, r.source_list) for r in out if r.k == "empty"] == [(0, [])]


def test_three_equal_words_make_one_suggestion(spark):
    context = json.dumps({"raw_text": "建 个人"})
    data = [("discipline", "建筑", None, context, i) for i in range(3)] + [("discipline", "电气", "电气", context, 9)]
    events = spark.createDataFrame(data, "kind string, human_value string, auto_value string, context string, event_id long")
    assert rows(E.new_vocabulary(events), "word", "times", "confidence") == [("建筑", 3, 0.8)]
    assert rows(E.corrections(events)) == [("建 个人", "建筑", 3, 0.76)]


def test_entities_do_not_split_at_borders(spark):
    """Two beams 0.2 m apart are one wherever they lie, and so are a column on a grid cell and one beside it without."""
    schema = "type string, building string, floor string, grid_cell string, x double, y double, confidence double, type_label string, outline string, drawing_id long, obs_id string"
    beams = [("beam", "b", "F1", None, x, 1.0, c, "B1", None, 1, f"o{x}") for x, c in ((3.9, 0.9), (4.1, 0.8), (7.9, 0.7))]
    columns = [("column", "b", "F1", "C-3", 3.95, 1.0, 0.9, "KZ", None, 1, "c1"), ("column", "b", "F1", None, 4.05, 1.0, 0.5, "KZ", None, 2, "c2"),
               ("column", "b", "F1", "D-3", 4.0, 1.0, 0.4, "KZ", None, 3, "c3"), ("column", "b", "F1", "D-3", None, None, 0.3, "KZ", None, 3, "c4"),
               ("pile", "b", "F1", None, None, None, 0.3, "P", None, 3, "p1"), ("pile", "b", "F1", None, None, None, 0.3, "P", None, 3, "p2")]
    got = rows(B.assemble(spark.createDataFrame(beams + columns, schema)), "type", "observations")
    assert got == [("beam", 1), ("beam", 2), ("column", 2), ("column", 2), ("pile", 1), ("pile", 1)]


def test_paths_go_as_deep_as_the_tree(spark):
    from sheetledger.operators.retrieval import tree_paths

    nodes = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None, "confirmed") for i in range(9)] + [(20, "x", 19, "confirmed"), (30, "y", 0, "rejected")], "id long, name string, parent_id long, status string")
    got = {r["id"]: (r["path"], r["depth"]) for r in tree_paths(spark, nodes).collect()}
    assert got == {i: ("/".join(f"n{k}" for k in range(i + 1)), i + 1) for i in range(9)}
