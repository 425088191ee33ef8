"""Frames of axes in both directions, their registration, and lines by votes of point pairs."""

import pytest

from sheetledger.operators import axis_frames as X
from sheetledger.operators import consensus as C

# Sheets and frames with the results that must come out.
FORM = "g string, s string, axis string, label string, pos double"


def sheets(spark, groups):
    rows = [(g, s, axis, label, pos) for g, observed in groups.items() for s, sides in observed.items() for axis, labels in sides.items() for label, pos in labels.items()]
    return spark.createDataFrame(rows, FORM)


def framed(spark, groups):
    members, axes = X.joint_frames(sheets(spark, groups), "g", "s", "axis", "label", "pos")
    found, offsets = {}, {}
    for r in members.collect():
        found.setdefault((r["group"], r["frame"]), set()).add(r["source"])
        offsets[r["group"], r["source"]] = (r["x_offset"], r["y_offset"], r["residual"])
    return found, offsets, {(r["group"], r["frame"], r["axis"], r["label"]): r["pos"] for r in axes.collect()}


TWO_GRIDS = {"a1": {"x": {"1": 0.0, "2": 8.0, "3": 16.0}, "y": {"A": 0.0, "B": 6.0}}, "a2": {"x": {"1": 50.0, "2": 58.0, "3": 66.0}, "y": {"A": 20.0, "B": 26.0}},
             "b1": {"x": {"1": 0.0, "2": 30.0, "3": 60.0}, "y": {"A": 0.0, "B": 20.0}}, "b2": {"x": {"1": 5.0, "2": 35.0, "3": 65.0}, "y": {"A": 3.0, "B": 23.0}}}
BY_MEMBERS = {**{f"a{i}": {"x": {"1": 0.0, "2": 8.0}, "y": {"A": 0.0, "B": 6.0}} for i in (1, 2, 3)}, "b1": {"x": {"1": 0.0, "2": 40.0}, "y": {"A": 0.0, "B": 30.0}}}
JOINT = {"a1": {"x": {"1": 0.0, "2": 8.0}, "y": {"A": 0.0, "B": 6.0}}, "a2": {"x": {"1": 20.0, "2": 28.0}, "y": {"A": 10.0, "B": 16.0}},
         "b1": {"x": {"1": 0.0, "2": 8.0}, "y": {"A": 0.0, "B": 40.0}}, "b2": {"x": {"1": 20.0, "2": 28.0}, "y": {"A": 10.0, "B": 50.0}}}
SHARED = {"d1": {"x": {"1": 0.0, "2": 8.0, "3": 16.0}, "y": {"A": 0.0, "B": 6.0}}, "d2": {"x": {"2": 108.0, "3": 116.0}, "y": {"A": 100.0, "B": 106.0}}}
FAR = {"d1": {"x": {"1": 0.0, "2": 8.0}, "y": {"A": 0.0, "B": 6.0}}, "d2": {"x": {"1": 500.0, "2": 508.0}, "y": {"A": 300.0, "B": 306.0}}}
MAJORITY = {"bad": {"x": {"1": 0.0, "2": 30.0, "3": 60.0}, "y": {"A": 0.0, "B": 20.0}}, **{d: {"x": {"1": 0.0, "2": 8.0, "3": 16.0}, "y": {"A": 0.0, "B": 6.0}} for d in ("d1", "d2")}}
ONE_SIDE = {"plan": {"x": {"1": 0.0, "2": 8.0}, "y": {"A": 0.0, "B": 6.0}}, "section": {"x": {"1": 0.0, "2": 8.0}, "y": {}}}
LOWEST = {"d1": {"x": {"10": 100.0, "2": 105.0, "B": 9.0}, "y": {"B": 53.0, "A": 50.0}}}


def test_frames_of_all_groups_grow_together(spark):
    groups = {"two": TWO_GRIDS, "size": BY_MEMBERS, "joint": JOINT, "shared": SHARED, "far": FAR, "majority": MAJORITY, "side": ONE_SIDE, "low": LOWEST}
    found, offsets, axes = framed(spark, groups)
    of = lambda g: [found[k] for k in sorted(found) if k[0] == g]
    assert sorted(map(sorted, of("two"))) == [["a1", "a2"], ["b1", "b2"]]
    assert of("size") == [{"a1", "a2", "a3"}, {"b1"}]
    assert of("joint") == [{"a1", "a2"}, {"b1"}, {"b2"}] or of("joint")[0] == {"a1", "a2"} and not {"a1", "a2"} & set().union(*of("joint")[1:])
    assert of("shared") == [{"d1", "d2"}] and axes["shared", 0, "x", "1"] == 0 and axes["shared", 0, "x", "3"] == pytest.approx(16) and axes["shared", 0, "y", "B"] == pytest.approx(6)
    assert of("far") == [{"d1", "d2"}]
    for name, (x, y) in (("d1", (0.0, 0.0)), ("d2", (500.0, 300.0))):  # position plus offset is the place in the frame
        assert x + offsets["far", name][0] == pytest.approx(0) and y + offsets["far", name][1] == pytest.approx(0)
    assert of("majority")[0] == {"d1", "d2"} and axes["majority", 0, "x", "2"] == pytest.approx(8)
    assert of("side") == [{"plan"}]
    assert axes["low", 0, "x", "2"] == 0 and axes["low", 0, "x", "10"] == pytest.approx(-5) and axes["low", 0, "y", "A"] == 0


def test_frames_of_no_rows(spark):
    members, axes = X.joint_frames(sheets(spark, {}), "g", "s", "axis", "label", "pos")
    assert members.count() == 0 and axes.count() == 0


def registered(spark, frames, pinned=None):
    axes = spark.createDataFrame([("g", i, axis, label, pos) for i, (sides, _) in enumerate(frames) for axis, labels in sides.items() for label, pos in labels.items()],
                                 "group string, frame int, axis string, label string, pos double")
    sizes = spark.createDataFrame([("g", i, n) for i, (_, n) in enumerate(frames)], "group string, frame int, n long")
    pins = None if pinned is None else spark.createDataFrame([("g", *p) for p in pinned], "group string, frame int, dx double, dy double")
    return {r["frame"]: None if r["dx"] is None else (r["dx"], r["dy"]) for r in X.register(axes, sizes, pins).collect()}


def test_registration(spark):
    grid = {"x": {"1": 0.0, "2": 8.0, "3": 16.0}, "y": {"A": 0.0, "B": 6.0}}
    assert registered(spark, [(grid, 1), ({"x": {"2": 0.0, "3": 8.0}, "y": {"A": 0.0, "B": 6.0}}, 1)]) == {0: (0.0, 0.0), 1: (8.0, 0.0)}
    small = {"x": {"1": 0.0, "2": 8.0}, "y": {"A": 0.0}}
    assert registered(spark, [(small, 1), ({"x": {"88": 0.0, "99": 5.0}, "y": {"Z": 0.0}}, 1)]) == {0: (0.0, 0.0), 1: None}
    assert registered(spark, [(small, 1), (small, 3)]) == {0: (0.0, 0.0), 1: (0.0, 0.0)}
    wide = {"x": {"1": 0.0, "2": 8.0, "3": 16.0}, "y": {"A": 0.0}}
    assert registered(spark, [(wide, 3), ({"x": {"1": 0.0, "2": 40.0, "3": 80.0}, "y": {"A": 0.0}}, 1), ({"x": {"2": 0.0, "3": 8.0}, "y": {"A": 0.0}}, 1)]) == {0: (0.0, 0.0), 1: None, 2: (8.0, 0.0)}
    # a chain: each frame shares labels with the one before only; and a pinned frame moves all
    chain = [({"x": {str(i): 0.0, str(i + 1): 8.0}, "y": {"A": 0.0}}, 9 - i) for i in range(4)]
    assert registered(spark, chain) == {i: (8.0 * i, 0.0) for i in range(4)}
    assert registered(spark, chain, [(3, 100.0, 5.0)]) == {i: (76.0 + 8 * i, 5.0) for i in range(4)}


def line(spark, points):
    df = spark.createDataFrame([("d", *p) for p in points] + [("other", 1.0, 1.0), ("other", None, 2.0)], "k string, x double, y double")
    return {r["k"]: r for r in C.fit_line(df, ["k"], "x", "y").collect()}["d"]


def test_lines_by_votes(spark):
    good = line(spark, [(1348.6, 0.0), (1225.6, 10.04), (1102.0, 20.12), (1032.7, 25.78)])
    assert good["ok"] and good["r_squared"] > 0.99 and good["slope"] < 0
    one_off = line(spark, [(1000.0, 0.0), (900.0, 5.0), (800.0, 10.0), (700.0, 15.0), (650.0, 99.0)])
    assert one_off["ok"] and one_off["points"] - one_off["inliers"] >= 1
    assert not line(spark, [(100.0, 0.0), (200.0, 9.0), (300.0, 2.0), (400.0, 25.0), (500.0, 1.0)])["ok"]
    three_off = line(spark, [(float(x), 2.0 * x + 1) for x in range(5)] + [(0.5, 90.0), (2.5, 70.0), (3.5, -40.0)])
    assert three_off["ok"] and three_off["inliers"] == 5 and three_off["slope"] == pytest.approx(2) and three_off["intercept"] == pytest.approx(1)
    copies = line(spark, [(0.0, 0.0)] * 30 + [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)])
    assert copies["ok"] and copies["inliers"] == 33
    assert not line(spark, [(1.0, 1.0)])["ok"] and not line(spark, [(1.0, float(y)) for y in range(6)])["ok"]
