"""Row-only operators against brute force on small random data."""

import random

import numpy as np
import pytest

from sheetledger.operators import evaluation as V
from sheetledger.operators import joins as J
from sheetledger.operators import retrieval as R
from sheetledger.operators import spatial as S
from sheetledger.operators import windows as N
from sheetledger.operators.similarity import similar_join

from conftest import rows

BOX = "id int, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n):
    rnd = random.Random(seed)
    return [(i, x, y, x + rnd.uniform(2, 9), y + rnd.uniform(2, 9)) for i in range(n) for x, y in [(rnd.uniform(0, 40), rnd.uniform(0, 40))]]


def iou(a, b):
    w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - inter)


def test_iou_pairing_is_the_greedy_choice(spark):
    a, b = boxes(1, 40), boxes(2, 40)
    left, right = spark.createDataFrame(a, BOX).withColumnRenamed("id", "ia"), spark.createDataFrame(b, BOX).withColumnRenamed("id", "ib")
    got = {(r.ia, r.ib) for r in S.pair_boxes(left, right, "ia", "ib", 0.2).collect()}
    used_a, used_b, want = set(), set(), set()
    for s, i, j in sorted((-iou(x, y), x[0], y[0]) for x in a for y in b if iou(x, y) >= 0.2):
        if i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j), want.add((i, j))
    assert got == want and want


def test_copies_of_boxes_are_matched_as_numbers(spark, monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(S, "_UNITS", 3)  # matches of one pair in several parts
    places = [(x * 2.0, y * 2.0, x * 2.0 + 4, y * 2.0 + 4) for x in range(4) for y in range(3)]
    for n, m in ((60, 45), (0, 5)):
        a, b = [(i, *rnd.choice(places)) for i in range(n)], [(i, *rnd.choice(places)) for i in range(m)]
        left, right = spark.createDataFrame(a, BOX).withColumnRenamed("id", "ia"), spark.createDataFrame(b, BOX).withColumnRenamed("id", "ib")
        got = {(r.ia, r.ib) for r in S.pair_boxes(left, right, "ia", "ib", 0.3).collect()}
        first = lambda box, side: min(x[0] for x in side if x[1:] == box[1:])
        used_a, used_b, want = set(), set(), set()
        for *_, i, j in sorted((-iou(x, y), first(x, a), first(y, b), x[0], y[0]) for x in a for y in b if iou(x, y) >= 0.3):
            if i not in used_a and j not in used_b:
                used_a.add(i), used_b.add(j), want.add((i, j))
        assert got == want and len(want) == min(n, m, len(want))


def test_a_hundred_copies_on_both_sides_meet_once(spark):
    copies = [(i, 1.0, 1.0, 5.0, 5.0) for i in range(100)]
    side = lambda name: spark.createDataFrame(copies, BOX).withColumnRenamed("id", name)
    met = []
    plain = S.overlapping
    try:
        S.overlapping = lambda *args: met.append(plain(*args)) or met[-1]
        got = rows(S.pair_boxes(side("ia"), side("ib"), "ia", "ib", 0.5))
    finally:
        S.overlapping = plain
    assert got == [(i, i, 1.0) for i in range(100)] and met[0].count() == 1


def test_vector_search_leaves_out_far_blocks(spark):
    rng = np.random.default_rng(4)
    tops = rng.normal(size=(12, 8))
    vectors = [(i, "a" if i % 5 else "b", [float(x) for x in tops[i % 12] + rng.normal(size=8) * 0.02]) for i in range(600)]
    vectors += [(600, "a", [0.0] * 8), (601, "a", vectors[1][2]), (602, "c", vectors[2][2])]
    df = spark.createDataFrame(vectors, "id long, label string, v array<double>")
    x = np.array([v for *_, v in vectors])
    unit = np.divide(x, np.linalg.norm(x, axis=1)[:, None], out=np.zeros_like(x), where=np.linalg.norm(x, axis=1)[:, None] > 0)
    labels = np.array([label for _, label, _ in vectors])
    for queries in (df, df.where("id % 3 = 0")):
        got = {}
        for r in R.topk_cosine(queries, df, "id", "v", "label", 3, 20, 40, skip_self=True).collect():
            got.setdefault(r.query_id, []).append((r["rank"], round(r.score, 9)))
        for i in range(0, len(x), 1 if queries is df else 3):
            score = np.sort([unit[i] @ unit[j] for j in np.flatnonzero(labels == labels[i]) if j != i])[::-1][:3]
            assert sorted(got.pop(i, [])) == [(n, pytest.approx(s, abs=1e-9)) for n, s in enumerate(score, 1)]
        assert not got
    left, right = R.vector_blocks(df, "id", "v", "label", 20), R.vector_blocks(df, "id", "v", "label", 40)
    every = left.join(right.select("label"), "label").count()
    assert R.meeting_blocks(left, right, "label", 3, True).count() < every / 2


def test_tolerance_match_serves_confident_predictions_first(spark):
    rnd = random.Random(5)
    pred = [(i % 3, i, rnd.uniform(0, 20), rnd.random()) for i in range(60)]
    gold = [(i % 3, i, rnd.uniform(0, 20)) for i in range(45)]
    got = {(r.pred_id, r.gold_id) for r in V.match_values(
        spark.createDataFrame(pred, "s int, pred_id int, value double, confidence double"), spark.createDataFrame(gold, "s int, gold_id int, gold double"), ["s"], 1.0).collect()}
    want, free = set(), {g[1] for g in gold}
    for s, i, v, _ in sorted(pred, key=lambda p: (-p[3], p[1])):
        near = sorted((abs(g[2] - v), g[1]) for g in gold if g[0] == s and g[1] in free and abs(g[2] - v) <= 1.0)
        if near:
            want.add((i, near[0][1])), free.discard(near[0][1])
    assert got == want


def test_dedupe_near_is_the_greedy_choice(spark):
    rnd = random.Random(7)
    data = [(i, rnd.uniform(0, 30), rnd.uniform(0, 30), float(rnd.randint(0, 9))) for i in range(120)]
    df = spark.createDataFrame(data, "id int, x double, y double, s double")
    kept = []
    for i, x, y, _ in sorted(data, key=lambda t: (-t[3], t[0])):
        if all(((x - a) ** 2 + (y - b) ** 2) ** 0.5 >= 3.0 for _, a, b in kept):
            kept.append((i, x, y))
    assert {r.id for r in N.dedupe_near(df, "id", "x", "y", "s", 3.0).collect()} == {k[0] for k in kept}


def test_overlap_dedupe_keeps_other_classes(spark):
    data = [(1, "slab", 0., 0., 10., 10., .9), (2, "slab", 0., 0., 10., 9., .5), (3, "column", 0., 0., 10., 10., .1)]
    df = spark.createDataFrame(data, "id int, c string, x0 double, y0 double, x1 double, y1 double, s double")
    assert rows(N.dedupe_boxes(df, "id", "s", ["c"], 0.5), "id") == [(1,), (3,)]


def test_gap_match_needs_one_place_over_all_anchors(spark):
    anchors = [("a", [8.4, 6.0, 7.2, 8.4, 5.0, 9.0, 3.3, 4.1]), ("b", [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]), ("c", [1.0, 2.0, 4.0, 8.0, 16.0, 32.0])]
    targets = [("exact", [6.0, 7.2, 8.4, 5.0, 9.0]), ("merged", [6.0, 7.2, 13.4, 9.0, 3.3]), ("twice", [1.0, 2.0, 4.0, 8.0, 16.0]), ("none", [5.5] * 5), ("short", [6.0, 7.2])]
    out = J.match_gaps(spark.createDataFrame(targets, "target_id string, gaps array<double>"), spark.createDataFrame(anchors, "anchor_id string, gaps array<double>"))
    assert rows(out, "target_id", "anchor_id", "start", "end") == [("exact", "a", 1, 6), ("merged", "a", 1, 7)]


def test_similar_join_prefers_references_and_folds_copies(spark):
    a = [("g1", "R1", "the beam is missing at axis three"), ("g2", None, "stair width is below the minimum value"), ("g3", "R9", "stair width is below the minimum value")]
    b = [("p1", "R1", "something else"), ("p2", None, "stair width is below a minimum value"), ("p3", None, "stair width is below a minimum value"), ("p4", "R2", "the beam is missing at axis three")]
    out = similar_join(spark.createDataFrame(a, "id string, ref string, text string"), spark.createDataFrame(b, "id string, ref string, text string"), 0.8)
    got = {(r.id_a, r.id_b, r.ref_exact) for r in out.collect()}
    assert got == {("g1", "p1", True), ("g2", "p2", False), ("g2", "p3", False), ("g3", "p2", False), ("g3", "p3", False)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(500, 500)]
    got = dict(rows(R.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[500] == 500


def test_propagation_takes_unique_hits_only(spark):
    anchors = spark.createDataFrame([(1, "Z1"), (2, "Z2")], "id long, label string")
    pairs = spark.createDataFrame([(1, 10, .1), (10, 20, .1), (2, 30, .9), (30, 40, .1), (1, 50, .1), (2, 50, .1), (1, 2, .1)], "src long, dst long, residual double")
    out = R.propagate(anchors, pairs, anchors.select("id"), 0.5)
    assert rows(out, "id", "label", "generation") == [(10, "Z1", 0), (20, "Z1", 1), (30, "Z2", 0)]


def test_row_pairs_use_each_side_once(spark):
    names = spark.createDataFrame([("s", 1, 0., 10., 5.), ("s", 2, 0., 10., 40.)], "k string, name_id int, x0 double, x1 double, y double")
    values = spark.createDataFrame([("s", 7, 12., 20., 6.), ("s", 8, 60., 70., 5.), ("s", 9, 300., 310., 40.)], "k string, value_id int, x0 double, x1 double, y double")
    assert rows(S.row_pairs(names, values, ["k"]), "name_id", "value_id", "distance") == [(1, 7, 3.0)]


def test_monotone_and_lis(spark):
    levels = [("F1", 1, 10.0, 1), ("F2", 2, 4.5, 9), ("F3", 3, 9.0, 2), ("F4", 4, 8.0, 1)]
    df = spark.createDataFrame([("u", *r) for r in levels], "u string, f string, o int, z double, s int")
    assert rows(N.monotone(df, ["u"], "o", "z", "s").where("kept"), "f") == [("F2",), ("F3",)]
    ranks = [1, 2, 3, 4, 5, 10, 12, 14, 6, 15, 7, 8]
    seq = spark.createDataFrame([("x", float(i), r, i) for i, r in enumerate(ranks)], "k string, p double, r int, t int")
    assert rows(N.lis_outliers(seq, ["k"], "p", "r", "t")) == [("x", 12, 3, True)]


def test_order_fidelity_null_when_undecidable(spark):
    df = spark.createDataFrame([(1, ["a", "x", "b"], ["a", "b", "c", "d"]), (2, ["b", "a"], ["a", "b"]), (3, ["z"], ["a"]), (4, ["a"], [])], "id int, f array<string>, w array<string>")
    assert rows(V.order_fidelity(df, "f", "w"), "id", "fidelity") == [(1, 0.5), (2, 0.5), (3, None), (4, None)]


def test_no_project_in_two_splits(spark):
    df = spark.createDataFrame([(f"p{i % 17}", i) for i in range(170)], "project string, id int")
    one, two = V.split_groups(df, "project"), V.split_groups(df, "project")
    assert V.leaks(one, "project").count() == 0 and rows(one) == rows(two) and one.count() == 170


def test_fuzzy_join_misses_no_pair(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = ["beam", "column", "slab", "the", "of", "grid", "level", "north", "wall", "pipe"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    other = ["".join(c for c in t if rng.random() > 0.12) + rng.choice(["", " x", " the wall"]) for t in base] + ["", base[0]]
    left = spark.createDataFrame([(i, None, t) for i, t in enumerate(base)], "id long, ref string, text string")
    right = spark.createDataFrame([(i, None, t) for i, t in enumerate(other)], "id long, ref string, text string")
    got = {(r["id_a"], r["id_b"]) for r in similar_join(left, right, 0.8).collect()}
    assert got == {(i, j) for i, x in enumerate(base) for j, y in enumerate(other) if x and y and SequenceMatcher(None, x, y).ratio() >= 0.8}


def test_inversions_of_large_values(spark):
    df = spark.createDataFrame([("a", 1, 300), ("a", 2, 200), ("a", 3, 100), ("b", 1, 1), ("b", 2, 2), ("b", 3, 1 << 40)], "k string, t long, v long")
    assert rows(N.inversions(df, ["k"], ["t"], "v"), "k", "inversion_rate") == [("a", 1.0), ("b", 0.0)]
