"""Cases of the third review: small tables on which the earlier code was wrong or did too much work."""

import tracemalloc
from datetime import datetime, timedelta
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sheetledger.functions.nested import collect_keep, explode_keep
from sheetledger.llm import backoff_lm, common
from sheetledger.operators import assembly, consensus, evaluation, fusion, matching, quantiles, ranks, similarity
from sheetledger.operators import retrieval as R
from sheetledger.operators.compliance import match_issues
from sheetledger.operators.consensus import frames
from sheetledger.operators.joins import match_gaps
from sheetledger.plans.catalog import entries
from sheetledger.sources.tables import SCHEMAS
from sheetledger.streaming import events as S

from conftest import rows


def beside_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as lists of tuples."""
    con = duckdb.connect()
    for table, data in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(data, SCHEMAS[table]).coalesce(1).write.parquet(path)
        con.execute(f"create view {table} as select * from '{path}/*.parquet'")
    got = entries()[name].run(spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({entries()[name].sql})").fetchall()
    return rows(got), sorted(want)


@pytest.mark.parametrize("low", [0.03, 0.05, 1.07, 12.34, 21.5])
def test_tokens_exactly_on_the_border_of_a_row(spark, tmp_path, low):
    at = datetime(2024, 1, 1)
    events = [(1, at, 1, "signup", low, "{}"), (2, at + timedelta(seconds=5), 1, "view", round(low + 6, 2), "{}"),
              (3, at + timedelta(seconds=9), 1, "click", low + 0.5, "{}"), (4, at + timedelta(seconds=2), None, "view", low, "{}")]
    got, want = beside_sql(spark, tmp_path, "joi19_right_neighbour", events=events)
    assert got == want


def test_frames_of_many_rounds_come_as_one_table(spark):
    data = [(g, s, f"L{s // (g + 1)}-{k}", 10.0 * k + s) for g in range(2) for s in range(4) for k in range(3)]
    found = frames(spark.createDataFrame(data, "g int, s int, lab string, pos double"), "g", "s", "lab", "pos")
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    sets = {}
    for r in found.collect():
        sets.setdefault((r.g, r.frame), []).append(r.s)
    assert sorted(map(sorted, sets.values())) == [[0], [0, 1], [1], [2], [2, 3], [3]]


def test_gap_sequences_meet_by_five_gaps(spark):
    anchors = spark.createDataFrame([("a", [3.0, 4.0, 5.0, 6.0, 7.0, 8.0]), ("b", [3.0, 4.0, 5.0, 9.0, 7.0, 8.0])], "anchor_id string, gaps array<double>")
    targets = spark.createDataFrame([("t", [7.1, 5.0, 6.0, 7.0, 8.0]), ("u", [3.0, 4.0, 5.0, 40.0, 7.0])], "target_id string, gaps array<double>")
    found = match_gaps(targets, anchors)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "_b0" in line]
    assert joins and all(f"_b{i}" in line for line in joins for i in range(5))
    assert [(r.target_id, r.anchor_id, r.start, r.end, r.spans) for r in found.collect()] == [("t", "a", 0, 6, [2, 1, 1, 1, 1])]


def test_merging_does_not_rewrite_settled_candidates(spark, monkeypatch):
    single = [(1, i, f"S{i}", f"{i:03d}" * 5, "info", "kg") for i in range(100, 140)]
    chain = [(1, i, f"R{i // 2}", f"{(i + 1) // 2:03d}" * 5, "info", "rag") for i in range(8)]
    written, write = [], fusion.write_down

    def counted(df):
        out = write(df)
        if "_is" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(fusion, "write_down", counted)
    data = spark.createDataFrame(chain + single, "k int, at int, ref string, snippet string, severity string, source string")
    found = fusion.merge_candidates(data, ["k"], "at", 0.99, None)
    # in a chain where each matches the one before only, every other one leads
    assert sorted(r.at for r in found.collect() if r.at < 100) == [0, 2, 4, 6]
    assert len(written) > 2 and sum(written) < 2 * len(chain + single)


def test_blocks_of_vectors_are_read_without_an_object_per_number():
    x = np.random.default_rng(3).normal(size=(2000, 64)).astype(np.float32)
    vectors = pa.ListArray.from_arrays(np.arange(0, 2001 * 64, 64, dtype=np.int32), pa.array(x.ravel()))
    blocks = pa.ListArray.from_arrays(np.array([0, 1200, 2000], dtype=np.int32), pa.StructArray.from_arrays([pa.array(np.arange(2000)), vectors], names=["k", "v"]))
    tracemalloc.start()
    keys, held = R._held(blocks[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.tolist() == list(range(1200, 2000)) and np.array_equal(held, x[1200:].astype(np.float64))
    assert peak < 3 * held.nbytes
    with pytest.raises(ValueError):
        R._held(pa.array([[{"k": 1, "v": [1.0, 2.0]}, {"k": 2, "v": [1.0, 2.0, 3.0, 4.0]}]])[0])


def test_line_votes_are_counted_in_slices(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    x, y, w = np.sort(rnd.integers(0, 12, 60).astype(float)), rnd.uniform(0, 6, 60).round(2), rnd.integers(1, 4, 60).astype(float)
    best = None
    for i in range(60):
        for j in range(i + 1, 60):
            if abs(x[j] - x[i]) >= 1e-6:
                a = (y[j] - y[i]) / (x[j] - x[i])
                b = y[i] - a * x[i]
                n = sum(w[k] for k in range(60) if abs(y[k] - (a * x[k] + b)) <= 0.5)
                best = max(best or (n, -i, -j, (a, b)), (n, -i, -j, (a, b)))
    for cells in (1 << 20, 60 * 60 * 7, 500, 1):
        monkeypatch.setattr(consensus, "_CELLS", cells)
        assert consensus._line_of(x, y, w, 0.5) == best[3]
    found = consensus.fit_line(spark.createDataFrame([(1, 2.0, 3.0), (2, 1.0, float("nan")), (2, 2.0, 1.0), (3, 1.0, 1.0), (3, 1.0, 2.0)], "k int, x double, y double"), ["k"], "x", "y")
    assert [(r.k, r.points, r.inliers, r.slope, r.ok) for r in found.orderBy("k").collect()] == [(1, 1, 0, None, False), (2, 2, 0, None, False), (3, 2, 0, None, False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "RepartitionByExpression" in plan


@pytest.mark.parametrize("name", ["str05_short_texts", "str05_parse_measures"])
def test_short_texts_fold_before_they_are_parsed(spark, tmp_path, name):
    lines = [(i, 1000 + i % 3, 1, 1 + i % 7, 5.0 + i % 2, 1.0, 0.0, 0.0, "A", "F", datetime(2024, 1, 1)) for i in range(60)]
    got, want = beside_sql(spark, tmp_path, name, lineitem=lines)
    assert got == want
    assert entries()[name].run(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_ends_that_many_edges_share_fold_before_they_meet_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(10)], "id long")
    edges = spark.createDataFrame([(-1, -2)] * 50 + [(1, 2)] * 50 + [(3, 99), (3, 99), (4, None)], "src long, dst long")
    found = R.isolation(nodes, edges, "id")
    assert rows(found) == [(10, 6, 0.6, 53)]
    sides = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[1:]
    assert len(sides) == 2 and all("Aggregate [" in side for side in sides)


def test_stars_take_more_parts_for_more_links(spark, monkeypatch):
    kept, cut = [], R.cut_lineage

    def counted(df):
        out = cut(df)
        kept.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(R, "cut_lineage", counted)
    monkeypatch.setattr(R, "_LINKS", 20)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 300)]
    found = R.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert rows(found) == sorted([(i, 0) for i in range(61)] + [(100 + i, 100) for i in range(60)] + [(300, 300)])
    assert len(kept) > 2 and all(n == 6 for n in kept[1:])


def test_arrays_come_back_from_plain_lists(spark):
    data = [(1, ["b", None, "a", ""]), (2, []), (3, None), (4, [None]), (5, [str(i * 7 % 50) for i in range(50)])]
    exploded = explode_keep(spark.createDataFrame(data, "k int, a array<string>").repartition(3), "a").repartition(4)
    back = collect_keep(exploded, ["k"])
    assert {r.k: r["items"] for r in back.collect()} == {k: a or [] for k, a in data}
    assert back._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 3


def test_texts_are_compared_side_by_side(monkeypatch):
    """Pairs are those of the plain ratio; a text walks once beside all that it may be like, and long texts that share few neighbours meet no walk."""
    rng = np.random.default_rng(7)
    make = lambda n: "".join(rng.choice(list("etaoinshr dlu,.qzé"), n, p=np.r_[np.full(12, 0.075), np.full(6, 0.1 / 6)]))
    right = [make(n) for n in (1, 7, 8, 63, 64, 65, 150, 199, 200, 230, 300, 301)]
    left = [make(n) for n in (1, 8, 64, 160, 200, 240, 310)] + ["".join(c for c in t if rng.random() > 0.12) for t in right] + [right[3], right[9] + "x", right[9][5:] + make(5)]
    walks = []
    monkeypatch.setattr(similarity.Rails, "common", lambda self, text, chosen, walk=similarity.Rails.common: walks.append((text, chosen)) or walk(self, text, chosen))
    for threshold in (0.5, 0.72, 0.8, 0.95):
        ratio = {(x, y): similarity.SequenceMatcher(None, x, y).ratio() for x in left if x for y in right}
        assert sorted(similarity.close_pairs([x for x in left if x], right, threshold)) == sorted((*k, r) for k, r in ratio.items() if r >= threshold)
        assert len({x for x, _ in walks}) == len(walks)
        walks.clear()
    assert not list(similarity.close_pairs([make(230) for _ in range(50)], right, 0.8))
    assert all(len(right[j]) < similarity.LONG for _, chosen in walks for j in chosen)  # ``right`` is in order of length


def test_issues_are_read_once_and_numbered_with_null_keys(spark):
    """Found issues, which may come from joins, are computed once; the nth of a reference meets the nth, null keys meet too."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    gold = spark.createDataFrame([("a", 1, "GB1-2010", "pipe too thin", "major", "MUST"), ("a", 2, "GB 1", "no door", "info", None), (None, 3, "GB1", "x", "minor", "may"), ("a", 4, "", "wall missing", "major", None)],
                                 "k string, gold_id long, ref string, snippet string, severity string, obligation string")
    found = spark.createDataFrame([("a", 10, "gb1-2015", "[MUST] pipe", "info"), (None, 11, "gb1", "y", "minor"), ("a", 12, None, "wall missing!", "minor"), ("a", 13, "GB9", "pipe too thin", "major")],
                                  "k string, found_id long, ref string, description string, severity string")
    marks = match_issues(gold, found.mapInPandas(count, found.schema), ["k"])
    assert rows(marks.select("k", "mark", "gold_id", "found_id", "ref_exact", "gold_level", "found_level").fillna("-", ["k"])) == sorted([
        ("-", "tp", 3, 11, True, "MAY", "SHOULD"), ("a", "wrong_severity", 1, 10, True, "MUST", "MUST"), ("a", "tp", 4, 12, False, "SHOULD", "SHOULD"),
        ("a", "missed", 2, None, None, None, None), ("a", "wrong_ref", None, 13, None, None, None)], key=lambda t: (t[0], t[1]))
    assert seen.value == found.count()


def test_values_are_spread_on_the_side_of_the_predictions(spark, monkeypatch):
    """Gold values lie in one cell each, costs are not stored beside the pairs, and a round is computed once."""
    kept = []
    monkeypatch.setattr(matching, "cut_lineage", lambda df, cut=matching.cut_lineage: kept.append(df) or cut(df))
    pred = spark.createDataFrame([("s", i, 0.1 * i, i / 40) for i in range(40)] + [(None, 99, 1.0, 0.5)], "k string, pred_id int, value double, confidence double")
    gold = spark.createDataFrame([("s", i, 0.1 * i) for i in range(0, 40, 2)] + [(None, 7, 1.0)], "k string, gold_id int, gold double")
    got = evaluation.match_values(pred, gold, ["k"], 0.15)
    want, free = set(), set(range(0, 40, 2))
    for i in reversed(range(40)):
        near = sorted((abs(0.1 * j - 0.1 * i), j) for j in free if abs(0.1 * j - 0.1 * i) <= 0.15)
        if near:
            want.add((i, near[0][1])), free.discard(near[0][1])
    assert {(r.pred_id, r.gold_id) for r in got.collect()} == want
    assert all(not c.startswith("_cost") for df in kept for c in df.columns)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    spread = plan[plan.index("Generate explode"):].split("\n:- ")[0]
    assert plan.count("Generate explode") == 1 and "value" in spread.split("\n")[1]


def test_labels_are_tallied_per_spot(spark, monkeypatch):
    """The vote over an entity's labels reads tallies of spots, not the observations again; blank labels do not count, a tie goes to the surer one."""
    kept = []
    monkeypatch.setattr(assembly, "cut_lineage", lambda df, cut=assembly.cut_lineage: kept.append(df.columns) or cut(df))
    obs = [(x, c, label) for x, c, label, n in [(0.0, 0.9, "a", 1), (0.0, 0.5, "b", 2), (0.3, 0.4, "a", 1), (0.3, 0.4, None, 5), (0.3, 0.4, "", 4), (9.0, 0.2, None, 1)] for _ in range(n)]
    df = spark.createDataFrame([("beam", None, "F1", None, x, 0.0, c, label, None, i, f"o{i:02}") for i, (x, c, label) in enumerate(obs)],
                               "type string, building string, floor string, grid_cell string, x double, y double, confidence double, type_label string, outline string, drawing_id long, obs_id string")
    assert rows(assembly.assemble(df), "cx", "type_label", "observations", "drawings") == [(0.231, "a", 13, 13), (9.0, None, 1, 1)]
    assert any({"type_label", "_n"} <= set(c) for c in kept)


def test_reaper_makes_no_table_without_news(spark):
    """Only a timer that runs out gives a table; the latest row of all batches counts, of equal times the last."""
    stream = MagicMock()
    S.reap(stream, "item", "ts", "status", 5.0, 3)
    fold = stream.select().withWatermark().groupBy().applyInPandasWithState.call_args[0][0]
    state = MagicMock(exists=False, hasTimedOut=False)
    state.getCurrentWatermarkMs.return_value = 0
    part = lambda *r: pd.DataFrame(list(r), columns=["_ts", "_status"]).astype({"_ts": "datetime64[ns]"})
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    for batches, active in (([part((late, "extracting"), (early, "ready")), part((early, "ready"))], True), ([part((late, "extracting")), part((late, "ready"), (early, "extracting"))], False)):
        assert list(fold((1,), iter(batches), state)) == []
        assert state.update.call_args[0][0] == (1704153600000 if active else 0, 0)
    state = MagicMock(exists=True, hasTimedOut=True, get=(1704153600000, 3))
    assert [t.values.tolist() for t in fold((1,), iter(()), state)] == [[[1, pd.Timestamp("2024-01-02 05:00"), 4, False]]]


def test_ranks_beyond_doubles_keep_their_order(spark):
    """Long runs over several parts and bands keep ranks whole, also where states travel beside rows."""
    big, n = 1 << 60, 400
    place = np.random.default_rng(3).permutation(n)
    df = spark.createDataFrame([("a", i, big + int(place[i])) for i in range(n)] + [("b", i, big + i) for i in range(n)] + [(None, 1, 5)], "k string, o long, r long")
    got = {r["k"]: r["length"] for r in ranks.longest_runs(df, ["k"], ["o"], "r").collect()}
    ends = ranks.Stairs()
    for p in place.tolist():
        ends.add(p, ends.below(p) + 1)
    assert got == {"a": ends.lengths[-1], "b": n, None: 1}


def test_order_fidelity_holds_the_items_of_one_row(spark):
    words = [[f"w{(i * 7 + j) % 300}" for j in range(150)] for i in range(1000)]
    found, wanted = pa.array([*words, None, []]), pa.array([*(sorted(w) for w in words), ["a"], ["a"]])
    tracemalloc.start()
    got = evaluation._lcs_share.func(found, wanted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000  # all items as strings are 17 MB
    assert got.null_count == 2 and got[0].as_py() == sorted_run(words[0]) / 150


def sorted_run(items):
    best = []
    for i, x in enumerate(items):
        best.append(1 + max((n for n, y in zip(best, items[:i]) if y < x), default=0))
    return max(best)


def test_rows_of_few_groups_are_not_sorted_beside_their_sketches(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4000")  # parts of sketches are over it, three merged ones are not
        df = spark.range(30_000).selectExpr("id % 3 as k", "cast(id as double) as v").repartition(4)
        found = quantiles.median_by(df, ["k"], "v", "m")
        assert rows(found) == [(0, 14998.5), (1, 14999.5), (2, 15000.5)]
        final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_witnesses_of_sane_gaps_are_not_counted(spark, monkeypatch):
    counted, join = [], consensus.null_safe_join

    def noted(left, right, keys, *how):
        if "witnesses" in right.columns:
            counted.append({(r.k, r._g) for r in right.collect()})
        return join(left, right, keys, *how)

    monkeypatch.setattr(consensus, "null_safe_join", noted)
    gaps = [(k, s, g) for k in (1, None) for s in range(9) for g in (10.0, 12.0)]
    data = [*gaps, (1, 20, 4.9996), (1, 21, 5.0004), (1, 21, 5.0004), (1, 22, 5.0001), (1, 20, 40.0), (1, 21, 40.0), (1, 20, 41.0), (None, 1, 100.0), (1, 1, -3.0), (1, None, 1.0), (2, 1, 7.0)]
    df = spark.createDataFrame([*data, *[(1, 30 + i, 10.0) for i in range(20)]], "k int, s int, g double")
    got = rows(consensus.gap_anomaly(df, ["k"], "s", "g"), "k", "s", "g", "consensus", "ratio", "witnesses", "cause")
    # 4.9996 is off a consensus of 10, its witnesses of the same millimetre are not
    assert got == sorted([(1, 20, 4.9996, 10.0, 0.5, 3, "scale"), (1, 20, 41.0, 10.0, 4.1, 1, "detection"), (1, None, 1.0, 10.0, 0.1, 1, "detection"),
                          (None, 1, 100.0, 12.0, 8.333, 1, "detection")], key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "n", x) for x in t))
    assert len(counted) == 1 and not {(1, 10.0), (1, 12.0), (None, 10.0), (2, 7.0)} & counted[0]


def test_language_model_leaves_no_table_that_nothing_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_SCRATCH", [str(tmp_path)])
    kinds = lambda: sorted(p.name.split("-")[1] for p in tmp_path.glob("llm-*"))
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b d") for i in range(9)] + [(9, None)], "doc_id long, text string")
    model = backoff_lm.train(docs)
    assert kinds() == ["after", "after", "counts", "threes", "twos", "words"]
    assert backoff_lm.score(docs, model).where("score < 0").count() == 10
    assert kinds().count("rest") == 2
