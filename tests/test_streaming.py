"""Streams fed from several files, with a late row, next to their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from sheetledger.streaming import events as S
from sheetledger.streaming.tables import VersionedTable, drain, last_state

from conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(**kw):
    return T0 + dt.timedelta(**kw)


def feed(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_drop_rows_later_than_the_watermark(spark, tmp_path):
    # Spark judges lateness by the watermark of the batch before the last one
    parts = [[(at(hours=1), "a", 1.0)], [(at(days=3), "a", 2.0)], [(at(days=3), "b", 4.0)], [(at(hours=2), "a", 100.0), (at(days=3, hours=1), "a", 3.0)]]
    stream = feed(spark, str(tmp_path / "in"), parts, "ts timestamp, k string, v double")
    out = last_state(drain(S.cost_windows(stream, "ts", "k", F.col("v"), F.col("v") > 50), str(tmp_path / "w"), "update"), ["start", "k"])
    assert rows(out, "start", "calls", "cost") == [(at(), 1, 1.0), (at(days=3), 1, 4.0), (at(days=3), 2, 5.0)]


def test_trailing_windows_count_an_event_in_one_pane(spark, tmp_path):
    parts = [[(at(hours=1), "a", 1.0), (at(hours=5), "a", 2.0)], [(at(days=1, hours=2), "a", 60.0)], [(at(days=6), "b", 4.0)], [(at(hours=2), "a", 100.0)], [(at(days=9), "b", 8.0)]]
    schema = "ts timestamp, k string, v double"
    out = drain(S.cost_trailing(feed(spark, str(tmp_path / "in"), parts, schema), "ts", "k", F.col("v"), F.col("v") > 50, "3 days", "1 day"), str(tmp_path / "t"))
    closed = {(k, at(days=d)): (n, e, c) for k, d, n, e, c in [("a", -2, 2, 0, 3.0), ("a", -1, 3, 1, 63.0), ("a", 0, 3, 1, 63.0), ("a", 1, 1, 1, 60.0), ("b", 4, 1, 0, 4.0), ("b", 5, 1, 0, 4.0)]}
    got = {(r.k, r.start): (r.calls, r.errors, r.cost) for r in out.collect()}
    assert got == closed and out.count() == len(closed)


def test_closed_sessions_come_out_once_and_leave_the_state(spark, tmp_path):
    parts = [[("a", at(minutes=1)), ("a", at(minutes=20)), ("b", at(minutes=5))], [("a", at(minutes=45))], [("b", at(hours=9))], [("b", at(hours=10))]]
    stream = S.sessions(feed(spark, str(tmp_path / "in"), parts, "who string, ts timestamp"), "who", "ts")
    out = drain(stream, str(tmp_path / "s"))
    assert rows(out, "who", "start", "actions") == [("a", at(minutes=1), 3), ("b", at(minutes=5), 1)]
    state = spark.read.format("statestore").load(str(tmp_path / "s" / "checkpoint"))
    assert {r.who for r in state.select("key.who").collect()} == {"b"}  # what is open alone


def test_suggestions_equal_the_batch_twin(spark, tmp_path):
    def part(day, built=()):
        return [(p, at(days=day, hours=h), "changed") for p in (1, 2) for h in range(3)] + [(p, at(days=day, hours=1, minutes=30), "built") for p in built]

    parts, schema = [part(0), part(1, built=[2]), part(2)], "project long, ts timestamp, kind string"
    state = S.SuggestionState(spark, str(tmp_path / "state"), 5, 2)
    S.run_batches(feed(spark, str(tmp_path / "in"), parts, schema), state.process, str(tmp_path / "c"))
    whole = spark.createDataFrame([r for p in parts for r in p], schema)
    assert rows(state.suggestions(), "project", "changed") == rows(S.suggestions_batch(whole, 5), "project", "changed") == [(1, 9)]


def test_upsert_replay_changes_nothing(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", 4)
    table.upsert(spark.createDataFrame([(1, 1), (2, 1)], "k long, v long"), 0, [F.desc("v")])
    for _ in range(2):
        table.upsert(spark.createDataFrame([(2, 5), (2, 4), (3, 5)], "k long, v long"), 1, [F.desc("v")])
    assert rows(table.current()) == [(1, 1), (2, 5), (3, 5)]


def test_late_builds_close_only_what_came_before_them(spark, tmp_path):
    schema = "project long, ts timestamp, kind string"
    changes = [(1, at(hours=h), "changed") for h in (10, 11, 12)]
    feeds = {"older": ([*changes, (1, at(hours=9), "built")], [(1, at(hours=8), "built")], 3), "between": (changes, [(1, at(hours=10, minutes=30), "built")], 2),
             "too late": ([*changes, (1, at(days=9), "changed")], [(1, at(hours=11), "built")], 4), "newer": (changes, [(1, at(hours=13), "built"), (1, at(hours=14), "changed")], 1)}
    for name, (first, second, n) in feeds.items():
        state = S.SuggestionState(spark, str(tmp_path / name), 1, 2, late="1 day")
        for i, part in enumerate((first, second, [(2, at(), "changed")])):
            state.process(spark.createDataFrame(part, schema), i)
        assert rows(state.suggestions().where("project = 1"), "changed") == [(n,)], name


def test_a_broken_table_is_not_an_empty_one(spark, tmp_path):
    import pytest

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        VersionedTable(spark, str(tmp_path / "t"), ["k"], "k long", 2).current().collect()
    assert VersionedTable(spark, str(tmp_path / "none"), ["k"], "k long", 2).current().count() == 0


def test_stale_work_is_reaped_by_the_event_clock(spark, tmp_path):
    parts = [[(1, at(), "extracting"), (2, at(), "extracting")], [(2, at(hours=1), "ready")], [(9, at(days=2), "ready")], [(9, at(days=3), "ready")]]
    stream = feed(spark, str(tmp_path / "in"), parts, "item long, ts timestamp, status string")
    out = drain(S.reap(stream, "item", "ts", "status", 5.0, 3), str(tmp_path / "r"))
    assert rows(out, "item", "reap_attempts", "requeue") == [(1, 1, True)]


def test_learning_loop_stops_counting_adopted_rules(spark, tmp_path):
    def part(n, first):
        return [("discipline", "建筑", None, '{"raw_text": "建 个人"}', first + i) for i in range(n)] + [("discipline", "电气", None, '{"raw_text": "电 气"}', first + 50)]

    loop = S.LearningLoop(spark, str(tmp_path / "l"))
    schema = "kind string, human_value string, auto_value string, context string, event_id long"
    loop.process(spark.createDataFrame(part(3, 0), schema), 0)
    assert rows(loop.suggestions(), "raw", "times") == [("建 个人", 3)]
    loop.adopt(loop.suggestions(), 0)
    for run in (1, 2):
        loop.process(spark.createDataFrame(part(4, run * 100), schema), run)
    assert rows(loop.suggestions(), "raw", "times") == [("电 气", 3)]
