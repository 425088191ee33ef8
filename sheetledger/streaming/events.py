"""Structured Streaming operators (STM) and their batch twins."""

from __future__ import annotations

from typing import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dates import stale
from ..operators import evidence as E
from ..operators.joins import changed_since
from ..sources.tables import SCHEMAS
from .tables import VersionedTable, read_batches, write_batch


def event_stream(spark: SparkSession, directory: str, pattern: str = "events*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream, a few files to a micro-batch."""
    return (spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(directory))


# ---- STM-01 ---------------------------------------------------------------------------

def once(stream: DataFrame, key: str, ts: str, horizon: str) -> DataFrame:
    """Each event once, repeats within the horizon dropped."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def dispatch(stream: DataFrame, kind: str, handlers: Mapping[str, str]) -> DataFrame:
    """Route by type; an unknown type is skipped and says so."""
    route = F.lit(None).cast("string")
    for name, handler in handlers.items():
        route = F.when(F.col(kind) == name, F.lit(handler)).otherwise(route)
    return stream.withColumn("handler", route).withColumn("status", F.when(F.col("handler").isNull(), "skipped").otherwise("done"))


def branches(routed: DataFrame, handlers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """One DataFrame per handler name."""
    return {name: fn(routed.where(F.col("handler") == name)) for name, fn in handlers.items()}


# ---- STM-02 ---------------------------------------------------------------------------

class SuggestionState:
    """Changes per project since its last build; at the threshold one suggestion is open and is refreshed.

    Changes of the last ``late`` are kept as counts by time, so a build that arrives late closes what came before it and
    keeps what came after; older ones are one number, and a build that is later still than ``late`` changes nothing.  A
    micro-batch is reduced per project and time before it meets the state.
    """

    SCHEMA = "project long, changed long, built timestamp, status string, newest timestamp, settled long, counts array<struct<ts:timestamp,n:long>>"

    def __init__(self, spark: SparkSession, path: str, threshold: int, buckets: int = 64, late: str = "1 day"):
        self.table, self.threshold, self.late = VersionedTable(spark, path, ["project"], self.SCHEMA, buckets), threshold, F.expr(f"interval {late}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: project, ts, kind ('changed' or 'built')."""
        times = batch.groupBy("project", "ts").agg(F.count_if(F.col("kind") == "changed").alias("n"), F.max(F.col("kind") == "built").alias("_is"))
        news = times.groupBy("project").agg(F.collect_list(F.when(F.col("n") > 0, F.struct("ts", "n"))).alias("_new"), F.collect_list(F.when(F.col("_is"), F.col("ts"))).alias("_bs"), F.max("ts").alias("_top"))
        seen = news.join(self.table.current(batch_id), "project", "left")
        none, zero = F.array().cast("array<struct<ts:timestamp,n:bigint>>"), F.lit(0).cast("long")
        horizon = F.col("newest") - self.late
        build = F.array_max(F.filter("_bs", lambda b: horizon.isNull() | (b >= horizon)))
        fresh = F.coalesce(build > F.col("built"), build.isNotNull())
        marks = seen.withColumn("_fresh", F.coalesce(build > F.col("built"), build.isNotNull())).select(
            "project", F.greatest("built", build).alias("_built"), F.greatest("newest", "_top").alias("_newest"),
            F.when(F.col("_fresh"), zero).otherwise(F.coalesce("settled", zero)).alias("_old"), F.concat(F.coalesce("counts", none), "_new").alias("_all"))
        marks = marks.withColumnsRenamed({"_built": "built", "_newest": "newest"})
        open_ = marks.withColumn("_open", F.filter("_all", lambda c: F.coalesce(c["ts"] > F.col("built"), F.lit(True))))
        add = lambda items: F.aggregate(items, zero, lambda a, c: a + c["n"])
        edge = F.col("newest") - self.late
        changed = F.col("_old") + add(F.col("_open"))
        rows = open_.select("project", changed.alias("changed"), "built", F.when(changed >= self.threshold, "open").otherwise("none").alias("status"), "newest",
                            (F.col("_old") + add(F.filter("_open", lambda c: c["ts"] < edge))).alias("settled"), F.filter("_open", lambda c: c["ts"] >= edge).alias("counts"))
        self.table.upsert(rows, batch_id, [F.col("changed").desc()])

    def suggestions(self) -> DataFrame:
        return self.table.current().where("status = 'open'").select("project", "changed", "built")


def suggestions_batch(events: DataFrame, threshold: int) -> DataFrame:
    """Batch twin of ``SuggestionState`` for events in time order."""
    marks = events.where("kind = 'built'").groupBy("project").agg(F.max("ts").alias("built"))
    counts = changed_since(events.where("kind = 'changed'"), marks, "project", "ts", "built").groupBy("project").agg(
        F.count("*").alias("changed"), F.max("built").alias("built"))
    return counts.where(F.col("changed") >= threshold)


# ---- STM-03 … STM-05: windows ----------------------------------------------------------

def _costs(grouped, cost: Column, failed: Column) -> DataFrame:
    return grouped.agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.sum(cost.cast("decimal(28,4)")).cast("double").alias("cost"))


def cost_windows(stream: DataFrame, ts: str, key: str, cost: Column, failed: Column, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Calls, errors and cost per tumbling window; rows later than the watermark are dropped."""
    out = _costs(stream.withWatermark(ts, late).groupBy(F.window(ts, size), key), cost, failed)
    return out.select(F.col("window.start").alias("start"), key, "calls", "errors", "cost")


def cost_sliding(stream: DataFrame, ts: str, key: str, cost: Column, failed: Column, size: str = "30 days", step: str = "1 day",
                 late: str = "2 hours") -> DataFrame:
    """Trailing window per engine.  Rows are summed per step first in the batch twin; here Spark's window
    function replicates a row once per open window before the partial aggregation."""
    out = _costs(stream.withWatermark(ts, late).groupBy(F.window(ts, size, step), key), cost, failed)
    return out.select(F.col("window.start").alias("start"), key, "calls", "errors", "cost")


def cost_trailing(stream: DataFrame, ts: str, key: str, cost: Column, failed: Column, size: str = "30 days", step: str = "1 day",
                  late: str = "2 hours") -> DataFrame:
    """Trailing windows from panes, for append mode: closed windows only, each once.

    A first stateful step sums rows per pane of one step, a second one deals out closed panes to the windows over them.  An event
    is counted in one pane, however many windows are open; only a pane's single row is repeated.
    """
    panes = _costs(stream.withWatermark(ts, late).groupBy(F.window(ts, step), key), cost, failed)
    sums = panes.groupBy(F.window(F.window_time("window"), size, step), key).agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum(F.col("cost").cast("decimal(28,4)")).cast("double").alias("cost"))
    return sums.select(F.col("window.start").alias("start"), key, "calls", "errors", "cost")


def sessions(stream: DataFrame, who: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Work sessions of a reviewer: a gap longer than the limit starts a new one.

    In append mode a session comes out once, when the watermark has passed its end, and leaves the state; in complete mode all stay.
    """
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), who).agg(F.count("*").alias("actions"))
    return grouped.select(who, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "actions")


# ---- STM-06 ---------------------------------------------------------------------------

def batch_status(reports: DataFrame, members: DataFrame, batch: str, item: str, status: str, order: Sequence[str]) -> DataFrame:
    """done / failed / partial when all members of a batch are terminal, running with progress until then."""
    last = reports.groupBy(item).agg(F.max_by(status, F.struct(*order)).alias("_s"))
    counts = members.select(batch, item).join(last, item, "left").groupBy(batch).agg(
        F.count("*").alias("total"), F.count_if(F.col("_s") == "done").alias("done"), F.count_if(F.col("_s") == "failed").alias("failed"))
    open_ = F.col("total") - F.col("done") - F.col("failed")
    state = (F.when(open_ > 0, "running").when(F.col("failed") == 0, "done").when(F.col("failed") == F.col("total"), "failed").otherwise("partial"))
    return counts.select(batch, "total", "done", "failed", state.alias("state"), F.round((F.col("done") + F.col("failed")) / F.col("total"), 4).alias("progress"))


class BatchCompletion:
    """Keeps the last status per member; batch states are read from it and the static membership."""

    def __init__(self, spark: SparkSession, path: str, item_type: str = "long", buckets: int = 64):
        self.table = VersionedTable(spark, path, ["item"], f"item {item_type}, status string, ts timestamp, seq long", buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        newest = batch.unionByName(self.table.current(batch_id).join(batch.select("item").distinct(), "item", "left_semi"))
        self.table.upsert(newest, batch_id, [F.desc("ts"), F.desc("seq")])

    def states(self, members: DataFrame, batch: str) -> DataFrame:
        return batch_status(self.table.current(), members, batch, "item", "status", ["ts", "seq"])


# ---- STM-07 ---------------------------------------------------------------------------

def plan_reap(df: DataFrame, now: str, hours: float, max_attempts: int, status: str = "status", started: str = "started_at",
              attempts: str = "attempts", active: str = "extracting") -> DataFrame:
    """Batch form: work active for too long is reset; it is requeued at most ``max_attempts`` times."""
    tries = F.coalesce(attempts, F.lit(0)) + 1
    return df.where(stale(F.col(started), F.col(status) == active, now, hours)).withColumn("next_status", F.lit("pending")).withColumn(
        "reap_attempts", tries).withColumn("requeue", tries <= max_attempts)


def reap(stream: DataFrame, item: str, ts: str, status: str, hours: float, max_attempts: int, late: str = "1 hour", active: str = "extracting") -> DataFrame:
    """Stream form with an event-time timer per work item (one small state each): item, reaped_at, reap_attempts, requeue."""
    limit_ms = int(hours * 3_600_000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, tries = state.get if state.exists else (0, 0)
        out = None  # most calls have nothing to tell, and a table for each would cost more than the fold
        if state.hasTimedOut:
            tries += 1
            out = pd.DataFrame([(key[0], pd.Timestamp(since + limit_ms, unit="ms"), tries, tries <= max_attempts)], columns=["item", "reaped_at", "reap_attempts", "requeue"])
            since = 0
        else:
            last = None
            for batch in batches:  # the latest row counts, of equal times the one that comes last
                times = batch["_ts"].to_numpy()
                at = len(times) - 1 - int(times[::-1].argmax())
                if last is None or times[at] >= last[0]:
                    last = times[at], batch["_status"].to_numpy()[at]
            since = int(last[0].astype("datetime64[ms]").astype("int64")) if last[1] == active else 0
        state.update((since, tries))
        if since:
            state.setTimeoutTimestamp(max(since + limit_ms, state.getCurrentWatermarkMs() + 1))
        if out is not None:
            yield out

    rows = stream.select(F.col(item).cast("long").alias("item"), F.col(ts).alias("_ts"), F.col(status).alias("_status")).withWatermark("_ts", late)
    return rows.groupBy("item").applyInPandasWithState(
        fold, "item long, reaped_at timestamp, reap_attempts int, requeue boolean", "since long, tries int", "append", GroupStateTimeout.EventTimeTimeout)


# ---- STM-09 … STM-11 -------------------------------------------------------------------

def sink_upsert(stream: DataFrame, table: VersionedTable, order: Sequence[Column], checkpoint: str):
    """Micro-batch upsert; the batch id makes a replay harmless."""
    return (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda df, batch_id: table.upsert(df, batch_id, order)).start())


def run_batches(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed what is there to a batch function, once per batch id."""
    (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .foreachBatch(process).start().awaitTermination())


def enrich_stream(stream: DataFrame, dim: DataFrame, stream_key: str, dim_key: str, how: str = "left") -> DataFrame:
    """Stream joined to a snapshot of a dimension."""
    return stream.join(dim, F.col(stream_key) == F.col(dim_key), how)


def first_pair(a: DataFrame, b: DataFrame, key: str, ts: str, within: str, horizon: str = "60 days") -> DataFrame:
    """First upload with first proposal inside a time bound: key, first_a, first_b, hours.

    Each side is thinned to the first event of a key before the join, so a busy key joins one row to one row.
    """
    left = a.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key]).select(F.col(key), F.col(ts).alias("first_a"))
    right = b.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key]).select(F.col(key).alias("_k"), F.col(ts).alias("first_b"))
    bound = (F.col("first_b") >= F.col("first_a")) & (F.col("first_b") <= F.col("first_a") + F.expr(f"interval {within}"))
    joined = left.join(right, (F.col(key) == F.col("_k")) & bound)
    return joined.select(key, "first_a", "first_b", F.round((F.unix_micros("first_b") - F.unix_micros("first_a")) / 3.6e9, 2).alias("hours"))


# ---- STM-12 ---------------------------------------------------------------------------

class LearningLoop:
    """Annotation events scanned in runs: evidence per (raw, corrected) pair is summed over the runs, enough of it
    becomes a suggestion, and adopted suggestions are rules whose pairs the next runs no longer count."""

    COUNTS = "raw string, corrected string, times long"

    def __init__(self, spark: SparkSession, path: str, min_evidence: int = E.MIN_EVIDENCE):
        self.spark, self.path, self.min_evidence = spark, path, min_evidence

    def rules(self) -> DataFrame:
        return read_batches(self.spark, f"{self.path}/rules", "raw string, corrected string").select("raw", "corrected").distinct()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        counts = E.corrections(batch, 1).select("raw", "corrected", "times")
        write_batch(counts.join(self.rules(), ["raw", "corrected"], "left_anti"), f"{self.path}/counts", batch_id)

    def suggestions(self) -> DataFrame:
        """By impact, adopted ones left out."""
        totals = read_batches(self.spark, f"{self.path}/counts", self.COUNTS).groupBy("raw", "corrected").agg(F.sum("times").alias("times"))
        live = totals.join(self.rules(), ["raw", "corrected"], "left_anti").where(F.col("times") >= self.min_evidence)
        return live.withColumn("confidence", F.round(F.least(F.lit(0.4) + F.col("times") * 0.12, F.lit(0.9)), 4)).orderBy(F.desc("times"), "raw", "corrected")

    def adopt(self, accepted: DataFrame, run: int) -> None:
        write_batch(accepted.select("raw", "corrected"), f"{self.path}/rules", run)
