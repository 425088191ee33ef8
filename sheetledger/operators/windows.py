"""Window functions and ordered scans (WIN)."""

from __future__ import annotations

from typing import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import each_block, null_safe_join
from .ordered import Run, islands, neighbour, numbered, running, scan
from .quantiles import exact_quantiles, median_by
from .ranks import inverted_pairs, longest_runs


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order (Spark applies the rank limit before the shuffle too)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def archive_key(category: Column, content: Column, number: Column, label: Column) -> Column:
    """Key under which two records say the same: parsed number for elevations and dimensions, label for
    axes, else the trimmed text."""
    plain = F.concat(category, F.lit(":"), F.trim(F.coalesce(content, F.lit(""))))
    return (F.when((category == "elevation") & number.isNotNull(), F.concat(F.lit("elevation:"), F.round(number, 3)))
            .when((category == "dimension") & number.isNotNull(), F.concat(F.lit("dimension:"), F.round(number, 1)))
            .when((category == "axis") & (label != ""), F.concat(F.lit("axis:"), F.trim(label))).otherwise(plain))


def effective(df: DataFrame, scope: Sequence[str], tie: str) -> DataFrame:
    """Best row per (scope, category, key).

    Input: category, key, source_kind, supersedes_key, is_active, confidence.  A verified row beats
    automatic ones and suppresses those under the key it supersedes; inactive rows are out; a missing
    confidence counts as 1.
    """
    gone = (df.where("source_kind = 'verified' and supersedes_key is not null and supersedes_key <> ''")
            .select(*scope, "category", F.col("supersedes_key").alias("key")).distinct().withColumn("_gone", F.lit(True)))
    live = null_safe_join(df.where(F.coalesce("is_active", F.lit(True))), gone, [*scope, "category", "key"], "left")
    kept = live.where(~(F.coalesce("_gone", F.lit(False)) & (F.col("source_kind") == "auto"))).drop("_gone")
    return latest(kept, [*scope, "category", "key"], [
        (F.col("source_kind") == "verified").desc(), F.coalesce("confidence", F.lit(1.0)).desc(), F.asc(tie)])


def choose(df: DataFrame, keys: Sequence[str], source: str, conf: str, priority: Mapping[str, int], tie: str) -> DataFrame:
    """Source priority first, then confidence."""
    rank = F.lit(0)
    for name, value in priority.items():
        rank = F.when(F.col(source) == name, value).otherwise(rank)
    return latest(df, keys, [rank.desc(), F.desc(conf), F.asc(tie)])


def gap_median(df: DataFrame, reviewer: str, ts: str, tie: str) -> DataFrame:
    """Median seconds between adjacent actions of one reviewer; actions without reviewer are pooled."""
    rows = df.where(F.col(ts).isNotNull()).select(F.coalesce(F.col(reviewer).cast("string"), F.lit("unknown")).alias("_who"), ts, tie)
    lagged = neighbour(rows, ["_who"], [ts, tie], {"_prev": ts}, -1)
    gaps = lagged.select(((F.unix_micros(ts) - F.unix_micros("_prev")) / 1e6).alias("_g")).where("_g is not null")
    out = median_by(gaps, [], "_g", "_m", "sample_size")
    return df.sparkSession.range(1).select().join(out, F.lit(True), "left").select(
        F.round("_m", 1).alias("median_seconds"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))


# Reasonable story heights, tolerance of the cross check.
MIN_STORY_HEIGHT_M, MAX_STORY_HEIGHT_M, CONSISTENCY_TOLERANCE_M = 2.5, 9.0, 0.05


def heights(df: DataFrame, keys: Sequence[str], order: Sequence[str], elevation: str) -> DataFrame:
    """Height = next elevation − this one; null for the last; with a reasonableness flag."""
    rows = neighbour(df.where(F.col(elevation).isNotNull()), keys, order, {"_next": elevation}, 1)
    height = F.round(F.col("_next") - F.col(elevation), 3)
    return rows.withColumn("height", height).withColumn(
        "reasonable", F.col("height").between(MIN_STORY_HEIGHT_M, MAX_STORY_HEIGHT_M)).drop("_next")


def elevations(df: DataFrame, base: DataFrame, keys: Sequence[str], order: Sequence[str], height: str,
               base_flag: Column) -> DataFrame:
    """Elevations from a base story upwards and downwards; stops at the first missing height.

    The height of a story leads to the next one, so with P the heights below a story and N the
    missing ones below it, elevation = base + P − P(base) wherever N = N(base).
    """
    rows = scan(df, keys, order, runs={"_p": Run(F.coalesce(height, F.lit(0.0)), before=True), "_m": Run(F.col(height).isNull().cast("long"), before=True)})
    start = rows.where(base_flag).groupBy(*keys).agg(F.min(F.struct("_p", "_m")).alias("_b"))
    joined = null_safe_join(null_safe_join(rows, start, keys), base, keys)
    return joined.where(F.col("_m") == F.col("_b._m")).select(
        *df.columns, F.round(F.col("base_elevation") + F.col("_p") - F.col("_b._p"), 3).alias("elevation"))


def cross_check(elevation_rows: DataFrame, height_rows: DataFrame, keys: Sequence[str], story: str, order: Sequence[str],
                elevation: str, height: str, tol: float = CONSISTENCY_TOLERANCE_M) -> DataFrame:
    """Stories whose derived height differs from the stated one by more than the tolerance."""
    derived = heights(elevation_rows, keys, order, elevation).select(*keys, story, F.col("height").alias("derived"))
    stated = height_rows.select(*keys, story, F.col(height).alias("stated"))
    diff = F.abs(F.col("derived") - F.col("stated"))
    return (derived.where("derived is not null").join(stated.where("stated is not null"), [*keys, story])
            .where(diff > tol).withColumn("diff", F.round(diff, 3)))


def monotone(df: DataFrame, keys: Sequence[str], order: str, value: str, support: str) -> DataFrame:
    """Increasing run of levels; on a clash the better supported side stays.

    A unit's levels (one row per story: a short list) are folded inside the JVM.  A new level puts out those above
    the last one that holds its ground, by a smaller value or no less support, and enters if it is higher than that one.
    """
    rows = df.where(F.col(value).isNotNull())
    level = F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.col(support).alias("s"))
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(level)).alias("_l"))
    kind = lists.schema["_l"].dataType

    def enter(run: Column, new: Column) -> Column:
        firm = F.array_max(F.transform(run, lambda old, i: F.when((old["v"] < new["v"]) | (old["s"] >= new["s"]), i + 1).otherwise(0)))
        stay = F.slice(run, F.lit(1), F.coalesce(firm, F.lit(0)))
        last = F.get(stay, F.size(stay) - 1)["v"]
        return F.when(last.isNull() | (last < new["v"]), F.concat(stay, F.array(new))).otherwise(stay)

    runs = lists.select(*keys, F.transform(F.aggregate("_l", F.array().cast(kind), enter), lambda x: x["o"]).alias("_kept"))
    return null_safe_join(rows, runs, keys).withColumn("kept", F.array_contains("_kept", F.col(order))).drop("_kept")


# When a direction is too disordered to use.
MAX_OUTLIER_RATIO, MIN_OUTLIERS_TO_DROP = 0.2, 2


def lis_outliers(df: DataFrame, keys: Sequence[str], pos: str, rank: str, tie: str) -> DataFrame:
    """Per direction: how many rows lie off a longest strictly increasing run of ranks in position order; null ranks always do."""
    longest = longest_runs(df.where(F.col(rank).isNotNull()), keys, [pos, tie], rank)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("total"))
    off = F.col("total") - F.coalesce("length", F.lit(0))
    return null_safe_join(sizes, longest, keys, "left").select(
        *keys, "total", off.alias("outliers"), ((off >= MIN_OUTLIERS_TO_DROP) & (off / F.col("total") >= MAX_OUTLIER_RATIO)).alias("drop"))


def inversions(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Share of inverted pairs (earlier row, larger value), null under three rows; null values are in no such pair."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    found = inverted_pairs(df.where(F.col(value).isNotNull()), keys, order, value)
    return null_safe_join(sizes, found, keys, "left").select(
        *keys, "n", F.when(F.col("n") >= 3, F.coalesce("inverted", F.lit(0)) / pairs).alias("inversion_rate"))


# Column gaps in reading order.
COLUMN_GAP_FACTOR, MIN_COLUMN_GAP, SAME_LINE_TOLERANCE = 6.0, 40.0, 3.0


def split_by_gap(df: DataFrame, keys: Sequence[str], pos: str, tie: str, factor: float = COLUMN_GAP_FACTOR,
                 minimum: float = MIN_COLUMN_GAP, alias: str = "island") -> DataFrame:
    """Columns by large gaps: threshold = max(factor × median of the lower half of the gaps, minimum)."""
    rows = cut_lineage(neighbour(df, keys, [pos, tie], {"_prev": pos}, -1).withColumn("_gap", F.col(pos) - F.col("_prev")))
    half = lambda n: (F.greatest(F.lit(1), F.floor(n / 2)) - 1) / 2.0
    typical = exact_quantiles(rows, keys, "_gap", {"_typical": 0.25}, rank_of=half)
    joined = cut_lineage(null_safe_join(rows, typical, keys, "left"))
    starts = F.col("_prev").isNull() | (F.col("_gap") > F.greatest(F.col("_typical") * factor, F.lit(minimum)))
    return islands(joined, keys, [pos, tie], starts, alias).select(*df.columns, alias)


def failure_runs(df: DataFrame, keys: Sequence[str], ts: str, tie: str, ok: str, least: int = 5) -> DataFrame:
    """Runs of at least ``least`` failures one after another per key: when an engine went down, until when, and how often it failed."""
    rows = neighbour(df, keys, [ts, tie], {"_was": ok}, -1)
    marked = islands(rows, keys, [ts, tie], F.col("_was").isNull() | (F.col("_was") != F.col(ok)))
    return marked.where(~F.col(ok)).groupBy(*keys, "island").agg(
        F.min(ts).alias("down_at"), F.max(ts).alias("last_at"), F.count("*").alias("failures")).where(F.col("failures") >= least).drop("island")


def merge_spans(df: DataFrame, keys: Sequence[str], low: str, high: str, tie: str, tol: float) -> DataFrame:
    """Overlapping or near spans (gap ≤ tol) to their envelopes."""
    rows = running(df, keys, [low, tie], F.col(high), "_reach", "max", before=True)
    starts = F.col("_reach").isNull() | (F.col(low) - F.col("_reach") > tol)
    marked = islands(rows, keys, [low, tie], starts)
    return marked.groupBy(*keys, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("pieces"))


def row_bands(df: DataFrame, keys: Sequence[str], pos: str, tol: float) -> DataFrame:
    """Values in rows when within ``tol`` of the row's first value; adds ``row_no`` from 1 per key.

    A gap above ``tol`` always starts a row, so the anchored scan runs on gap-free islands only, and
    on their distinct values: what one task holds is bounded by length over resolution.
    """
    spots = df.where(F.col(pos).isNotNull()).select(*keys, F.col(pos).alias("_y")).distinct()
    prev = neighbour(spots, keys, ["_y"], {"_prev": "_y"}, -1)
    starts = F.col("_prev").isNull() | (F.col("_y") - F.col("_prev") > tol)
    marked = islands(prev, keys, ["_y"], starts)

    def anchor(block: dict) -> dict:
        ys, flags, first = block["_y"], np.zeros(len(block["_y"]), dtype=np.int64), None
        for i, y in enumerate(ys):
            if first is None or y - first > tol:
                first, flags[i] = y, 1
        return {"_new": flags}

    flagged = cut_lineage(each_block(marked, [*keys, "island"], ["_y"], anchor, [*keys, "_y"], "_new long"))
    rows = islands(flagged, keys, ["_y"], F.col("_new") == 1, "row_no").select(*keys, F.col("_y").alias(pos), "row_no")
    return null_safe_join(df, rows, [*keys, pos], "left")


def missing_between(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Orders missing between the lowest and the highest of a key (floors: a small domain)."""
    sets = df.groupBy(*keys).agg(F.array_sort(F.collect_set(order)).alias("present"))
    every = F.sequence(F.element_at("present", 1), F.element_at("present", -1))
    return sets.withColumn("missing", F.array_except(every, "present")).where(F.size("missing") > 0)


def dedupe_near(df: DataFrame, item: str, x: str, y: str, score: str, tol: float) -> DataFrame:
    """Drop items closer than ``tol`` to a better kept one (score, then lower id): the greedy result.

    Cells have side tol/√2, so one cell keeps one item at most.  In each round the best of a cell
    wins when it beats the best of the two rings of cells around it; it strikes out what lies within
    ``tol``.  No pairs of items are formed and dense cells shrink to their best row map-side.
    """
    side = tol / 2 ** 0.5
    rings = F.array(*[F.lit(i) for i in range(-2, 3)])
    around = lambda f: (f.withColumn("_dx", F.explode(rings)).withColumn("_dy", F.explode(rings))
                        .withColumn("_nx", F.col("_cx") + F.col("_dx")).withColumn("_ny", F.col("_cy") + F.col("_dy")))
    rank = F.struct(F.col("_s"), (-F.col("_id")).alias("_i"))
    live = cut_lineage(df.select(F.col(item).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(score).alias("_s"),
                                 F.floor(F.col(x) / side).alias("_cx"), F.floor(F.col(y) / side).alias("_cy")))
    kept = None
    while not live.isEmpty():
        best = live.groupBy("_cx", "_cy").agg(F.max_by(F.struct("_id", "_x", "_y", "_s"), rank).alias("_b")).select("_cx", "_cy", "_b.*")
        top = around(best.select("_cx", "_cy", rank.alias("_r"))).groupBy(F.col("_nx").alias("_cx"), F.col("_ny").alias("_cy")).agg(F.max("_r").alias("_top"))
        won = cut_lineage(best.join(top, ["_cx", "_cy"]).where(rank == F.col("_top")).drop("_top"))
        kept = won if kept is None else kept.unionByName(won)
        reach = around(won).select(F.col("_nx").alias("_cx"), F.col("_ny").alias("_cy"), F.col("_x").alias("_wx"), F.col("_y").alias("_wy"))
        near = F.sqrt(F.pow(F.col("_x") - F.col("_wx"), 2) + F.pow(F.col("_y") - F.col("_wy"), 2)) < tol
        struck = live.join(reach, ["_cx", "_cy"]).where(near).select("_id").distinct()
        live = cut_lineage(live.join(struck, "_id", "left_anti"))
    if kept is None:
        return df.limit(0)
    return df.join(kept.select(F.col("_id").alias(item)), item, "left_semi")


def dedupe_boxes(df: DataFrame, item: str, score: str, keys: Sequence[str], threshold: float) -> DataFrame:
    """Drop boxes (x0, y0, x1, y1) that overlap a better kept one of the same keys by IoU ≥ threshold.

    Of equal boxes only the best meets others: whatever strikes it out strikes out its copies, and else it does so itself.
    """
    from .spatial import overlapping

    df = latest(df, [*keys, "x0", "y0", "x1", "y1"], [F.desc(score), F.asc(item)])
    scores = df.select(F.col(item).alias("_id"), F.struct(F.col(score), (-F.col(item)).alias("i")).alias("_r"))
    other = df.select(*keys, F.col(item).alias("_other"), "x0", "y0", "x1", "y1")
    pairs = overlapping(df.select(*keys, F.col(item).alias("_id"), "x0", "y0", "x1", "y1"), other, "_id", "_other", threshold, keys)
    edges = (pairs.where("_id <> _other").select("_id", "_other").join(scores, "_id")
             .join(scores.select(F.col("_id").alias("_other"), F.col("_r").alias("_ro")), "_other"))
    worse = cut_lineage(edges.where(F.col("_r") > F.col("_ro")).select(F.col("_id").alias("_hi"), F.col("_other").alias("_lo")))
    out = None
    while not worse.isEmpty():
        top = worse.select("_hi").distinct().join(worse.select(F.col("_lo").alias("_hi")), "_hi", "left_anti")
        struck = cut_lineage(worse.join(top, "_hi", "left_semi").select(F.col("_lo").alias("_id")).distinct())
        out = struck if out is None else out.unionByName(struck)
        gone = struck.withColumnRenamed("_id", "_lo")
        worse = cut_lineage(worse.join(gone, "_lo", "left_anti").join(gone.select(F.col("_lo").alias("_hi")), "_hi", "left_anti"))
    return df if out is None else df.join(out.select(F.col("_id").alias(item)), item, "left_anti")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str = "seq") -> DataFrame:
    """Dense index in page or directory order, for groups of any size."""
    return numbered(df, keys, order, alias)


# Letters used for axes, in order.
AXIS_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXY"


def expand_labels(df: DataFrame, start: str, count: str) -> DataFrame:
    """Start label and number of lines to one row per label (``idx`` from 0): 1, 2 … or A, B … AA; 2-1, 2-2 …"""
    letters = F.array(*[F.lit(c) for c in AXIS_LETTERS])
    label = F.upper(F.trim(start))
    number, sub, alpha = label.rlike(r"^\d+$"), label.rlike(r"^[0-9A-Z]+-\d+$"), label.rlike(r"^([A-HJ-NP-Y])\1*$")
    base = F.array_position(letters, F.substring(label, 1, 1)) - 1 + (F.length(label) - 1) * len(AXIS_LETTERS)
    rows = df.where((number | sub | alpha) & (F.col(count) > 0)).select(
        *df.columns, F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("idx"))
    at = base + F.col("idx")
    letter = F.expr("repeat(element_at(_l, int(_at % {n}) + 1), int(_at div {n}) + 1)".format(n=len(AXIS_LETTERS)))
    named = rows.withColumn("_l", letters).withColumn("_at", F.when(alpha, at)).withColumn("_letter", letter)
    value = (F.when(number, (label.try_cast("long") + F.col("idx")).cast("string"))
             .when(sub, F.concat(F.regexp_extract(label, r"^(.*)-", 1), F.lit("-"),
                                 (F.regexp_extract(label, r"-(\d+)$", 1).try_cast("long") + F.col("idx")).cast("string")))
             .otherwise(F.col("_letter")))
    return named.select(*df.columns, "idx", value.alias("label"))


def one_per_label(df: DataFrame, keys: Sequence[str], label: str, reliability: Sequence[Column]) -> DataFrame:
    """Most reliable line per label and direction, with how many rivals it had; blank labels all stay."""
    named = df.where(F.trim(label) != "")
    rivals = named.groupBy(*keys, label).agg((F.count("*") - 1).alias("conflicts"))
    first = null_safe_join(latest(named, [*keys, label], reliability), rivals, [*keys, label])
    return first.unionByName(df.where(F.col(label).isNull() | (F.trim(label) == "")).withColumn("conflicts", F.lit(0).cast("long")))


def modal_cluster(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Members of the fullest half-open band [v, v + width) that starts at a value (ties: the lowest).

    The window runs over distinct values with their counts.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = ", ".join(f"`{k}`" for k in keys)
    over = f"over ({'partition by ' + by if keys else ''} order by `{value}` range between"
    far = f"cast({width!r} as double) following"
    # the closed band less what lies on its far end
    sized = freq.withColumn("_band", F.expr(f"sum(_n) {over} current row and {far}) - coalesce(sum(_n) {over} {far} and {far}), 0)"))
    best = sized.groupBy(*keys).agg(F.max(F.struct("_band", (-F.col(value)).alias("_lo"))).alias("_m"))
    return null_safe_join(df, best, keys).where(
        (F.col(value) >= -F.col("_m._lo")) & (F.col(value) < -F.col("_m._lo") + width)).select(*df.columns)


def dominant_value(df: DataFrame, keys: Sequence[str], value: str, tol: float) -> DataFrame:
    """Mean of the largest chain of values whose neighbours are at most ``tol`` apart."""
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    prev = neighbour(freq, keys, ["_v"], {"_prev": "_v"}, -1)
    marked = islands(prev, keys, ["_v"], F.col("_prev").isNull() | (F.col("_v") - F.col("_prev") > tol))
    sums = marked.groupBy(*keys, "island").agg(F.sum("_n").alias("members"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct("members", "_mean"), F.struct("members", (-F.col("island")).alias("i"))).alias("_b"))
    return best.select(*keys, "_b.members", F.round("_b._mean", 2).alias("dominant"))
