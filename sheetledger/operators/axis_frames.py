"""Frames of axes: sheets that agree on where labelled axes stand, in both directions, and frames registered to each other.

Input rows say where a sheet (``source``) of a ``group`` has the axis of a ``label`` in a direction (``axis``: x or y).  All groups
and all their frames grow in one set of rounds: in a round each group's open frame takes in every waiting sheet that fits in both
directions, or, where none does, is closed and the next one is opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import write_down
from .common import null_safe_join
from .consensus import MAX_FRAME_RESIDUAL_M, axis_consensus, first_per_key, seed_sources
from .quantiles import small_median_by


def label_order(label: Column) -> Column:
    """Numbers by value before letters by alphabet."""
    text = F.trim(label)
    number = text.rlike(r"^\d+$")
    return F.struct((~number).alias("kind"), F.when(number, text.try_cast("decimal(38,0)")).alias("n"), F.when(~number, F.upper(text)).alias("t"))


def _fitted(rows: DataFrame, agreed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, axis, offset, residual: how rows of a sheet or frame (keys, axis, label, pos) lie to agreed positions (… , axis, label, at)."""
    shared = null_safe_join(rows, agreed, [k for k in agreed.columns if k != "at"]).withColumn("_diff", F.col("at") - F.col("pos"))
    offset = small_median_by(shared, [*keys, "axis"], "_diff", "offset")  # the labels of one sheet
    errors = null_safe_join(shared, offset, [*keys, "axis"])
    return null_safe_join(offset, small_median_by(errors, [*keys, "axis"], F.abs(F.col("offset") - F.col("_diff")), "residual"), [*keys, "axis"])


def _both(fit: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Keys that fit in both directions, with dx and dy."""
    side = lambda a: F.max(F.when(F.col("axis") == a, F.col("offset")))
    wide = fit.groupBy(*keys).agg(side("x").alias("dx"), side("y").alias("dy"), F.max("residual").alias("residual"))
    return wide.where(F.col("dx").isNotNull() & F.col("dy").isNotNull() & (F.col("residual") <= limit))


def _placed(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of members in the coordinates of their frame."""
    return null_safe_join(rows, members, ["group", "source"]).withColumn("pos", F.col("pos") + F.when(F.col("axis") == "x", F.col("dx")).otherwise(F.col("dy")))


def joint_frames(df: DataFrame, group: str, source: str, axis: str, label: str, pos: str, limit: float = MAX_FRAME_RESIDUAL_M) -> tuple[DataFrame, DataFrame]:
    """(members, axes) of the frames of every group.

    Members: group, frame, source, x_offset, y_offset, residual; a position plus the offset is its place in the frame.  Axes: group, frame,
    axis, label, pos, where the lowest label of a direction stands at 0.  Frames are numbered by the number of their members, largest first (then by the
    first member).  Sheets without labels in both directions are in none.  A frame starts from the sheet whose spacing is the commonest; it
    keeps sheets whose residual against the final positions is within ``limit`` in both directions, others wait for the next frame.
    """
    rows = df.where(F.col(pos).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(group).alias("group"), F.col(source).alias("source"), F.col(axis).alias("axis"), F.col(label).cast("string").alias("label")).agg(F.min(pos).cast("double").alias("pos"))
    usable = rows.groupBy("group", "source").agg(F.count_distinct("axis").alias("_d")).where("_d = 2").select("group", "source")
    rows = write_down(null_safe_join(rows, usable, ["group", "source"]))
    sheets = write_down(rows.select("group", "source").distinct())

    def opened(waiting: DataFrame, frame: Column) -> DataFrame:
        seeds = seed_sources(null_safe_join(rows.where("axis = 'x'"), waiting, ["group", "source"]), "group", "source", "pos")
        return seeds.select("group", "source", frame.alias("frame"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(True).alias("seed"))

    members = write_down(opened(sheets, F.lit(0)))
    state = write_down(members.select("group", "frame", F.lit(True).alias("open")))
    while True:
        active = null_safe_join(members, state.where("open"), ["group", "frame"]).drop("open")
        agreed = write_down(axis_consensus(_placed(rows, active), ["group", "axis"], "label", "pos").select("group", "axis", "label", F.col("pos").alias("at")))
        waiting = sheets.join(members, ["group", "source"], "left_anti")
        fits = _both(_fitted(null_safe_join(rows, waiting, ["group", "source"]), agreed, ["group", "source"]), ["group", "source"], limit)
        current = state.where("open").select("group", "frame")
        joined = write_down(null_safe_join(fits, current, ["group"]).select("group", "source", "frame", "dx", "dy", F.lit(False).alias("seed")))
        quiet = null_safe_join(current, joined.select("group").distinct().withColumn("_busy", F.lit(True)), ["group"], "left").where("_busy is null").drop("_busy")
        # a frame that nothing joined is closed: sheets that the final positions do not fit any more go back
        closing = null_safe_join(active, quiet, ["group", "frame"])
        held = _both(_fitted(null_safe_join(rows, closing.select("group", "source"), ["group", "source"]), agreed, ["group", "source"]), ["group", "source"], limit)
        released = closing.where("not seed").join(held, ["group", "source"], "left_anti").select("group", "source")
        after = write_down(members.join(released, ["group", "source"], "left_anti").unionByName(joined))
        free = write_down(null_safe_join(sheets.join(after, ["group", "source"], "left_anti"), quiet.withColumn("_next", F.col("frame") + 1).drop("frame"), ["group"]))
        seeds = null_safe_join(opened(free.select("group", "source"), F.lit(0)).drop("frame"), free.select("group", F.col("_next").alias("frame")).distinct(), ["group"])
        fresh = write_down(seeds.select(*after.columns))
        members = write_down(after.unionByName(fresh))
        state = write_down(null_safe_join(current, quiet.select("group").withColumn("_quiet", F.lit(True)), ["group"], "left").where("_quiet is null")
                            .select("group", "frame", F.lit(True).alias("open")).unionByName(fresh.select("group", "frame", F.lit(True).alias("open"))))
        if state.isEmpty():
            break
    return _settled(rows, members)


def _settled(rows: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers frames by size, moves the lowest label of a direction to 0, measures every member again."""
    sizes = members.groupBy("group", "frame").agg((-F.count("*")).alias("_n"), F.min("source").alias("_s"))
    number = sizes.select("group", "frame", (F.row_number().over(W.partitionBy("group").orderBy("_n", "_s")) - 1).alias("_f"))  # a row per frame
    named = write_down(null_safe_join(members, number, ["group", "frame"]).select("group", F.col("_f").alias("frame"), "source", "dx", "dy"))
    agreed = write_down(axis_consensus(_placed(rows, named), ["group", "frame", "axis"], "label", "pos"))
    origin = agreed.groupBy("group", "frame", "axis").agg(F.min_by("pos", label_order(F.col("label"))).alias("_0"))
    axes = write_down(null_safe_join(agreed, origin, ["group", "frame", "axis"]).select(
        "group", "frame", "axis", "label", F.round(F.col("pos") - F.col("_0"), 4).alias("pos")))
    own = null_safe_join(rows, named.select("group", "source", "frame"), ["group", "source"])
    fit = _fitted(own, axes.withColumnRenamed("pos", "at"), ["group", "frame", "source"])
    side = lambda a: F.max(F.when(F.col("axis") == a, F.col("offset")))
    found = fit.groupBy("group", "frame", "source").agg(side("x").alias("x_offset"), side("y").alias("y_offset"), F.round(F.max("residual"), 4).alias("residual"))
    return found, axes


def register(axes: DataFrame, sizes: DataFrame, pinned: DataFrame | None = None, limit: float = MAX_FRAME_RESIDUAL_M) -> DataFrame:
    """group, frame, dx, dy: the shift of every frame against its group's anchor; null for frames that no shared label reaches.

    ``axes``: group, frame, axis, label, pos; ``sizes``: group, frame, n (members).  The anchor is the largest frame (then the lowest number), or
    the ``pinned`` frames (group, frame, dx, dy).  Shifts spread in rounds over shared labels: a frame is taken if it fits the labels placed so far within ``limit``.
    All frames of a group that share labels in all their directions are taken at once; only if there is none, the largest one that shares labels in a single direction is, and
    its other direction is not shifted.  A label's first placed position stays.
    """
    every = write_down(sizes.select("group", "frame", "n"))
    rank = {"order": F.struct((-F.col("n")).alias("n"), "frame")}
    if pinned is None:
        done = first_per_key(every, ["group"], [F.desc("n"), F.asc("frame")]).select("group", "frame", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    else:
        loose = first_per_key(every.join(pinned.select("group").distinct(), "group", "left_anti"), ["group"], [F.desc("n"), F.asc("frame")])
        done = pinned.select("group", "frame", F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy")).unionByName(
            loose.select("group", "frame", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))
    done, pool = write_down(done), None

    def labels(frames: DataFrame) -> DataFrame:
        moved = null_safe_join(null_safe_join(axes, frames, ["group", "frame"]), every, ["group", "frame"]).withColumns(rank)
        at = F.col("pos") + F.when(F.col("axis") == "x", F.col("dx")).otherwise(F.col("dy"))
        return moved.groupBy("group", "axis", "label").agg(F.min_by(at, "order").alias("at"))

    sides = axes.groupBy("group", "frame").agg(F.count_distinct("axis").alias("_sides"))
    parts, fresh = [done], done
    while True:
        new = labels(fresh)
        pool = write_down(new if pool is None else pool.unionByName(new.join(pool, ["group", "axis", "label"], "left_anti")))
        taken = reduce(DataFrame.unionByName, parts)
        waiting = null_safe_join(axes, every.select("group", "frame").join(taken, ["group", "frame"], "left_anti"), ["group", "frame"])
        fit = _fitted(waiting, pool, ["group", "frame"])
        side = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("offset"))), F.lit(0.0))
        fits = fit.groupBy("group", "frame").agg(side("x").alias("dx"), side("y").alias("dy"), F.max("residual").alias("_r"), F.count("*").alias("_d")).where(F.col("_r") <= limit)
        judged = null_safe_join(null_safe_join(fits, sides, ["group", "frame"]), every, ["group", "frame"]).withColumn("_part", F.col("_d") < F.col("_sides"))
        turn = F.rank().over(W.partitionBy("group").orderBy("_part", F.when(F.col("_part"), F.struct((-F.col("n")).alias("n"), "frame"))))
        fresh = write_down(judged.withColumn("_t", turn).where("_t = 1").select("group", "frame", "dx", "dy"))
        if fresh.isEmpty():
            return null_safe_join(every.select("group", "frame"), taken, ["group", "frame"], "left")
        parts.append(fresh)
