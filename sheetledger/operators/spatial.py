"""Nearest, containment and overlap joins on plane geometry.

Boxes are filed under a cell size of their own scale (a power of two at least as large as the
longer side), so each box covers at most four cells and every join is an equi-join on
(scale, cell) followed by an exact test.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe_join
from .ordered import Run, scan

# Host tolerance, support margins, aligned band, parallel limit, row and gap tolerance.
OPENING_HOST_TOL, SUPPORT_BASE_TOL, SUPPORT_DIAG_RATIO = 0.3, 0.15, 0.5
SLAB_BEAM_BAND, PARALLEL_SIN_TOL = 0.3, 0.2
SAME_ROW_TOLERANCE, MAX_HORIZONTAL_GAP = 8.0, 120.0


def _scale_of(width: Column, height: Column) -> Column:
    return F.ceil(F.log2(F.greatest(width, height, F.lit(1e-9)))).cast("int")


def _cell(col: Column, scale: Column) -> Column:
    return F.floor(col / F.pow(F.lit(2.0), scale))


def nearest_1d(points: DataFrame, refs: DataFrame, keys: Sequence[str], pos: str, ref_id: str, tol: float) -> DataFrame:
    """Nearest reference on a line within ``tol``, else null (ties: the lower position, then id).

    Both sides are merged into one ordered scan that carries the last reference forward and the
    next one backward, so no point–reference pairs are made, however dense either side is.
    ``refs`` has ``keys``, ``pos`` and ``ref_id``; points keep all their columns.
    """
    slim = refs.select(*keys, F.col(pos).alias(pos), F.col(ref_id).alias("_rid")).dropDuplicates([*keys, pos, "_rid"])
    slim = slim.groupBy(*keys, pos).agg(F.min("_rid").alias("_rid"))
    rows = points.withColumn("_rid", F.lit(None).cast(slim.schema["_rid"].dataType)).withColumn("_is_ref", F.lit(0))
    both = rows.unionByName(slim.withColumn("_is_ref", F.lit(1)), allowMissingColumns=True)
    here = F.when(F.col("_is_ref") == 1, F.struct(F.col(pos).alias("p"), F.col("_rid").alias("r")))
    flipped = F.when(F.col("_is_ref") == 1, F.struct((-F.col(pos)).alias("p"), F.col("_rid").alias("r")))
    # references come before points at the same place; the hash lets points that share a place lie in several parts
    both = both.withColumn("_ord", -F.col("_is_ref")).withColumn("_tie", F.xxhash64(*points.columns))
    full = scan(both, keys, [pos, "_ord", "_tie"], runs={"_below": Run(here, "max"), "_above": Run(flipped, "max", reverse=True)})
    low = F.abs(F.col(pos) - F.col("_below.p"))
    high = F.abs(F.col(pos) + F.col("_above.p"))
    take_low = F.col("_above").isNull() | (low <= high)
    gap = F.when(take_low, low).otherwise(high)
    found = F.when(take_low, F.col("_below.r")).otherwise(F.col("_above.r"))
    return (full.where("_is_ref = 0")
            .select(*points.columns, F.when(gap <= tol, found).alias(ref_id), F.when(gap <= tol, gap).alias("gap")))


def grid_cell(x_label: Column, y_label: Column) -> Column:
    """``X-Y`` with ``?`` for a missing side, null when both are missing."""
    return F.when(x_label.isNull() & y_label.isNull(), None).otherwise(
        F.concat(F.coalesce(x_label, F.lit("?")), F.lit("-"), F.coalesce(y_label, F.lit("?"))))


def nearest_2d(points: DataFrame, refs: DataFrame, key: str, ref_id: str, tol: float,
               zoom: Sequence[int] = (16, 4, 1)) -> DataFrame:
    """Nearest reference in the plane strictly within ``tol``, else null.

    Searched from fine cells to coarse ones: a hit not farther than the cell side is final, so in
    a dense place a point meets only the few references of its own fine cells.
    """
    slim = refs.groupBy("x", "y").agg(F.min(ref_id).alias("_rid"))
    todo = points.select(key, F.col("x").alias("_px"), F.col("y").alias("_py"))
    found = None
    for step in zoom:
        side = tol / step
        shifts = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        near = (slim.withColumn("_dx", F.explode(shifts)).withColumn("_dy", F.explode(shifts))
                .select("x", "y", "_rid", (F.floor(F.col("x") / side) + F.col("_dx")).alias("_cx"),
                        (F.floor(F.col("y") / side) + F.col("_dy")).alias("_cy")))
        cells = (todo.withColumn("_cx", F.floor(F.col("_px") / side)).withColumn("_cy", F.floor(F.col("_py") / side)))
        dist = F.sqrt(F.pow(F.col("_px") - F.col("x"), 2) + F.pow(F.col("_py") - F.col("y"), 2))
        hits = (cells.join(near, ["_cx", "_cy"]).withColumn("_d", dist)
                .where((F.col("_d") <= side) & (F.col("_d") < tol))
                .groupBy(key).agg(F.min(F.struct("_d", "_rid")).alias("_hit")))
        found = hits if found is None else found.unionByName(hits)
        todo = todo.join(hits.select(key), key, "left_anti")
    return points.join(found, key, "left").select(
        *points.columns, F.col("_hit._rid").alias(ref_id), F.col("_hit._d").alias("gap"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every (point, box) with the point inside; points have x, y, boxes x0, y0, x1, y1."""
    scale = _scale_of(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    filed = boxes.withColumn("_s", scale)
    filed = (filed.withColumn("_cx", F.explode(F.sequence(_cell(F.col("x0"), F.col("_s")), _cell(F.col("x1"), F.col("_s")))))
             .withColumn("_cy", F.explode(F.sequence(_cell(F.col("y0"), F.col("_s")), _cell(F.col("y1"), F.col("_s"))))))
    # scales are binary exponents: a few dozen values whatever the number of boxes
    scales = boxes.agg(F.collect_set(scale).alias("_all"))
    looked = (null_safe_join(points, scales, []).withColumn("_s", F.explode("_all")).drop("_all")
              .withColumn("_cx", _cell(F.col("x"), F.col("_s"))).withColumn("_cy", _cell(F.col("y"), F.col("_s"))))
    joined = looked.join(filed, ["_s", "_cx", "_cy", *keys])
    return joined.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
                        ).drop("_s", "_cx", "_cy")


def enclosing(points: DataFrame, rects: DataFrame, key: str, rect_id: str, min_side: float = 0.0,
              sheet: Sequence[str] = ()) -> DataFrame:
    """Smallest rectangle around each point of the same sheet (ties: lower id); rectangles with a short
    side do not count."""
    fit = rects.where((F.col("x1") - F.col("x0") >= min_side) & (F.col("y1") - F.col("y0") >= min_side))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = (points_in_boxes(points.select(key, *sheet, "x", "y"), fit, sheet).groupBy(key)
            .agg(F.min(F.struct(area.alias("area"), F.col(rect_id).alias("rid"))).alias("_b")))
    return points.join(best, key, "left").select(*points.columns, F.col("_b.rid").alias(rect_id),
                                                 F.col("_b.area").alias("area"))


def _segment_distance(px: Column, py: Column) -> tuple[Column, Column]:
    """Distance to segment (ax, ay)-(bx, by) and the projection parameter."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - F.col("ax")) * dx + (py - F.col("ay")) * dy) / length).otherwise(F.lit(0.0))
    tc = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - F.col("ax") - tc * dx, 2) + F.pow(py - F.col("ay") - tc * dy, 2)), t


def opening_hosts(openings: DataFrame, walls: DataFrame, key: str, wall_id: str, sheet: Sequence[str] = ()) -> DataFrame:
    """Wall an opening sits in: within half width plus tolerance; several = nearest, none = orphan."""
    reach = F.col("width") / 2 + OPENING_HOST_TOL
    pad = reach + 0.05 * F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    boxed = walls.select(
        wall_id, *sheet, "ax", "ay", "bx", "by", reach.alias("_reach"),
        (F.least("ax", "bx") - pad).alias("x0"), (F.greatest("ax", "bx") + pad).alias("x1"),
        (F.least("ay", "by") - pad).alias("y0"), (F.greatest("ay", "by") + pad).alias("y1"))
    dist, t = _segment_distance(F.col("x"), F.col("y"))
    hits = (points_in_boxes(openings.select(key, *sheet, "x", "y"), boxed, sheet).withColumn("_d", dist).withColumn("_t", t)
            .where((F.col("_d") <= F.col("_reach")) & F.col("_t").between(-0.05, 1.05))
            .groupBy(key).agg(F.min(F.struct("_d", wall_id)).alias("_b"), F.count("*").alias("_n")))
    conf = F.when(F.col("_n").isNull(), 0.2).when(F.col("_n") == 1, 0.95).otherwise(0.7)
    return openings.join(hits, key, "left").select(
        *openings.columns, F.col(f"_b.{wall_id}").alias(wall_id), conf.alias("confidence"),
        F.col("_n").isNull().alias("orphan"))


def supports(ends: DataFrame, columns: DataFrame, key: Sequence[str], column_id: str, sheet: Sequence[str] = ()) -> DataFrame:
    """Column under each beam end: nearest box centre; inside the box 0.9, inside its margin 0.7."""
    diag = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    margin = SUPPORT_BASE_TOL + SUPPORT_DIAG_RATIO * diag
    grown = columns.select(
        column_id, *sheet, F.struct("x0", "y0", "x1", "y1").alias("_box"),
        (F.col("x0") - margin).alias("x0"), (F.col("y0") - margin).alias("y0"),
        (F.col("x1") + margin).alias("x1"), (F.col("y1") + margin).alias("y1"))
    dist = F.sqrt(F.pow(F.col("x") - (F.col("_box.x0") + F.col("_box.x1")) / 2, 2)
                  + F.pow(F.col("y") - (F.col("_box.y0") + F.col("_box.y1")) / 2, 2))
    inside = (F.col("x").between(F.col("_box.x0"), F.col("_box.x1"))
              & F.col("y").between(F.col("_box.y0"), F.col("_box.y1")))
    best = (points_in_boxes(ends.select(*key, *sheet, "x", "y"), grown, sheet).groupBy(*key)
            .agg(F.min(F.struct(dist.alias("d"), F.col(column_id), inside.alias("inside"))).alias("_b")))
    return best.select(*key, F.col(f"_b.{column_id}").alias(column_id),
                       F.when(F.col("_b.inside"), 0.9).otherwise(0.7).alias("confidence"))


def slab_supports(edges: DataFrame, beams: DataFrame, slab_id: str, beam_id: str, sheet: Sequence[str] = ()) -> DataFrame:
    """Beams parallel to a slab edge whose middle lies in the band along it (distinct pairs)."""
    pad = SLAB_BEAM_BAND + 0.05 * F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))
    boxed = edges.select(slab_id, *sheet, "ax", "ay", "bx", "by",
                         (F.least("ax", "bx") - pad).alias("x0"), (F.greatest("ax", "bx") + pad).alias("x1"),
                         (F.least("ay", "by") - pad).alias("y0"), (F.greatest("ay", "by") + pad).alias("y1"))
    mids = beams.select(beam_id, *sheet, ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"),
                        (F.col("bx") - F.col("ax")).alias("_vx"), (F.col("by") - F.col("ay")).alias("_vy"))
    dist, t = _segment_distance(F.col("x"), F.col("y"))
    wx, wy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    norm = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy")) * F.sqrt(wx * wx + wy * wy)
    sine = F.when(norm > 0, F.abs(F.col("_vx") * wy - F.col("_vy") * wx) / norm)
    return (points_in_boxes(mids, boxed, sheet)
            .where((sine <= PARALLEL_SIN_TOL) & (dist <= SLAB_BEAM_BAND) & t.between(-0.05, 1.05))
            .select(slab_id, beam_id).distinct())


def iou(a: Sequence[str], b: Sequence[str]) -> Column:
    """Intersection over union of two boxes given by column names; degenerate boxes give 0."""
    ax0, ay0, ax1, ay1 = [F.col(c) for c in a]
    bx0, by0, bx1, by1 = [F.col(c) for c in b]
    w = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    h = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    inter = w * h
    zero = F.lit(0.0)
    union = (F.greatest(ax1 - ax0, zero) * F.greatest(ay1 - ay0, zero)
             + F.greatest(bx1 - bx0, zero) * F.greatest(by1 - by0, zero) - inter)
    return F.when(union > 0, inter / union).otherwise(zero)


def overlapping(a: DataFrame, b: DataFrame, a_id: str, b_id: str, threshold: float,
                keys: Sequence[str] = ()) -> DataFrame:
    """Box pairs with IoU at or above a positive threshold: ``a_id, b_id, iou`` (and ``keys``).

    Such boxes have sides of similar length, so only neighbouring scales are compared; a pair is
    made in the one cell that holds the lower corner of the intersection.
    """
    reach = int(math.ceil(math.log2(1.0 / threshold))) + 1
    sides = []
    for frame, name, mark in ((a, a_id, "a"), (b, b_id, "b")):
        own = _scale_of(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        filed = (frame.select(*keys, F.col(name), *[F.col(c).alias(f"{mark}{c}") for c in ("x0", "y0", "x1", "y1")],
                              own.alias(f"_{mark}s"))
                 .withColumn("_s", F.explode(F.sequence(F.col(f"_{mark}s"), F.col(f"_{mark}s") + reach))))
        for axis in "xy":
            low, high = F.col(f"{mark}{axis}0"), F.col(f"{mark}{axis}1")
            filed = filed.withColumn(f"_c{axis}", F.explode(F.sequence(_cell(low, F.col("_s")), _cell(high, F.col("_s")))))
        sides.append(filed)
    joined = sides[0].join(sides[1], [*keys, "_s", "_cx", "_cy"]).where(
        (F.col("_s") == F.greatest("_as", "_bs"))
        & (F.col("_cx") == _cell(F.greatest("ax0", "bx0"), F.col("_s")))
        & (F.col("_cy") == _cell(F.greatest("ay0", "by0"), F.col("_s"))))
    score = iou(["ax0", "ay0", "ax1", "ay1"], ["bx0", "by0", "bx1", "by1"])
    return joined.select(*keys, a_id, b_id, score.alias("iou")).where(F.col("iou") >= threshold)


_UNITS = 10_000  # matched copies that one row is unfolded into


def pair_boxes(a: DataFrame, b: DataFrame, a_id: str, b_id: str, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs in falling IoU; of equal IoU the pair of the boxes that the smallest ids have comes first.

    Equal boxes of a side are one box with a number: copies meet and are matched as numbers, and only the matches are unfolded, the
    copies of a box in the order of their ids.
    """
    from .matching import shared_out
    from .ordered import numbered

    corners = ["x0", "y0", "x1", "y1"]
    kinds = [df.groupBy(*keys, *corners).agg(F.min(item).alias(kind), F.count("*").alias(room))
             for df, item, kind, room in ((a, a_id, "_a", "_na"), (b, b_id, "_b", "_nb"))]
    met = (overlapping(*kinds, "_a", "_b", threshold, keys).join(kinds[0].select(*keys, "_a", "_na"), [*keys, "_a"]).join(kinds[1].select(*keys, "_b", "_nb"), [*keys, "_b"]))
    chosen = shared_out(met, [*keys, "_a"], [*keys, "_b"], F.struct((-F.col("iou")).alias("c"), F.col("_a"), F.col("_b")), "_na", "_nb")
    # many copies of one pair: parts of a bounded size go to several tasks before they are unfolded
    parts = chosen.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / _UNITS)))).repartition(*keys, "_a", "_b", "_c")
    units = parts.withColumn("_t", F.explode(F.sequence(F.col("_c") * _UNITS, F.least(F.col("taken"), (F.col("_c") + 1) * _UNITS) - 1)))
    for df, item, kind, kinds_of, start in ((a, a_id, "_a", kinds[0], "from_a"), (b, b_id, "_b", kinds[1], "from_b")):
        items = numbered(df.select(*keys, *corners, item), [*keys, *corners], [item], "_rank").join(kinds_of.select(*keys, *corners, kind), [*keys, *corners])
        units = units.withColumn("_rank", F.col(start) + F.col("_t") + 1).join(items.select(*keys, kind, "_rank", item), [*keys, kind, "_rank"]).drop("_rank")
    return units.select(*keys, a_id, b_id, "iou")


def row_pairs(names: DataFrame, values: DataFrame, keys: Sequence[str], row_tol: float = SAME_ROW_TOLERANCE,
              max_gap: float = MAX_HORIZONTAL_GAP) -> DataFrame:
    """Level names and elevations on one row of a sheet, nearest first, each used once.

    ``names``: keys, name_id, x0, x1, y; ``values``: keys, value_id, x0, x1, y.
    """
    from .matching import one_to_one

    # Cells of row height by reach: a value looks from its left end to its right end, one cell beyond.
    band, near = F.floor(F.col("y") / row_tol), lambda c: F.floor(c / max_gap)
    left = names.select(*keys, "name_id", F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("y").alias("ay"),
                        band.alias("_band"), F.explode(F.sequence(near(F.col("x0")), near(F.col("x1")))).alias("_col"))
    right = values.select(*keys, "value_id", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y").alias("by"),
                          band.alias("_b"), F.sequence(near(F.col("x0")) - 1, near(F.col("x1")) + 1).alias("_cols"))
    right = (right.withColumn("_band", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
             .withColumn("_col", F.explode("_cols")).drop("_b", "_cols"))
    gap = F.greatest(F.col("ax0") - F.col("bx1"), F.col("bx0") - F.col("ax1"), F.lit(0.0))
    delta = F.abs(F.col("ay") - F.col("by"))
    pairs = (left.join(right, [*keys, "_band", "_col"])
             .where((delta <= row_tol) & (gap <= max_gap))
             .select(*keys, "name_id", "value_id", (gap + delta).alias("distance")).distinct())
    cost = F.struct("distance", "value_id", "name_id")
    return one_to_one(pairs, [*keys, "name_id"], [*keys, "value_id"], cost, cost)
