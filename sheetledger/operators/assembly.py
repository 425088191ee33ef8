"""Observations to entities, and story tables (AGG-26, AGG-59)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import noisy_or
from ..session import cut_lineage
from .common import each_block, null_safe_join
from .consensus import first_per_key

# Merge distance, confidence under which an entity needs review, types keyed by grid cell.
MERGE_DIST_M, CONFLICT_CONFIDENCE, GRID_KEYED_TYPES = 1.0, 0.5, ("column", "pile")
_SPACE, _BLOCK = ["type", "building", "floor"], ["type", "building", "floor", "_block"]
_SPOT = [*_BLOCK, "_cell", "x", "y", "_conf"]


def _greedy(dist: float):
    def place(block: dict) -> dict:
        """Spots of one block, surest first, each to the nearest centre in reach, else a new entity.

        A spot with a grid cell looks at the entities that its cell began only; without a place it takes the first of
        them, and where none is near, one without a centre.  All others look at every centre.
        """
        xs, ys, ns, cells = block["x"].astype(float), block["y"].astype(float), block["_n"].astype(float), block["_cell"]
        cx, cy, weight = np.full(len(xs), np.nan), np.full(len(xs), np.nan), np.zeros(len(xs))
        began: dict[str, list[int]] = {}
        entity, used = np.empty(len(xs), dtype=np.int64), 0
        for i in range(len(xs)):
            lost, cell = np.isnan(xs[i]), cells[i]
            mine = np.array(began.get(cell, ()), dtype=np.int64) if cell is not None else np.arange(used)
            if lost:
                j = int(mine[0]) if len(mine) and cell is not None else -1
            else:
                gap = np.hypot(cx[mine] - xs[i], cy[mine] - ys[i])  # not a number without a centre
                near = gap <= dist
                blank = mine[weight[mine] == 0] if cell is not None else ()
                j = int(mine[np.where(near, gap, np.inf).argmin()]) if near.any() else int(blank[0]) if len(blank) else -1
            if j < 0:
                j, used = used, used + 1
                if cell is not None:
                    began.setdefault(cell, []).append(j)
            if not lost:
                total = weight[j] + ns[i]
                share = ns[i] / total
                cx[j], cy[j] = (xs[i], ys[i]) if weight[j] == 0 else (cx[j] + (xs[i] - cx[j]) * share, cy[j] + (ys[i] - cy[j]) * share)
                weight[j] = total
            entity[i] = j
        return {"_entity": entity}

    return place


def _fill(block: dict) -> dict:
    """Number of the island of each occupied square of one space: squares that touch, or that a grid cell reaches over."""
    above: dict = {}

    def top(n):
        while above.setdefault(n, n) != n:
            above[n] = n = above[above[n]]
        return n

    places = list(zip(block["_sx"].tolist(), block["_sy"].tolist()))
    there = set(places)
    for (x, y), grid in zip(places, block["_grid"]):
        beside = [(x + i, y + j) for i, j in ((1, 0), (0, 1), (1, 1), (1, -1)) if (x + i, y + j) in there]
        for other in [*beside, *([] if grid is None else [("grid", grid)])]:
            above[top(other)] = top((x, y))
    number: dict = {}
    return {"_isle": np.array([number.setdefault(top(p), len(number)) for p in places], dtype=np.int64)}


def _names() -> dict[str, Column]:
    """Names of an observation's square and of its grid cell; null without one."""
    space = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _SPACE]
    return {"_square": F.when(F.col("_sx").isNotNull(), F.concat_ws("|", F.lit("s"), *space, "_sx", "_sy")),
            "_grid": F.when(F.col("_cell").isNotNull(), F.concat_ws("|", F.lit("g"), *space, "_cell"))}


def _islands(rows: DataFrame, dist: float) -> DataFrame:
    """(_node, _c): squares of two merge distances and grid cells, with the island they are part of.

    Whatever could meet lies in one island: squares are twice as wide as an observation's reach.  A task holds the
    occupied squares of one type, building and floor, however many observations lie in them.
    """
    cells = rows.where("_sx is not null").select(*_SPACE, "_sx", "_sy", "_cell").distinct()
    filled = each_block(cells.withColumns(_names()), _SPACE, ["_sx", "_sy"], _fill, [*_SPACE, "_square", "_grid"], "_isle long")
    isle = F.concat_ws("|", F.lit("i"), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _SPACE], "_isle").alias("_c")
    return cut_lineage(filled.select(F.explode(F.array("_square", "_grid")).alias("_node"), isle).where("_node is not null").distinct())


def assemble(df: DataFrame, dist: float = MERGE_DIST_M) -> DataFrame:
    """Entities from observations (type, building, floor, grid_cell, x, y, confidence, type_label,
    outline, drawing_id, obs_id).

    Observations are taken surest first; one joins the nearest entity of its type in reach, or begins one.  Work is split
    where nothing can meet: islands of occupied squares and grid cells.  Observations of one place, cell and
    confidence follow each other and so go one way: they are folded before the Python step, which therefore holds the
    distinct places of an island; the aggregation runs in SQL afterwards.  Observations without place and
    grid stay entities of their own.
    """
    full = F.coalesce(F.col("type").isin(*GRID_KEYED_TYPES) & F.col("grid_cell").isNotNull() & ~F.col("grid_cell").contains("?"), F.lit(False))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    at = lambda c: F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.floor(F.col(c) / (2 * dist)))
    marked = (df.withColumn("_full", full).withColumn("_sx", at("x")).withColumn("_sy", at("y"))
              .withColumn("x", F.when(placed, F.col("x").cast("double"))).withColumn("y", F.when(F.col("_sx").isNotNull(), F.col("y").cast("double")))
              .withColumn("_cell", F.when(F.col("_full"), F.col("grid_cell"))).withColumn("_conf", F.coalesce("confidence", F.lit(0.0)))
              .withColumns(_names())
              .withColumn("_node", F.coalesce("_square", "_grid", F.concat(F.lit("o|"), F.col("obs_id").cast("string")))))
    # one row per square or cell; read below for every row
    rows = marked.join(_islands(marked, dist), "_node", "left").withColumn("_block", F.coalesce("_c", "_node")).drop("_c", "_node", "_square", "_grid", "_sx", "_sy")
    # labels are tallied per spot in the pass that folds, so that the vote reads no rows again
    tally = cut_lineage(rows.groupBy(*_SPOT, "type_label").agg(F.count("*").alias("_n"), F.max("confidence").alias("_c"), F.min("obs_id").alias("_first")))
    folded = tally.groupBy(*_SPOT).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    # read twice below (aggregates and label vote), so the Python pass is kept
    spots = cut_lineage(each_block(folded.withColumn("_turn", -F.col("_conf")), _BLOCK, ["_turn", "_first"], _greedy(dist), _SPOT, "_entity long"))
    joined = null_safe_join(rows, spots, _SPOT)
    keys = [*_BLOCK, "_entity"]
    best = F.when(F.col("outline").isNotNull(), F.struct(F.col("_conf").alias("c"), F.col("x")))
    entities = joined.groupBy(*keys).agg(
        F.round(F.avg("x"), 3).alias("cx"), F.round(F.avg("y"), 3).alias("cy"), noisy_or("confidence").alias("confidence"),
        F.max_by("outline", best).alias("outline"), F.count("*").alias("observations"),
        F.count_distinct("drawing_id").alias("drawings"), F.max("_full").alias("_full"), F.min("grid_cell").alias("grid_ref"))
    told = tally.where(F.col("type_label").isNotNull() & (F.col("type_label") != ""))
    votes = null_safe_join(told, spots, _SPOT).groupBy(*keys, "type_label").agg(F.sum("_n").alias("votes"), F.max("_c").alias("_c"))
    labels = first_per_key(votes, keys, [F.desc("votes"), F.desc("_c"), F.asc("type_label")]).select(*keys, "type_label")
    named = null_safe_join(entities, labels, keys, "left")
    centre = F.when(F.col("cx").isNotNull(), F.concat(F.lit("@"), F.col("cx"), F.lit(","), F.col("cy"))).otherwise("")
    return named.select(
        "type", "building", "floor", "grid_ref",
        F.when(F.col("_full"), F.concat(F.col("type"), F.lit("@"), F.col("building"), F.lit(":"), F.col("floor"), F.lit(":"),
                                        F.col("grid_ref"), centre)).alias("semantic_key"),
        "cx", "cy", "confidence", "type_label", "outline", "observations", "drawings",
        F.when(F.col("confidence") >= CONFLICT_CONFIDENCE, "auto").otherwise("conflict").alias("review_state"))


# Story spacing and default heights.
MIN_STORY_SPACING_M, DEFAULT_STORY_HEIGHT_M, DEFAULT_BASEMENT_HEIGHT_M = 2.8, 4.5, 4.2


def default_elevation(order):
    """Storeys count from 1 upwards at the default height, basements from −1 downwards."""
    return F.when(order >= 1, (order - 1) * DEFAULT_STORY_HEIGHT_M).otherwise(order * DEFAULT_BASEMENT_HEIGHT_M)


def story_table(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Ordered story table per unit (unit, story_key, story_order, elevation or null per drawing).

    An override wins and is exempt; else the smallest drawing elevation, else the default.  A step
    under the minimum becomes previous + default height with a warning.  The rows of a unit are
    reduced to one per story first; the fold runs over that short array inside the JVM.
    """
    stories = df.groupBy("unit", "story_key").agg(F.min("story_order").alias("story_order"),
                                                  F.round(F.min("elevation"), 3).alias("_drawn"))
    stories = stories.join(overrides.select("unit", "story_key", F.round("elevation", 3).alias("_over")), ["unit", "story_key"], "left")
    source = F.when(F.col("_over").isNotNull(), "override").when(F.col("_drawn").isNotNull(), "drawing").otherwise("default")
    item = F.struct("story_order", "story_key", F.round(F.coalesce("_over", "_drawn", default_elevation(F.col("story_order"))), 3).alias("z"),
                    source.alias("source"), F.lit(False).alias("warning"))
    lists = stories.groupBy("unit").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    kind = lists.schema["_s"].dataType.simpleString()

    def step(done, s):
        prev = F.get(done, F.size(done) - 1)["z"]
        close = F.coalesce((s["source"] != "override") & (s["z"] - prev < MIN_STORY_SPACING_M), F.lit(False))
        fixed = F.struct(
            s["story_order"].alias("story_order"), s["story_key"].alias("story_key"),
            F.when(close, F.round(prev + DEFAULT_STORY_HEIGHT_M, 3)).otherwise(s["z"]).alias("z"),
            F.when(close, F.lit("default")).otherwise(s["source"]).alias("source"), close.alias("warning"))
        return F.concat(done, F.array(fixed))

    folded = lists.select("unit", F.aggregate("_s", F.array().cast(kind), step).alias("_t"))
    return folded.select("unit", F.explode("_t").alias("_r")).select(
        "unit", "_r.story_key", "_r.story_order", F.col("_r.z").alias("elevation"), "_r.source", "_r.warning")
