"""Sorts, limits and top-k (TOP)."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order; the plan is a top-(offset + limit), not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def merge_top(sources: Sequence[DataFrame], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Top (offset + limit) of every source, merged and cut again."""
    tops = [s.orderBy(*order).limit(offset + limit) for s in sources]
    return page(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tops), order, limit, offset)


def cap(df: DataFrame, order: Sequence[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(the N most important rows, one row with total and cut)."""
    report = df.agg(F.count("*").alias("total")).withColumn("cut", F.greatest(F.col("total") - n, F.lit(0)))
    return df.orderBy(*order).limit(n), report


SEVERITY_RANK = {"critical": 0, "major": 1, "high": 1, "minor": 2, "medium": 2, "info": 3, "low": 3}


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(F.lower(severity) == name, rank).otherwise(out)
    return out


def cost_risk(text: Column, problems: Mapping[str, tuple[str, float, int]], min_projects: int = 5) -> Column:
    """Highest lift of the reliable problem types (pattern, lift, projects) named in the text, else 0."""
    body = F.coalesce(text, F.lit(""))
    lifts = [F.when(body.rlike(p), F.lit(float(lift))).otherwise(0.0)
             for p, lift, projects in problems.values() if projects >= min_projects]
    return F.greatest(F.lit(0.0), *lifts) if lifts else F.lit(0.0)


def issue_order(severity: Column, risk: Column, *ties: Column) -> list[Column]:
    """Severity first; cost risk only inside one severity."""
    return [severity_rank(severity).asc(), risk.desc(), *ties]


def natural_key(col: Column) -> Column:
    """Digit runs padded to eight, so numbers sort by value; missing numbers sink."""
    runs = F.regexp_extract_all(F.upper(F.trim(col)), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$") & (F.length(r) < 8), F.lpad(r, 8, "0")).otherwise(r))
    return F.when(F.coalesce(F.trim(col), F.lit("")) == "", F.lit("￿")).otherwise(F.array_join(padded, ""))


# Fixed values of anchor ranking.
WEIGHT_DIRECTIONS, MAX_PLAUSIBLE_ZONES, MAX_SCORED_GAPS = 1000, 6, 40


def rank_anchors(df: DataFrame, limit: int = 10) -> DataFrame:
    """Sheets worth confirming: directions × weight + longest run; confirmed and implausible ones out.

    Input: drawing_id, directions, zones, max_gaps, total_gaps, zone_confirmed.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    longest = F.when(zero("max_gaps") > 0, F.col("max_gaps")).otherwise(zero("total_gaps"))
    score = zero("directions") * WEIGHT_DIRECTIONS + F.least(longest, F.lit(MAX_SCORED_GAPS))
    scored = df.withColumn("coverage_score", score).where(
        ~F.coalesce("zone_confirmed", F.lit(False)) & (zero("zones") <= MAX_PLAUSIBLE_ZONES)
        & (F.col("coverage_score") > 0) & (zero("total_gaps") > 0))
    return scored.orderBy(F.desc("coverage_score"), "drawing_id").limit(limit)


def estimate_tier(estimate: Column) -> Column:
    """0 proven, 1 unknown, 2 disproved."""
    return F.when(estimate.isNull(), 1).when(estimate <= 0, 2).otherwise(0)


def rank_estimate(df: DataFrame, estimate: str, seq: str) -> DataFrame:
    """Proven by estimate, then unknown, then disproved ones, each in the given order."""
    tier = estimate_tier(F.col(estimate))
    return df.withColumn("tier", tier).orderBy("tier", F.when(F.col("tier") == 0, -F.col(estimate)).otherwise(0), seq)


def unlock_rank(df: DataFrame, floor: str, drawing: str, components: str, zones: str) -> DataFrame:
    """A floor's component count split evenly over its pending sheets, the rest to the first.

    Floors are summed and joined back, so a floor of any size never sits in one window.
    """
    sums = df.groupBy(floor).agg(F.max(F.coalesce(components, F.lit(0))).alias("_total"), F.count("*").alias("_n"),
                                 F.min(drawing).alias("_first"))
    share = F.floor(F.col("_total") / F.col("_n"))
    rest = F.when(F.col(drawing) == F.col("_first"), F.col("_total") - share * F.col("_n")).otherwise(0)
    return df.join(sums, floor).select(
        drawing, floor, (share + rest).cast("long").alias("unlocks"), F.coalesce(zones, F.lit(0)).cast("long").alias("effort")
    ).orderBy(F.desc("unlocks"), "effort", drawing)


def calibration_state(axis_count: Column, ready_at: int = 2) -> Column:
    return F.when(axis_count <= 0, "none").when(axis_count < ready_at, "partial").otherwise("ready")


def recent(df: DataFrame, ts: str, n: int, *ties: Column) -> DataFrame:
    return df.orderBy(F.desc(ts), *ties).limit(n)


def review_queue(sources: Sequence[tuple[str, DataFrame]], n: int, *ties: Column) -> DataFrame:
    """Topology, naming and conflict items (item_key, confidence, …) as one queue, worst first."""
    order = [F.asc_nulls_first("confidence"), F.asc("kind"), *ties]
    return merge_top([df.withColumn("kind", F.lit(kind)) for kind, df in sources], order, n)
