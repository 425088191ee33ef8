"""Gates and consistency checks (DQ)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.strings import ladder
from .common import literal_table
from .ordered import neighbour
from .windows import AXIS_LETTERS


def gate_violations(drawings: DataFrame, evidence: DataFrame, key: str, status: str, gates: Sequence[tuple[str, Sequence[str], str]]) -> DataFrame:
    """Rows past a stage without its proof; gates are (code, statuses past it, evidence column)."""
    joined = drawings.join(evidence, key, "left")
    codes = F.array_compact(F.array(*[F.when(F.col(status).isin(list(past)) & F.col(proof).isNull(), F.lit(code)) for code, past, proof in gates]))
    return joined.select(key, status, F.explode(codes).alias("violation"))


def missing_signers(proposals: DataFrame, approvals: DataFrame, key: str, roles: Sequence[str]) -> DataFrame:
    """Signer roles still missing per proposal (roles are a fixed list)."""
    wanted = proposals.select(key, F.explode(F.array(*[F.lit(r) for r in roles])).alias("role"))
    return wanted.join(approvals.where("signed_at is not null").select(key, "role"), [key, "role"], "left_anti")


def notice_ends(proposals: DataFrame, approvals: DataFrame, key: str, roles: Sequence[str], days: int) -> DataFrame:
    """Proposals signed by every role, with last signature + N days."""
    signed = (approvals.where(F.col("role").isin(list(roles)) & F.col("signed_at").isNotNull())
              .groupBy(key).agg(F.count_distinct("role").alias("_n"), F.max("signed_at").alias("_last")).where(F.col("_n") == len(roles)))
    return proposals.select(key).join(signed, key).select(key, (F.col("_last") + F.make_interval(days=F.lit(days))).alias("notice_ends_at"))


def bad_transitions(log: DataFrame, keys: Sequence[str], order: Sequence[str], state: str,
                    allowed: Sequence[tuple[str, str]], ranking: Sequence[str]) -> DataFrame:
    """Moves that are not allowed, and those that go backwards in the ranking."""
    moves = neighbour(log, keys, order, {"_from": state}, -1).where("_from is not null")
    legal = literal_table(log.sparkSession, allowed, f"_from string, {state} string").withColumn("_ok", F.lit(True))
    rank = lambda c: ladder(c, [(f"{i:03d}", f"^{s}$") for i, s in enumerate(ranking)], "999")
    judged = moves.join(F.broadcast(legal), ["_from", state], "left")
    return judged.where("_ok is null").select(*keys, *order, F.col("_from").alias("from_state"), F.col(state).alias("to_state"),
                                              (rank(F.col(state)) < rank(F.col("_from"))).alias("backward"))


# Roles of sheets in a set.
COORDINATE_BASE, FLOOR_SKELETON, COMPONENT_SOURCE, ELEVATION_REFERENCE = "coordinate_base", "floor_skeleton", "component_source", "elevation_reference"


def capability(df: DataFrame, keys: Sequence[str], role: str) -> DataFrame:
    """full / partial / none for coordinates, floors and elevations, whether anything can be built, degradations."""
    has = lambda r: F.count_if(F.col(role) == r) > 0
    base, skeleton, source, elevation = has(COORDINATE_BASE), has(FLOOR_SKELETON), has(COMPONENT_SOURCE), has(ELEVATION_REFERENCE)
    notes = F.array_compact(F.array(
        F.when(~base, "relative geometry only"), F.when(~skeleton & source, "floors from titles"), F.when(~skeleton & ~source, "no floors"),
        F.when(~elevation, "default heights"), F.when(~skeleton & ~source, "cannot build")))
    return df.groupBy(*keys).agg(
        F.when(base, "full").otherwise("none").alias("world_coords"),
        F.when(skeleton, "full").when(source, "partial").otherwise("none").alias("floors"),
        F.when(elevation, "full").otherwise("none").alias("elevations"), (skeleton | source).alias("can_build"), notes.alias("degradations"))


MIN_CONFLICT_DISTANCE_M = 50.0


def floor_conflict(df: DataFrame, floor: Sequence[str], x: str, y: str, placed: Column, min_distance: float = MIN_CONFLICT_DISTANCE_M) -> DataFrame:
    """Floors with placed and unplaced sheets whose centres lie apart; unknown centres count as a conflict."""
    mean = lambda c, on: F.avg(F.when(on, F.col(c)))
    sums = df.groupBy(*floor).agg(
        F.count_if(placed).alias("placed_count"), F.count_if(~placed).alias("unplaced_count"),
        mean(x, placed).alias("_px"), mean(y, placed).alias("_py"), mean(x, ~placed).alias("_ux"), mean(y, ~placed).alias("_uy"))
    distance = F.sqrt(F.pow(F.col("_px") - F.col("_ux"), 2) + F.pow(F.col("_py") - F.col("_uy"), 2))
    return (sums.withColumn("_d", distance).where("placed_count > 0 and unplaced_count > 0")
            .where(F.col("_d").isNull() | (F.col("_d") >= min_distance))
            .select(*floor, "placed_count", "unplaced_count",
                    F.round(F.col("placed_count") / (F.col("placed_count") + F.col("unplaced_count")), 3).alias("placed_ratio"), F.round("_d", 1).alias("distance")))


def label_violations(df: DataFrame, keys: Sequence[str], label: str, kind: Column) -> DataFrame:
    """Broken rules of a label sequence: unparsable, wrong kind, several zones, duplicate, gap in the order.

    Labels are ``[zone-]number`` or ``[zone-]letters`` without I, O, Z; ``n/label`` is an additional
    axis and takes no main number.  Gaps are looked for among distinct ordinals of a sequence.
    """
    raw = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    rows = df.select(*keys, F.col(label), kind.alias("_want"), F.regexp_extract(raw, r"^(?:([0-9A-Z]+)-)?(?:[0-9]+/)?(?:[0-9]+|[A-HJ-NP-Y]{1,2})$", 1).alias("_zone"),
                     raw.rlike(r"^(?:[0-9A-Z]+-)?(?:[0-9]+/)?(?:[0-9]+|[A-HJ-NP-Y]{1,2})$").alias("_ok"), raw.contains("/").alias("_extra"),
                     F.regexp_extract(raw, r"([0-9]+|[A-Z]{1,2})$", 1).alias("_value"))
    number = F.col("_value").rlike("^[0-9]+$")
    letters = F.array(*[F.lit(c) for c in AXIS_LETTERS])
    ordinal = F.when(number, F.col("_value").try_cast("long")).otherwise(
        F.array_position(letters, F.substring("_value", 1, 1)) + (F.length("_value") - 1) * len(AXIS_LETTERS))
    rows = rows.withColumn("_kind", F.when(number, "numeric").otherwise("alpha")).withColumn("_n", ordinal)
    made = lambda frame, rule, detail: frame.select(*keys, F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    main = rows.where("_ok and not _extra")
    fit = main.where("_kind = _want")
    tally = fit.groupBy(*keys, "_value").agg(F.count("*").alias("_c"), F.min("_n").alias("_n"))
    # distinct ordinals of one sequence, bounded by the label alphabet
    step = tally.groupBy(*keys, "_n").agg(F.count("*").alias("_x")).withColumn("_prev", F.lag("_n").over(W.partitionBy(*keys).orderBy("_n")))
    zones = rows.where("_ok").groupBy(*keys).agg(F.count_distinct("_zone").alias("_z")).where("_z > 1")
    return (made(rows.where("not _ok"), "unparsable", F.col(label)).unionByName(made(main.where("_kind <> _want"), "kind", F.col(label)))
            .unionByName(made(zones, "zones", F.col("_z"))).unionByName(made(tally.where("_c > 1"), "duplicate", F.col("_value")))
            .unionByName(made(step.where("_n - _prev > 1"), "gap", F.concat_ws("-", "_prev", "_n"))))
