"""Votes, consensus, anomalies and fits over many sources (AGG)."""

from __future__ import annotations

import uuid
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, shared_folder, write_down
from .common import null_safe_join
from .quantiles import exact_quantiles, median_by, small_median_by

# Fixed values of the votes.
ROUND_M, MIN_ELEVATION_M, MAX_ELEVATION_M, MIN_SUPPORT, MIN_WITNESSES = 0.01, -60.0, 300.0, 2, 2


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Best row per key; Spark applies the rank limit before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def vote(df: DataFrame, keys: Sequence[str], label: str, conf: str) -> DataFrame:
    """Most frequent non-null label; a tie goes to the label seen with the highest confidence."""
    tally = (df.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(*keys, label)
             .agg(F.count("*").alias("votes"), F.max(conf).alias("_c")))
    return first_per_key(tally, keys, [F.desc("votes"), F.desc("_c"), F.asc(label)]).drop("_c")


def candidate_value(col: Column) -> Column:
    """Value rounded to the vote step, null outside the plausible range."""
    snapped = F.round(F.rint(col / ROUND_M) * ROUND_M, 2)
    return F.when(col.between(MIN_ELEVATION_M, MAX_ELEVATION_M), snapped)


def _ballots(df: DataFrame, keys: Sequence[str], drawing: str, value: str) -> DataFrame:
    """Votes per candidate: a drawing has one vote however often it repeats a value."""
    once = df.select(*keys, drawing, candidate_value(F.col(value)).alias("value")).where("value is not null").distinct()
    return once.groupBy(*keys, "value").agg(F.count("*").alias("votes"))


def vote_min_support(df: DataFrame, keys: Sequence[str], drawing: str, value: str, k: int = MIN_SUPPORT) -> DataFrame:
    """Winner needs ``k`` votes, a tie goes to the smaller value; (null, 0) where none has them."""
    best = first_per_key(_ballots(df, keys, drawing, value), keys, [F.desc("votes"), F.asc("value")])
    won = F.col("votes") >= k
    return best.select(*keys, F.when(won, F.col("value")).alias("value"), F.when(won, F.col("votes")).otherwise(0).alias("support"))


def discriminative_vote(df: DataFrame, group: str, drawing: str, value: str, k: int = MIN_SUPPORT) -> DataFrame:
    """Score = votes in the group / number of groups that hold the value."""
    tally = _ballots(df, [group], drawing, value)
    spread = tally.groupBy("value").agg(F.count("*").alias("_groups"))
    scored = tally.join(spread, "value").where(F.col("votes") >= k).withColumn("score", F.col("votes") / F.col("_groups"))
    best = first_per_key(scored, [group], [F.desc("score"), F.asc("value")]).select(
        group, "value", F.col("votes").alias("support"), "score")
    return tally.select(group).distinct().join(best, group, "left").withColumn("support", F.coalesce("support", F.lit(0)))


def _witnesses(df: DataFrame, keys: Sequence[str], drawing: str, value: str) -> DataFrame:
    rows = df.where(F.col(value).isNotNull() & F.col(drawing).isNotNull())
    return (rows.select(*keys, drawing, F.round(value, 3).alias("value")).distinct()
            .groupBy(*keys, "value").agg(F.count("*").alias("witnesses")))


def consensus(df: DataFrame, keys: Sequence[str], drawing: str, value: str, k: int = MIN_WITNESSES) -> DataFrame:
    """Value backed by ``k`` distinct drawings while no rival is."""
    backed = _witnesses(df, keys, drawing, value).where(F.col("witnesses") >= k)
    return (backed.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("value").alias("value"),
                                      F.max("witnesses").alias("witnesses"))
            .where("_n = 1").drop("_n"))


def conflicts(df: DataFrame, keys: Sequence[str], drawing: str, value: str, k: int = MIN_WITNESSES) -> DataFrame:
    """Rival backed values of keys that have two or more, one row each with the number of rivals."""
    backed = _witnesses(df, keys, drawing, value).where(F.col("witnesses") >= k)
    split = backed.groupBy(*keys).agg(F.count("*").alias("rivals")).where("rivals > 1")
    return null_safe_join(backed, split, keys)


def summarize_obs(df: DataFrame, keys: Sequence[str], x: str, y: str, geom: str, conf: str, tie: str) -> DataFrame:
    """Mean position and the geometry of the most confident observation that has one."""
    order = F.when(F.col(geom).isNotNull(), F.struct(F.coalesce(conf, F.lit(0.0)).alias("c"), (-F.col(tie)).alias("t")))
    return df.groupBy(*keys).agg(
        F.round(F.avg(x), 3).alias("cx"), F.round(F.avg(y), 3).alias("cy"), F.count("*").alias("observations"),
        F.max_by(geom, order).alias("outline"))


def axis_consensus(df: DataFrame, keys: Sequence[str], label: str, pos: str) -> DataFrame:
    """Median position per label; a label seen once is kept."""
    return median_by(df, [*keys, label], pos, "pos", "seen")


# Residual limit of a frame, directions a frame needs.
MAX_FRAME_RESIDUAL_M, MAX_CONSENSUS_RESIDUAL_M = 0.5, 1.0


def _fit_sources(df: DataFrame, agreed: DataFrame, group: str, source: str, label: str, pos: str) -> DataFrame:
    """Offset and residual of every source against the agreed positions of its group."""
    shared = null_safe_join(df.select(group, source, label, pos),
                            agreed.select(group, label, F.col("pos").alias("_g")), [group, label])
    shared = shared.withColumn("_diff", F.col("_g") - F.col(pos))
    offset = small_median_by(shared, [group, source], "_diff", "offset", "shared")
    errors = null_safe_join(shared, offset.select(group, source, "offset").hint("merge"), [group, source])
    residual = small_median_by(errors, [group, source], F.abs(F.col("offset") - F.col("_diff")), "residual")
    return null_safe_join(offset, residual.hint("merge"), [group, source])


def robust_consensus(df: DataFrame, group: str, source: str, label: str, pos: str,
                     max_residual: float = MAX_CONSENSUS_RESIDUAL_M) -> tuple[DataFrame, DataFrame]:
    """Consensus, sources with a residual above the limit dropped, aligned rest agreed again.

    Returns (positions per group and label, sources with offset, residual and ``kept``).
    """
    first = axis_consensus(df, [group], label, pos)
    fit = cut_lineage(_fit_sources(df, first, group, source, label, pos).withColumn("kept", F.col("residual") <= max_residual))
    aligned = null_safe_join(df, fit.where("kept").select(group, source, "offset"), [group, source])
    aligned = aligned.withColumn("_p", F.col(pos) + F.col("offset"))
    return axis_consensus(aligned, [group], label, "_p"), fit


def seed_sources(df: DataFrame, group: str, source: str, pos: str) -> DataFrame:
    """Per group the source whose middle spacing is nearest to the typical one (then most labels, then id)."""
    w = W.partitionBy(group, source).orderBy(pos)  # labels of one sheet
    gaps = df.withColumn("_gap", F.lead(pos).over(w) - F.col(pos))
    ordered = F.array_sort(F.collect_list("_gap"))
    spacing = gaps.where("_gap > 1e-6").groupBy(group, source).agg(
        F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")).alias("spacing"))
    typical = exact_quantiles(spacing, [group], "spacing", {"typical": 0.5}, method="index")
    sizes = df.groupBy(group, source).agg(F.count("*").alias("_n"))
    joined = null_safe_join(null_safe_join(sizes, spacing.hint("merge"), [group, source], "left"), typical, [group], "left")
    away = F.abs(F.coalesce("spacing", F.col("typical") * 10) - F.col("typical"))
    return first_per_key(joined.withColumn("_away", away), [group], [F.asc_nulls_last("_away"), F.desc("_n"), F.asc(source)]
                  ).select(group, source)


def frames(df: DataFrame, group: str, source: str, label: str, pos: str, max_residual: float = MAX_FRAME_RESIDUAL_M
           ) -> DataFrame:
    """Mutually consistent sources per group: group, source, frame, offset.

    A frame grows from its seed: sources that share labels with it and fit are taken in, the
    positions are agreed again, until none joins; the next frame starts on the rest.  All groups
    grow at once, each at its own frame.  Members of every round are added to one written table, so
    plans stay short; tables with a row per source meet by merge join, so none passes the driver.
    """
    spark = df.sparkSession
    rows = write_down(df.select(group, source, label, pos))
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"

    def add(found: DataFrame) -> DataFrame:
        found = found.select(group, source, "frame", F.col("offset").cast("double").alias("offset"))
        found.write.mode("append").parquet(folder)
        return spark.read.schema(found.schema).parquet(folder)

    def seeds(waiting: DataFrame, frame: Column) -> DataFrame:
        return seed_sources(waiting, group, source, pos).withColumn("offset", F.lit(0.0)).withColumn("frame", frame)

    keys = [group, source]
    members = add(seeds(rows, F.lit(0)))
    current = write_down(members.select(group, "frame"))  # a row per group, as is all that is made of it
    while not current.isEmpty():
        active = null_safe_join(members, current, [group, "frame"]).drop("frame")
        aligned = null_safe_join(rows, active.hint("merge"), keys).withColumn("_p", F.col(pos) + F.col("offset"))
        agreed = write_down(axis_consensus(aligned, [group], label, "_p"))
        waiting = _without(rows, members, keys)
        fit = _fit_sources(waiting, agreed, group, source, label, pos).where(F.col("residual") <= max_residual)
        joined = write_down(null_safe_join(fit.select(*keys, "offset"), current, [group]))
        busy = joined.select(group).distinct().withColumn("_busy", F.lit(True))
        judged = write_down(null_safe_join(current, busy, [group], "left"))
        members = add(joined)
        quiet = judged.where("_busy is null").select(group, (F.col("frame") + 1).alias("_next"))
        current = judged.where("_busy").select(group, "frame")
        if quiet.isEmpty():
            continue
        left = null_safe_join(_without(rows, members, keys), quiet, [group])
        fresh = write_down(null_safe_join(seeds(left.drop("_next"), F.lit(0)).drop("frame"), quiet.withColumnRenamed("_next", "frame"), [group]))
        members = add(fresh)
        current = current.unionByName(fresh.select(group, "frame"))
    return members.select(group, source, "frame", "offset")


def _without(rows: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys, null or not, are not among the members; a row per source never goes to the driver."""
    seen = members.select(*keys).withColumn("_in", F.lit(True)).hint("merge")
    return null_safe_join(rows, seen, keys, "left").where("_in is null").drop("_in")


# Fixed values of the anomaly checks.
MAX_SPAN_RATIO, MIN_SOURCES_FOR_OUTLIER = 4.0, 4
DEVIATION_FACTOR, GAP_SANE_RANGE_M, MIN_WITNESSES_TO_TRUST = 2.0, (2.0, 30.0), 2
MODULE_STEP_M = 0.05


def span_outliers(df: DataFrame, keys: Sequence[str], source: str, span: str, ratio: float = MAX_SPAN_RATIO,
                  min_sources: int = MIN_SOURCES_FOR_OUTLIER) -> DataFrame:
    """Sources whose span exceeds ratio × the median span; zero spans neither count nor stand out."""
    real = df.where(F.col(span) > 0)
    middle = median_by(real, keys, span, "_median", "_sources").where(F.col("_sources") >= min_sources)
    return null_safe_join(real, middle, keys).where(F.col(span) > F.col("_median") * ratio).select(
        *keys, source, span, F.round("_median", 6).alias("median_span"))


def gap_anomaly(df: DataFrame, keys: Sequence[str], source: str, gap: str) -> DataFrame:
    """Gaps off the consensus by more than the factor, with their cause.

    The upper bound is waived when several sources give the same gap; the lower one never is.
    """
    low, high = GAP_SANE_RANGE_M
    real = df.where(F.col(gap) > 0)
    agreed = write_down(median_by(real, keys, gap, "consensus"))  # of true size, so that few groups meet all rows without a shuffle

    def off(least: Column, most: Column) -> Column:
        return (least / F.col("consensus") < 1 / DEVIATION_FACTOR) | (most / F.col("consensus") > DEVIATION_FACTOR)

    judged = null_safe_join(real.withColumn("_g", F.round(gap, 3)), agreed, keys)
    # gaps of one rounded value differ by 0.001 at most, so all witnesses of a gap that is off are among these
    near = off(F.col(gap) - 0.002, F.col(gap) + 0.002)
    witness = (judged.where(near).select(*keys, source, "_g").distinct()
               .groupBy(*keys, "_g").agg(F.count("*").alias("witnesses")))
    rows = null_safe_join(judged.where(off(F.col(gap), F.col(gap))), witness, [*keys, "_g"])
    waived = (F.col(gap) > high) & (F.col("witnesses") >= MIN_WITNESSES_TO_TRUST)
    cause = F.when(F.col(gap).between(low, high), "scale").otherwise("detection")
    return rows.where(~waived).select(*keys, source, gap, F.round("consensus", 2).alias("consensus"),
                                      F.round(F.col(gap) / F.col("consensus"), 3).alias("ratio"), "witnesses", cause.alias("cause"))


def module_compliance(df: DataFrame, keys: Sequence[str], value: str, step: float = MODULE_STEP_M) -> DataFrame:
    """Deviation from the module in millimetres: ranked (not interpolated) p50 and p90, share over 10, sizes."""
    real = df.where(F.col(value) > 0)
    dev = F.abs(F.col(value) - F.rint(F.col(value) / step) * step) * 1000
    rows = real.withColumn("_d", dev)
    ranks = exact_quantiles(rows, keys, "_d", {"p50_mm": 0.5, "p90_mm": 0.9}, method="index")
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(100 * F.count_if(F.col("_d") > 10) / F.count("*"), 2).alias("over_10mm_pct"),
        F.count_distinct(F.round(value, 2)).alias("distinct_sizes"))
    return null_safe_join(stats, ranks, keys).select(
        *keys, "n", F.round("p50_mm", 2).alias("p50_mm"), F.round("p90_mm", 2).alias("p90_mm"), "over_10mm_pct", "distinct_sizes")


# Standard scale denominators and the range read from text.
STANDARD_DENOMINATORS = (5, 10, 15, 20, 25, 30, 40, 50, 75, 100, 150, 200, 250, 300, 400, 500, 1000, 2000)
MIN_DENOMINATOR, MAX_DENOMINATOR, SNAP_SHARE, TITLE_BLOCK_WEIGHT = 5, 2000, 0.05, 5
SCALE_PATTERN = r"1\s*[:：]\s*(\d{1,4})"


def scale_ballot(df: DataFrame, keys: Sequence[str], text: str, in_title_block: Column) -> DataFrame:
    """Weighted votes for scale denominators named in text, snapped to the standard within 5 %."""
    found = df.select(*keys, F.when(in_title_block, TITLE_BLOCK_WEIGHT).otherwise(1).alias("_w"),
                      F.explode(F.regexp_extract_all(text, F.lit(SCALE_PATTERN), F.lit(1))).alias("_t"))
    read = found.withColumn("_d", F.col("_t").cast("int")).where(F.col("_d").between(MIN_DENOMINATOR, MAX_DENOMINATOR))
    per = read.groupBy(*keys, "_d").agg(F.sum("_w").alias("_w"))
    near = per.withColumn("_n", _nearest(F.col("_d"))).withColumn("is_standard", F.col("_n.off") <= SNAP_SHARE)
    votes = (near.withColumn("denominator", F.when(F.col("is_standard"), F.col("_n.to")).otherwise(F.col("_d")))
             .groupBy(*keys, "denominator", "is_standard").agg(F.sum("_w").alias("votes")))
    # at most 1,996 denominators per group, so the share window is bounded
    total = F.sum("votes").over(W.partitionBy(*keys))
    return votes.withColumn("share", F.round(F.col("votes") / total, 3))


def _nearest(denominator: Column) -> Column:
    """Standard denominator with the smallest relative distance, with that distance."""
    return F.array_min(F.array(*[F.struct((F.abs(denominator - s) / s).alias("off"), F.lit(s).alias("to")) for s in STANDARD_DENOMINATORS]))


def fit_similarity(df: DataFrame, keys: Sequence[str], ax: str, ay: str, bx: str, by: str, min_pairs: int = 2) -> DataFrame:
    """Scale, rotation, shift and rmse from point pairs, with or without a mirror, whichever fits better.

    Only co-moments are needed, so a group of any size is one row of partial sums.
    """
    cov = lambda a, b, n: F.covar_pop(a, b).alias(n)
    sums = df.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.avg(ax).alias("_ax"), F.avg(ay).alias("_ay"), F.avg(bx).alias("_bx"), F.avg(by).alias("_by"),
        cov(ax, bx, "_xx"), cov(ay, by, "_yy"), cov(ax, by, "_xy"), cov(ay, bx, "_yx"),
        (F.var_pop(ax) + F.var_pop(ay)).alias("_den"), (F.var_pop(bx) + F.var_pop(by)).alias("_vb"))
    usable = sums.where((F.col("pairs") >= min_pairs) & (F.col("_den") > 1e-15))
    fits = []
    for mirror, sign in ((False, 1.0), (True, -1.0)):
        cos, sin = F.col("_xx") + sign * F.col("_yy"), F.col("_xy") - sign * F.col("_yx")
        scale = F.sqrt(cos * cos + sin * sin) / F.col("_den")
        theta = F.atan2(sin, cos)
        my = sign * F.col("_ay")
        tx = F.col("_bx") - scale * (F.cos(theta) * F.col("_ax") - F.sin(theta) * my)
        ty = F.col("_by") - scale * (F.sin(theta) * F.col("_ax") + F.cos(theta) * my)
        sse = F.greatest(F.col("_vb") - (cos * cos + sin * sin) / F.col("_den"), F.lit(0.0))
        fits.append(F.when(scale > 0, F.struct(
            F.sqrt(sse).alias("rmse"), F.lit(mirror).alias("mirror"), scale.alias("scale"),
            F.pmod(F.degrees(theta), F.lit(360.0)).alias("rotation_deg"), tx.alias("tx"), ty.alias("ty"))))
    return usable.select(*keys, "pairs", F.least(*fits).alias("_f")).where("_f is not null").select(*keys, "pairs", "_f.*")


# Fixed values of the line fit.
MIN_R_SQUARED, OUTLIER_RESIDUAL_M, MIN_INLIERS = 0.98, 0.5, 4


_CELLS = 1 << 20


def _line_of(x: np.ndarray, y: np.ndarray, w: np.ndarray, residual: float) -> tuple[float, float] | None:
    """Slope and intercept of the first line through two points with the most votes; lines times points stay below ``_CELLS`` at once."""
    best, line, n = -1, None, len(x)
    step = max(1, _CELLS // max(1, n * n))  # first points at once; the second ones of a point come in slices too
    for i in range(0, n, step):
        for j in range(i + 1, n, max(1, _CELLS // n)):
            p, q = (k.ravel() for k in np.meshgrid(np.arange(i, min(n, i + step)), np.arange(j, min(n, j + max(1, _CELLS // n))), indexing="ij"))
            apart = (q > p) & (np.abs(x[q] - x[p]) >= 1e-6)
            p, q = p[apart], q[apart]
            if len(p):
                slope = (y[q] - y[p]) / (x[q] - x[p])
                start = y[p] - slope * x[p]
                votes = (np.abs(y - (slope[:, None] * x + start[:, None])) <= residual) @ w
                top = int(np.argmax(votes))
                if votes[top] > best:
                    best, line = votes[top], (float(slope[top]), float(start[top]))
    return line


@F.pandas_udf(T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())]))
def _most_voted(xs: pd.Series, ys: pd.Series, ws: pd.Series, residual: pd.Series) -> pd.DataFrame:
    with np.errstate(invalid="ignore", over="ignore"):
        found = [_line_of(np.asarray(x), np.asarray(y), np.asarray(w, dtype=np.float64), r) for x, y, w, r in zip(xs, ys, ws, residual)]
    return pd.DataFrame([line or (None, None) for line in found], columns=["a", "b"], dtype="float64")


def fit_line(df: DataFrame, keys: Sequence[str], x: str, y: str, residual: float = OUTLIER_RESIDUAL_M) -> DataFrame:
    """Straight line per group by votes of point pairs: keys, points, inliers, slope, intercept, r_squared, ok.

    The line through each two points of a group counts the points within ``residual`` of it; the first one, by (x, y) of its points, with the most wins and
    is fitted again to these points.  A single wrong reading cannot pull it away.  A group is one drawing's points, a short list;
    the votes are counted in numpy, some lines at a time; points of one place are folded and count as often as they occur.  Points with a null side are left out.
    """
    points = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    # a stated number, so that AQE does not fold the votes of many cores into a few partitions
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("w")).repartition(spread, *keys).groupBy(*keys).agg(
        F.sum("w").alias("points"), F.array_sort(F.collect_list(F.struct("x", "y", "w"))).alias("_p"))

    def near(line: Column) -> Column:
        return F.filter("_p", lambda p: F.abs(p["y"] - (line["a"] * p["x"] + line["b"])) <= residual)

    def total(pts: Column, term) -> Column:
        return F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["w"] * term(p))

    side = lambda name: F.transform("_p", lambda p: p[name])
    best = _most_voted(side("x"), side("y"), side("w"), F.lit(float(residual)))
    chosen = lists.withColumn("_l", best).withColumn("_in", near(F.col("_l")))
    n = lambda c: total(F.col("_in"), c)
    sums = chosen.select(*keys, "points", "_in", n(lambda p: F.lit(1.0)).alias("_n"), n(lambda p: p["x"]).alias("_sx"), n(lambda p: p["y"]).alias("_sy"))
    mean_x, mean_y = F.try_divide("_sx", "_n"), F.try_divide("_sy", "_n")
    sums = sums.withColumns({"_mx": mean_x, "_my": mean_y})
    sums = sums.withColumns({"_xx": n(lambda p: (p["x"] - F.col("_mx")) * (p["x"] - F.col("_mx"))), "_xy": n(lambda p: (p["x"] - F.col("_mx")) * (p["y"] - F.col("_my"))),
                             "_yy": n(lambda p: (p["y"] - F.col("_my")) * (p["y"] - F.col("_my")))})
    enough = F.coalesce((F.col("_n") >= MIN_INLIERS) & (F.col("_xx") > 1e-9), F.lit(False))
    slope = F.try_divide("_xy", "_xx")
    r2 = F.when(enough & (F.col("_yy") > 1e-12), F.col("_xy") * F.col("_xy") / (F.col("_xx") * F.col("_yy"))).otherwise(0.0)
    return sums.select(*keys, "points", F.col("_n").cast("long").alias("inliers"), F.when(enough, slope).alias("slope"),
                       F.when(enough, F.col("_my") - slope * F.col("_mx")).alias("intercept"), r2.alias("r_squared"), (enough & (r2 >= MIN_R_SQUARED)).alias("ok"))


# Fixed values of the sign repair.
MAGNITUDE_BAND, SIGN_MAJORITY = 0.25, 0.7


def repair_sign(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Flip a value of the minority sign when its size is in the band of the majority."""
    v = F.col(value)
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.count_if(v < 0).alias("_neg"), F.count_if(v > 0).alias("_pos"),
        F.avg(F.when(v < 0, -v)).alias("_ref_neg"), F.avg(F.when(v > 0, v)).alias("_ref_pos"))
    side = (F.when((F.col("_n") < 3), 0).when(F.col("_neg") >= SIGN_MAJORITY * F.col("_n"), -1)
            .when(F.col("_pos") >= SIGN_MAJORITY * F.col("_n"), 1).otherwise(0))
    ref = F.when(side < 0, F.col("_ref_neg")).otherwise(F.col("_ref_pos"))
    flip = F.coalesce((side != 0) & (v * side < 0) & (F.abs(F.abs(v) - ref) <= MAGNITUDE_BAND * ref), F.lit(False))
    return null_safe_join(df, stats, keys).select(
        *df.columns, F.when(flip, -v).otherwise(v).alias("repaired"), flip.alias("flipped"))


# Fixed values of the view check.
Z_TOLERANCE_M, UNVERIFIED_SCORE = 0.6, 0.5


def view_check(marks: DataFrame, openings: DataFrame, key: str, tol: float = Z_TOLERANCE_M) -> tuple[DataFrame, DataFrame]:
    """(score per key, conflicts): opening heads inside the section range, section tops near the first one's.

    ``marks``: key, section, seq, elevation; ``openings``: key, view, head.
    """
    span = marks.groupBy(key).agg(F.min("elevation").alias("_lo"), F.max("elevation").alias("_hi"))
    heads = openings.where("head is not null").join(span, key)
    ok = F.col("head").between(F.col("_lo") - tol, F.col("_hi") + tol)
    tops = marks.groupBy(key, "section").agg(F.max("elevation").alias("_top"), F.min("seq").alias("_seq"))
    ref = tops.groupBy(key).agg(F.min_by(F.struct("section", "_top"), F.struct("_seq", "section")).alias("_ref"))
    others = tops.join(ref, key).where(F.col("section") != F.col("_ref.section"))
    agrees = F.abs(F.col("_top") - F.col("_ref._top")) <= tol
    checks = (heads.select(key, ok.alias("_ok")).unionByName(others.select(key, agrees.alias("_ok")))
              .groupBy(key).agg(F.count("*").alias("checked"), F.count_if("_ok").alias("passed")))
    known = marks.select(key).unionByName(openings.select(key)).distinct()
    score = known.join(checks, key, "left").select(
        key, F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("passed", F.lit(0)).alias("passed"),
        F.when(F.col("checked") > 0, F.round(F.col("passed") / F.col("checked"), 4)).otherwise(UNVERIFIED_SCORE).alias("score"))
    bad = (heads.where(~ok).select(key, F.lit("section_elevation").alias("kind"), F.col("view").cast("string").alias("item"), F.col("head").alias("value"))
           .unionByName(others.where(~agrees).select(key, F.lit("section_section").alias("kind"),
                                                     F.col("section").cast("string").alias("item"), F.col("_top").alias("value"))))
    return score, bad


# Fixed values of candidate resolution.
AUTO_CONFIRM, MIN_SOURCES = 0.88, 2


def resolve(df: DataFrame, conf_min: float = AUTO_CONFIRM, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Candidates (node_type, key, source, confidence) → nodes; confirmed when confident, backed by
    independent sources and without a rival type (rivals are bounded by the type vocabulary)."""
    nodes = df.groupBy("node_type", "key").agg(
        F.round(F.max("confidence"), 4).alias("confidence"), F.count_distinct("source").alias("sources"),
        F.count("*").alias("evidence"))
    types = nodes.groupBy("key").agg(F.count("*").alias("types"), F.array_sort(F.collect_set("node_type")).alias("rival_types"))
    sure = (F.col("confidence") >= conf_min) & (F.col("sources") >= min_sources) & (F.col("types") == 1)
    return nodes.join(types, "key").select(
        "node_type", "key", "confidence", "sources", "evidence", F.when(sure, "confirmed").otherwise("candidate").alias("status"),
        F.when(F.col("types") > 1, F.col("rival_types")).alias("conflict"))


SEGMENT_PATTERN = r"^(.+)[-_.\s][^-_.\s]+$"
MIN_SEGMENT_SAMPLES, MIN_SEGMENT_PURITY = 3, 0.8


def learn_segments(df: DataFrame, number: str, role: str, min_samples: int = MIN_SEGMENT_SAMPLES,
                   min_purity: float = MIN_SEGMENT_PURITY) -> DataFrame:
    """Number segment → role where samples suffice and one role holds the share."""
    rows = df.where(F.col(role).isNotNull() & (F.col(role) != "unknown")).select(
        F.regexp_extract(F.trim(number), SEGMENT_PATTERN, 1).alias("segment"), role).where("segment <> ''")
    tally = rows.groupBy("segment", role).agg(F.count("*").alias("_n"))
    total = tally.groupBy("segment").agg(F.sum("_n").alias("samples"),
                                         F.max_by(F.struct(role, "_n"), F.struct("_n", role)).alias("_top"))
    purity = F.col("_top._n") / F.col("samples")
    return (total.where((F.col("samples") >= min_samples) & (purity >= min_purity))
            .select("segment", F.col(f"_top.{role}").alias(role), "samples", F.round(purity, 4).alias("purity")))


def discover_prefixes(df: DataFrame, name: str, pattern: str, min_rest: int = 2) -> DataFrame:
    """Prefixes (group 1 of the pattern) seen with several distinct remainders (group 2)."""
    split = df.select(F.regexp_extract(name, pattern, 1).alias("prefix"), F.regexp_extract(name, pattern, 2).alias("_rest"))
    return (split.where("prefix <> ''").groupBy("prefix").agg(F.count_distinct("_rest").alias("remainders"))
            .where(F.col("remainders") >= min_rest))

