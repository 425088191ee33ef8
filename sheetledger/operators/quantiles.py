"""Exact order statistics that never gather a whole group in one task.

Spark's ``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer.  Here a mergeable sketch first brackets the wanted ranks,
rows outside the brackets are collapsed to counts before they are shuffled, and
only the narrow bracket is ordered.  The result is exact, as the sketch has a
guaranteed rank error and is used for the bracket only.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import null_safe_join

_ACCURACY = 10_000
_MARGIN = 3.0 / _ACCURACY
_SMALL = 10_000
_FEW = 4  # partitions of merged sketches, of which one alone is over the share that Spark asks for


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    *,
    method: str = "linear",
    count_as: str | None = None,
    rank_of: Callable[[Column], Column] | None = None,
    also: Sequence[Column] = (),
) -> DataFrame:
    """``keys`` + one column per probability (+ the number of non-null values).

    ``linear`` interpolates as PERCENTILE_CONT does; ``index`` takes the element at the zero-based
    rank ``min(floor(p * n), n - 1)``, without interpolation.
    ``rank_of(n)`` replaces the rank of a linear quantile (it must tend to ``p * n``).
    Groups without a non-null value give no row, so a left join yields null, not zero.
    ``also``: named aggregates over all rows, made in the pass that makes the sketch; every group then has a row.
    """
    col = F.col(value) if isinstance(value, str) else value
    valued = df.withColumn("_v", col.cast("double"))
    rows = valued.select(*keys, "_v").where(F.col("_v").isNotNull())
    names = list(probs)
    cuts = []
    for name in names:
        cuts += [max(0.0, probs[name] - _MARGIN), min(1.0, probs[name] + _MARGIN)]
    sketch = (valued if also else rows).groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", cuts, _ACCURACY).alias("_cuts"), *also)
    if also:
        sketch = cut_lineage(sketch)  # one row per group, read twice: the input is not
    # Sketches are measured once they are merged: parts of them look too large to broadcast, and few groups spread over many
    # partitions leave most of those empty, which keeps Spark from it too.  Rows of few groups would be sorted in as few tasks.
    merged = sketch.repartition(_FEW, *keys) if keys else sketch
    placed = null_safe_join(rows, merged.select(*keys, "_n", "_cuts"), keys)
    position = F.lit(0)
    inside = F.lit(False)
    for i in range(len(names)):
        low, high = F.col("_cuts")[2 * i], F.col("_cuts")[2 * i + 1]
        position = position + (F.col("_v") >= low).cast("int") + (F.col("_v") > high).cast("int")
        inside = inside | F.col("_v").between(low, high)
    # A group this small is ordered whole: the bracket is meant for ranks that are close in share.
    inside = inside | (F.col("_n") <= _SMALL)
    position = F.when(F.col("_n") <= _SMALL, F.lit(0)).otherwise(position)
    counted = (
        placed.select(*keys, "_n", position.alias("_pos"), F.when(inside, F.col("_v")).alias("_v"))
        .groupBy(*keys, "_n", "_pos", "_v").agg(F.count("*").alias("_w")))
    window = W.partitionBy(*keys, "_n").orderBy("_pos", "_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_w").over(window))

    def wanted(name: str) -> Column:
        return rank_of(F.col("_n")) if rank_of else F.lit(float(probs[name])) * (F.col("_n") - 1)

    aggs = []
    for name in names:
        if method == "linear":
            low_rank = F.floor(wanted(name))
        else:
            low_rank = F.least(F.floor(F.lit(float(probs[name])) * F.col("_n")), F.col("_n") - 1)
        for suffix, target in (("lo", low_rank), ("hi", low_rank + 1)):
            hit = (F.col("_upto") - F.col("_w") <= target) & (target < F.col("_upto"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{suffix}"))
    wide = ranked.groupBy(*keys, "_n").agg(*aggs)
    out = [F.col(k) for k in keys]
    for name in names:
        low = F.col(f"_{name}_lo")
        if method == "linear":
            part = wanted(name) - F.floor(wanted(name))
            out.append(F.when(part > 0, low + (F.col(f"_{name}_hi") - low) * part).otherwise(low).alias(name))
        else:
            out.append(low.alias(name))
    if count_as:
        out.append(F.col("_n").alias(count_as))
    found = wide.select(*out)
    return null_safe_join(sketch.drop("_n", "_cuts"), found, keys, "left") if also else found


def median_by(df: DataFrame, keys: Sequence[str], value: str | Column, alias: str = "median",
              count_as: str | None = None) -> DataFrame:
    return exact_quantiles(df, keys, value, {alias: 0.5}, count_as=count_as)


def small_median_by(df: DataFrame, keys: Sequence[str], value: str | Column, alias: str = "median",
                    count_as: str | None = None) -> DataFrame:
    """Median of groups whose size the domain bounds (the labels of one sheet): one shuffle."""
    col = (F.col(value) if isinstance(value, str) else value).cast("double")
    aggs = [F.median(col).alias(alias)] + ([F.count(col).alias(count_as)] if count_as else [])
    return df.where(col.isNotNull()).groupBy(*keys).agg(*aggs)
