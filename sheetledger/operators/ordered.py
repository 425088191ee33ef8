"""Ordered scans over groups that may be very large.

A plain window needs all rows of a key in one task.  Here rows are dealt out in ranges of (keys, order), so a key with
very many rows lies in many parts, one after another.  Each part hands on one row per key: its last and first values and its totals.
These small rows, shifted or summed over the parts before, come back as a head (or, for what looks ahead, a tail) of
the next part's rows, so windows never reach beyond a part.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class Run:
    """A running ``sum`` or ``max`` of ``value`` up to each row, or up to the one before; ``reverse`` runs from the end."""

    value: Column
    how: str = "sum"
    before: bool = False
    reverse: bool = False

    def over(self, col: str, window) -> Column:
        return {"sum": F.sum, "max": F.max}[self.how](col).over(window)


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` dealt out in ranges of (keys, order), with the number of its part as ``_part``.

    Borders come from a sample, so they are written down before two plans read them.
    """
    return cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: Mapping[str, str] | None = None,
         leads: Mapping[str, str] | None = None, runs: Mapping[str, Run] | None = None) -> DataFrame:
    """``df`` with columns of the row before (``lags``: new name to source), the row after (``leads``) and running totals.

    ``order`` is ascending and must be total within a key.
    """
    lags, leads, runs = lags or {}, leads or {}, runs or {}
    back = {n for n, r in runs.items() if r.reverse}
    ranged = in_parts(df.withColumns({f"_x_{n}": r.value for n, r in runs.items()}), keys, order)
    place = F.struct(*[F.col(c) for c in order])
    ends = {}
    if lags:
        ends["_last"] = F.max_by(F.struct(*sorted(set(lags.values()))), place)
    if leads:
        ends["_first"] = F.min_by(F.struct(*sorted(set(leads.values()))), place)
    ends |= {f"_t_{n}": {"sum": F.sum, "max": F.max}[r.how](f"_x_{n}") for n, r in runs.items()}
    edges = ranged.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in ends.items()])
    ahead, behind = W.partitionBy(*keys).orderBy("_part"), W.partitionBy(*keys).orderBy(F.desc("_part"))

    def carried(n: str, parts) -> Column:
        return runs[n].over(f"_t_{n}", parts.rowsBetween(W.unboundedPreceding, -1)).alias(f"_x_{n}")

    rows = ranged.withColumn("_at", F.lit(0))
    if lags or set(runs) - back:
        last = F.lag("_last").over(ahead) if lags else None
        rows = rows.unionByName(edges.select(*keys, "_part", F.lit(-1).alias("_at"), *[last[c].alias(c) for c in sorted(set(lags.values()) - set(keys))],
                                             *[carried(n, ahead) for n in runs if n not in back]), allowMissingColumns=True)
    if leads or back:
        first = F.lag("_first").over(behind) if leads else None
        rows = rows.unionByName(edges.select(*keys, "_part", F.lit(1).alias("_at"), *[first[c].alias(c) for c in sorted(set(leads.values()) - set(keys))],
                                             *[carried(n, behind) for n in back]), allowMissingColumns=True)
    inner = W.partitionBy(*keys, "_part").orderBy("_at", *order)
    turned = W.partitionBy(*keys, "_part").orderBy(F.desc("_at"), *[F.desc(c) for c in order])
    new = {n: F.lag(c).over(inner) for n, c in lags.items()} | {n: F.lead(c).over(inner) for n, c in leads.items()}
    for n, r in runs.items():
        total = r.over(f"_x_{n}", (turned if r.reverse else inner).rowsBetween(W.unboundedPreceding, -1 if r.before else 0))
        new[n] = F.coalesce(total, F.lit(0)) if r.how == "sum" else total
    kept = [c for c in df.columns if c not in new]
    return rows.select("_at", *kept, *[c.alias(n) for n, c in new.items()]).where("_at = 0").drop("_at")


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, str], step: int = -1) -> DataFrame:
    """``lag`` (step -1) or ``lead`` (step 1) of columns; ``cols`` maps new name to source."""
    return scan(df, keys, order, lags=cols) if step < 0 else scan(df, keys, order, leads=cols)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, alias: str, how: str = "sum",
            before: bool = False, reverse: bool = False) -> DataFrame:
    """Running ``sum`` or ``max`` up to each row (or up to the row before, with ``before``)."""
    return scan(df, keys, order, runs={alias: Run(value, how, before, reverse)})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str = "seq") -> DataFrame:
    """``row_number`` over a group of any size (``order`` total within a key)."""
    return running(df, keys, order, F.lit(1).cast("long"), alias)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, alias: str = "island") -> DataFrame:
    """Number the runs that begin where ``starts`` holds."""
    return running(df, keys, order, starts.cast("long"), alias)
