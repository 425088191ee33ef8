"""Keyed writes as DataFrame algebra: the table after the write is the returned plan."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def last_per_key(delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Latest delta row per key; the row-number limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return delta.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keyed_upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 protected: Callable[[str], Column] | None = None) -> DataFrame:
    """The new row replaces the old one on its key.

    ``protected(alias)`` marks rows that only another protected row may replace
    (a manual value is not overwritten by an automatic one).
    """
    fresh = last_per_key(delta, keys, order)
    if protected is not None:
        guarded = base.where(protected("")).select(*keys)
        blocked = fresh.alias("a").join(guarded.alias("b"), _same_key(keys), "left_semi").where(~protected("a."))
        fresh = fresh.alias("a").join(blocked.select(*keys).alias("b"), _same_key(keys), "left_anti")
    kept = base.alias("a").join(fresh.select(*keys).alias("b"), _same_key(keys), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_open(base: DataFrame, delta: DataFrame, keys: Sequence[str], is_open: Column,
                order: Sequence[Column]) -> DataFrame:
    """At most one open row per key: delta refreshes it, closed rows stay as history."""
    return base.where(~is_open).unionByName(keyed_upsert(base.where(is_open), delta, keys, order))


def insert_absent(base: DataFrame, delta: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``delta`` whose key ``base`` lacks; the first in ``order`` wins inside the delta."""
    fresh = last_per_key(delta, keys, order)
    return fresh.alias("a").join(base.select(*keys).alias("b"), _same_key(keys), "left_anti")


def replace_by_key(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete-then-insert of whole keys, so a repeated extraction gives the same table."""
    touched = delta.select(*keys).distinct()
    kept = base.alias("a").join(touched.alias("b"), _same_key(keys), "left_anti")
    return kept.unionByName(delta)


def audit_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per inserted, changed or deleted key with old and new state as JSON."""
    old = before.select(*keys, F.struct(*cols).alias("_old"))
    new = after.select(*keys, F.struct(*cols).alias("_new"))
    joined = old.alias("a").join(new.alias("b"), _same_key(keys), "full")
    action = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update"))
    return (joined.where(~F.col("_old").eqNullSafe(F.col("_new")))
            .select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys],
                    action.alias("action"),
                    F.to_json("_old").alias("old_state"), F.to_json("_new").alias("new_state")))


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def overwrite_keys(delta: DataFrame, path: str, partition: str) -> None:
    """On-disk form of ``replace_by_key`` when the key is the partition column."""
    (delta.hint("rebalance", partition).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))
