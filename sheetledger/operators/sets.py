"""Set operations (SET)."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def unify(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Issue sources (each with ``source_key``) to one shape; id = source:key."""
    shaped = [df.withColumn("source", F.lit(name)).withColumn(
        "id", F.concat(F.lit(f"{name}:"), F.col("source_key").cast("string"))) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shaped)


def missing(vocabulary: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return vocabulary.select(key).distinct().join(df.select(key), key, "left_anti")


def shared(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of both sides whose value differs, null-safe, with the former value."""
    joined = new.select(key, value).join(old.select(key, F.col(value).alias("was")), key)
    return joined.where(~F.col(value).eqNullSafe(F.col("was")))


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Matched, only in A, only in B and Jaccard with duplicates counted."""
    left = a.groupBy(*keys, label).agg(F.count("*").alias("_a"))
    right = b.groupBy(*keys, label).agg(F.count("*").alias("_b"))
    both = left.select(*keys, label, "_a", F.lit(0).cast("long").alias("_b")).unionByName(
        right.select(*keys, label, F.lit(0).cast("long").alias("_a"), "_b")).groupBy(*keys, label).agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    matched, union = F.sum(F.least("_a", "_b")), F.sum(F.greatest("_a", "_b"))
    return both.groupBy(*keys).agg(
        matched.alias("matched"), F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("only_a"),
        F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("only_b"), F.round(matched / union, 4).alias("jaccard"))
