"""Small building blocks shared by the operators."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet (as in GROUP BY); the right keys are dropped.

    The null-safe equality is still a hash/merge join key, so nothing falls back to a loop.  Without keys the right
    side is an aggregate of one row, and only then is it broadcast.
    """
    if not keys:
        return (left.withColumn("_one", F.lit(0))
                .join(F.broadcast(right.withColumn("_one", F.lit(0))), "_one", how).drop("_one"))
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A dictionary or parameter table given by the caller.

    Its size is fixed by the call, not by the data, so it may be broadcast.
    """
    return spark.createDataFrame(list(rows), schema)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def exact_sum(col: Column | str, scale: int = 2) -> Column:
    """Sum money in decimals: the total does not depend on the order in which partials merge."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col.cast(f"decimal(28,{scale})"))


def each_block(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[dict], dict], keep: Sequence[str],
               added: str) -> DataFrame:
    """Ordered pass over the blocks of ``keys`` with one Arrow stream per partition.

    Spark hashes blocks to partitions and sorts them; ``fn`` gets the columns of one block as
    arrays and returns the added columns.  Only the block at hand is held, so many small blocks
    cost no per-group call overhead.  Blocks must be bounded by their making (a cell, an island).
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep) + ", " + added
    names = [f.name for f in df.schema if f.name in keep] + [a.split()[0] for a in added.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            cuts = _starts(batch, keys)
            if held and _same(held[-1], batch):
                cuts = cuts[1:]
            if held and cuts:
                first = pd.concat([*held, batch.iloc[:cuts[0]]], ignore_index=True)
                yield _apply(first, [0])
                held = []
            if cuts:
                if len(cuts) > 1:
                    yield _apply(batch.iloc[cuts[0]:cuts[-1]], [c - cuts[0] for c in cuts[:-1]])
                batch = batch.iloc[cuts[-1]:]
            held.append(batch)
        if held:
            yield _apply(pd.concat(held, ignore_index=True), [0])

    def _same(last: pd.DataFrame, batch: pd.DataFrame) -> bool:
        a, b = last.iloc[-1], batch.iloc[0]
        return all(a[k] == b[k] or (pd.isna(a[k]) and pd.isna(b[k])) for k in keys)

    def _starts(batch: pd.DataFrame, by: Sequence[str]) -> list[int]:
        new = np.zeros(len(batch), dtype=bool)
        new[0] = True
        for k in by:
            col = batch[k].to_numpy()
            blank = pd.isna(col)
            new[1:] |= (col[1:] != col[:-1]) & ~(blank[1:] & blank[:-1])
        return list(np.flatnonzero(new))

    def _apply(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        cols = {c: batch[c].to_numpy() for c in batch.columns}
        ends = [*cuts[1:], len(batch)]
        parts = [fn({c: v[a:b] for c, v in cols.items()}) for a, b in zip(cuts, ends)]
        extra = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        return batch.assign(**extra)[names]

    # a stated number, so that AQE does not fold the Python work of many cores into a few large partitions
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(spread, *keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)
