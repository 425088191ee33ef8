"""Longest increasing runs and inverted pairs of ranks, for groups that may be very large.

Rows are dealt out twice: in parts by their order and in bands by their rank.  Only what crosses parts or bands
travels further, as small states or counts; a task holds the rows of one part, one band, or one block of both.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import each_block, null_safe_join
from .ordered import in_parts


class Stairs:
    """The best length of a run up to each rank, where it rises."""

    def __init__(self, ranks: Sequence = (), lengths: Sequence = ()):
        self.ranks, self.lengths = list(ranks), list(lengths)

    def below(self, rank) -> int:
        """Best length of a run that ends under ``rank``."""
        at = bisect_left(self.ranks, rank)
        return self.lengths[at - 1] if at else 0

    def add(self, rank, length: int) -> None:
        at = bisect_left(self.ranks, rank)
        if at < len(self.ranks) and self.ranks[at] == rank:
            if self.lengths[at] >= length:
                return
        elif at and self.lengths[at - 1] >= length:
            return
        end = at
        while end < len(self.ranks) and self.lengths[end] <= length:
            end += 1
        self.ranks[at:end], self.lengths[at:end] = [rank], [length]


def block_run(seqs: Sequence, ranks: Sequence, left: Stairs, below: Stairs) -> tuple[Stairs, Stairs, int]:
    """Run lengths of a block's rows, in their order.

    ``left`` tells the best run of lower bands by place, ``below`` the best run of earlier parts by rank, inside the band.  Back come
    the same two for the next band and the next part, and the block's best length.
    """
    across, best = Stairs(left.ranks, left.lengths), below.lengths[-1] if below.lengths else 0
    if best:
        across.add(-1, best)  # runs of earlier parts stand before every place of this one
    for seq, rank in zip(seqs, ranks):
        length = 1 + max(left.below(seq), below.below(rank))
        below.add(rank, length)
        across.add(seq, length)
        best = max(best, length)
    return across, below, best


def longest_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str) -> DataFrame:
    """keys, length: the longest strictly increasing run of ranks in the order, per key.

    Blocks of one part and one band are walked row by row.  A block needs the states of the block before it in its part and
    in its band only, so all blocks of one diagonal run at once; keys of one block pass beside them in one stream.
    ``order`` is total within a key; ranks are not null.
    """
    ranged = df.select(*keys, *order, F.col(rank).alias("_r")).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_lineage(ranged.select(*keys, "_r", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_s")))
    bands = in_parts(rows.select(*keys, "_r").distinct(), keys, ["_r"]).groupBy(*keys, "_part").agg(F.min("_r").alias("_low"))
    # a border between two partitions cuts one key at most, so both tables have fewer rows than there are partitions
    cuts = bands.groupBy(*keys).agg(F.array_sort(F.collect_list("_low")).alias("_lows")).where(F.size("_lows") > 1)
    parts = rows.groupBy(*keys).agg(F.min("_p").alias("_p0"), F.max("_p").alias("_p1")).where("_p0 < _p1")
    placed = null_safe_join(null_safe_join(rows, F.broadcast(cut_lineage(cuts)), keys, "left"), F.broadcast(cut_lineage(parts)), keys, "left")
    placed = placed.select(*keys, "_r", "_s", (F.col("_p") - F.coalesce("_p0", "_p")).alias("_p"),
                           F.coalesce(F.size(F.filter("_lows", lambda x: x <= F.col("_r"))) - 1, F.lit(0)).alias("_b"),
                           F.coalesce(F.col("_p1") - F.col("_p0"), F.lit(0)).alias("_pn"), F.coalesce(F.size("_lows") - 1, F.lit(0)).alias("_bn"))
    rank_type = df.schema[rank].dataType.simpleString()
    placed = cut_lineage(placed.withColumn("_t", F.col("_p") + F.col("_b")))
    # a key of one block needs no state, so many small keys pass in one stream
    alone = F.lit(bool(keys)) & (F.col("_pn") == 0) & (F.col("_bn") == 0)
    small, placed = placed.where(alone).select(*keys, "_r", "_s"), placed.where(~alone)
    last = placed.agg(F.max(F.col("_pn") + F.col("_bn"))).first()[0]
    form = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + (
        ", " if keys else "") + f"_p int, _b int, _pn int, _bn int, _kind string, _at array<{rank_type}>, _place array<bigint>, _len array<bigint>"
    names = [*keys, "_p", "_b", "_pn", "_bn"]

    def walk(block: pa.Table) -> pa.Table:
        kinds = np.array(block.column("_kind").to_pylist(), dtype=object)
        own = block.take(pa.array(np.flatnonzero(kinds == "row")))
        seqs, ranks = own.column("_s").to_numpy(), own.column("_r").to_pylist()
        order = np.argsort(seqs, kind="stable").tolist()

        def state(kind: str, *cols: str) -> Stairs:
            at = np.flatnonzero(kinds == kind).tolist()
            return Stairs(*(block.column(c)[at[0]].as_py() for c in cols)) if at else Stairs()

        across, up, best = block_run(seqs[order].tolist(), [ranks[i] for i in order], state("left", "_place", "_len"), state("below", "_at", "_len"))
        head = {c: block.column(c)[0].as_py() for c in names}
        out = [head | {"_kind": "best", "_at": None, "_place": None, "_len": [best]}]
        if head["_b"] < head["_bn"]:
            out.append(head | {"_b": head["_b"] + 1, "_kind": "left", "_at": None, "_place": across.ranks, "_len": across.lengths})
        if head["_p"] < head["_pn"]:
            out.append(head | {"_p": head["_p"] + 1, "_kind": "below", "_at": up.ranks, "_place": None, "_len": up.lengths})
        return pa.Table.from_pylist(out, schema=pa.schema([block.schema.field(c) for c in (*names, "_kind", "_at", "_place", "_len")]))

    def rise(block: dict) -> dict:
        ends: list = []
        for rank in block["_r"].tolist():
            at = bisect_left(ends, rank)
            ends[at:at + 1] = [rank]
        return {"_best": np.full(len(block["_r"]), len(ends), dtype=np.int64)}

    best, states = [each_block(small, keys, ["_s"], rise, keys, "_best long")] if keys else [], None
    for t in range(0 if keys and last is None else (last or 0) + 1):
        turn = placed.where(F.col("_t") == t).drop("_t").withColumn("_kind", F.lit("row"))
        if states is not None:
            turn = turn.unionByName(states, allowMissingColumns=True)
        else:
            turn = turn.withColumns({"_at": F.lit(None).cast(f"array<{rank_type}>"), "_place": F.lit(None).cast("array<bigint>"), "_len": F.lit(None).cast("array<bigint>")})
        walked = cut_lineage(turn.groupBy(*keys, "_p", "_b").applyInArrow(walk, form))
        states = walked.where("_kind <> 'best'")
        best.append(walked.where("_kind = 'best'").select(*keys, F.col("_len")[0].alias("_best")))
    found = best[0]
    for more in best[1:]:
        found = found.unionByName(more)
    return found.groupBy(*keys).agg(F.max("_best").alias("length"))


def weighted_inversions(place: np.ndarray, value: np.ndarray, weight: np.ndarray) -> int:
    """Sum of the products of weights over all pairs with a smaller place and a larger value; merged level by level."""
    order = np.lexsort((value, place))  # at one place smaller values come first, so these make no pair
    _, value = np.unique(value[order], return_inverse=True)
    weight, total, width, n = weight[order].astype(np.int64), 0, 1, len(value)
    index = np.arange(n)
    while width < n:
        by = np.lexsort((value, index // (2 * width)))
        right = (index[by] // width) % 2 == 1
        lefts = np.where(right, 0, weight[by])
        upto = np.cumsum(lefts)
        pair = index[by] // (2 * width)
        # of each merged pair of runs: left weights of values up to and including a row's own
        group = pair * (value.max() + 1) + value[by]
        end = np.searchsorted(group, group, "right") - 1
        last = np.searchsorted(pair, pair, "right") - 1
        total += int(((upto[last] - upto[end]) * weight[by])[right].sum())
        width *= 2
    return total


def inverted_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """keys, inverted: pairs of an earlier row and a later one with a smaller value.

    Pairs inside a part are counted there.  Of pairs in two parts, those inside a band are counted there, over values with
    their number of rows in each part; the others follow from the number of rows in each part and band alone.
    ``order`` is total within a key; values are not null.
    """
    ranged = df.select(*keys, *order, F.col(value).alias("_v")).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = cut_lineage(ranged.select(*keys, "_v", F.spark_partition_id().cast("long").alias("_p"), F.monotonically_increasing_id().alias("_s")))
    folded = rows.groupBy(*keys, "_p", "_v").agg(F.count("*").alias("_n")).repartitionByRange(*keys, "_v")
    counts = cut_lineage(folded.withColumn("_part", F.spark_partition_id()))
    cells = counts.groupBy(*keys, "_p", F.col("_part").cast("long").alias("_v")).agg(F.sum("_n").alias("_n"))
    inside = _counted(rows.withColumn("_n", F.lit(1).cast("long")).select(*keys, F.col("_p").alias("_part"), "_s", "_v", "_n"), keys)  # sorted as they lie
    banded = _counted(counts.select(*keys, "_part", "_p", "_v", "_n").sortWithinPartitions(*keys, "_part"), keys)
    # a key of one part has no pair in two
    wide = W.partitionBy(*keys)
    across = cells.withColumn("_many", F.min("_p").over(wide) < F.max("_p").over(wide)).where("_many")
    rest = across.select(*keys, F.lit(0).alias("_part"), "_p", "_v", "_n")
    rest = _counted((rest.repartition(*keys) if keys else rest.coalesce(1)).sortWithinPartitions(*keys, "_part"), keys)
    return inside.unionByName(banded).unionByName(rest).groupBy(*keys).agg(F.sum("_c").alias("inverted"))


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _c: weighted inversions of each block (keys, _part) of rows (keys, _part, place, value, weight) that lie block by block."""
    form = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys) + "_c long"
    place, value, weight = rows.columns[-3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(block: pa.Table) -> pa.RecordBatch:
            found = weighted_inversions(*(block[c].to_numpy() for c in (place, value, weight)))
            head = block.slice(0, 1).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*(head.column(k) for k in keys), pa.array([found], pa.int64())], [*keys, "_c"])

        for batch in batches:
            start = 0
            if len(batch) == 0:
                continue
            cuts = _changes(batch, [*keys, "_part"])
            if held and _head(held[0], [*keys, "_part"]) != _head(batch, [*keys, "_part"]):
                yield done(pa.Table.from_batches(held))
                held = []
            for cut in cuts:
                yield done(pa.Table.from_batches([*held, batch.slice(start, cut - start)]))
                held, start = [], cut
            held.append(batch.slice(start))
        if held:
            yield done(pa.Table.from_batches(held))

    return rows.mapInArrow(run, form)


def _head(batch: pa.RecordBatch, by: Sequence[str]) -> tuple:
    return tuple(batch.column(k)[0].as_py() for k in by)


def _changes(batch: pa.RecordBatch, by: Sequence[str]) -> list[int]:
    """Places where a sorted batch goes on to the next block."""
    new = np.zeros(max(0, len(batch) - 1), dtype=bool)
    for k in by:
        code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return (np.flatnonzero(new) + 1).tolist()
