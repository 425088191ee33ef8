"""One-to-one assignment from candidate pairs, without gathering a group."""

from __future__ import annotations

import itertools
import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder


def one_to_one(pairs: DataFrame, a: Sequence[str], b: Sequence[str], cost_a: Column, cost_b: Column) -> DataFrame:
    """Stable one-to-one choice: every ``a`` offers itself to its cheapest ``b``, every ``b``
    keeps its cheapest offer, and pairs worse than a kept offer are struck out.

    With one shared cost this is the greedy choice over all pairs in cost order; with ``cost_b``
    a rank of ``a`` it is the choice in which the ``a`` pick in rank order.  Costs must be total
    (end them with a key); they are read off the rows each time and not stored beside them.  A round is two aggregations, whose result
    is written down with the number of offers, and one join; rounds end when no offer is refused.
    """
    live = cut_lineage(pairs)
    whole = F.struct(*live.columns)
    while True:
        offers = live.groupBy(*a).agg(F.min_by(whole, cost_a).alias("_o")).select("_o.*")
        kept = cut_lineage(offers.groupBy(*b).agg(F.min_by(whole, cost_b).alias("_o"), F.count("*").alias("_offers")).select("_o.*", "_offers"))
        if kept.where("_offers > 1").isEmpty():
            return kept.drop("_offers")
        best = kept.select(*b, cost_b.alias("_best"))
        live = cut_lineage(live.join(best, list(b), "left")
                           .where(F.col("_best").isNull() | (cost_b <= F.col("_best"))).select(*live.columns))


def shared_out(pairs: DataFrame, a: Sequence[str], b: Sequence[str], cost: Column, room_a: str, room_b: str) -> DataFrame:
    """Greedy choice over all pairs in cost order where a node stands for many equal items: ``room_a`` and ``room_b`` of them.

    A pair that is the cheapest at both of its ends takes as many items as both have left, so one end is used up.
    Returns the pairs taken with ``taken`` and the places of their first items, ``from_a`` and ``from_b`` (from 0).  The cost must be total.  A round's
    choices go to the shared folder and are read once at the end, so plans do not grow with the rounds.
    """
    spark, folder = pairs.sparkSession, f"{shared_folder(pairs.sparkSession)}/rounds-{uuid.uuid4().hex}"
    zero = F.lit(0).cast("long")
    live = cut_lineage(pairs.withColumns({"_cost": cost, "from_a": zero, "from_b": zero, room_a: F.col(room_a).cast("long"), room_b: F.col(room_b).cast("long")}))
    out = [c for c in live.columns if c not in ("_cost", room_a, room_b)]
    for turn in itertools.count():
        best = live.groupBy(*b).agg(F.min("_cost").alias("_best"))
        offers = live.groupBy(*a).agg(F.min_by(F.struct(*live.columns), "_cost").alias("_o")).select("_o.*")
        won = offers.join(best, list(b)).where(F.col("_cost") == F.col("_best")).select(*out, F.least(room_a, room_b).alias("taken"))
        won.write.parquet(f"{folder}/{turn}")
        won = spark.read.schema(won.schema).parquet(f"{folder}/{turn}")
        if won.isEmpty():
            return spark.read.schema(won.schema).option("recursiveFileLookup", "true").parquet(folder)
        for end, room, start in ((a, room_a, "from_a"), (b, room_b, "from_b")):
            used, left = F.coalesce("_used", zero), live.join(won.select(*end, F.col("taken").alias("_used")), list(end), "left")
            live = left.withColumns({room: F.col(room) - used, start: F.col(start) + used}).drop("_used").where(F.col(room) > 0)
        live = cut_lineage(live)
