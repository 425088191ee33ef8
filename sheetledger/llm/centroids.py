"""Centroid clustering of whole-number vectors with the equal-average equal-variance search.

Centroids are sorted by the mean of their components.  A vector scans them outward from its own mean.  The squared distance is
never less than the squared difference of the sums over the dimension, so a scan ends once that exceeds the best
distance; nor is it less than that plus the squared difference of the deviations, which rejects single centroids.
What is left is measured exactly in whole numbers.  A round hands on counts and component sums of each task's
clusters, never rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

_SLACK = 1e-9  # relative; what doubles may be off in a bound
_BLOCK = 4096
#: Largest component, in units of the scale, whose squared distances surely fit 64 bits, for dimensions up to 256.
_MOST = 1 << 26


def whole_numbers(vectors: DataFrame, keys: list[Column], vec_col: str, names: str, dim: int, scale: float) -> DataFrame:
    """``keys`` and ints: floor(scale * x) of each component, x as double, as little-endian 64-bit numbers.

    Left out are vectors that are null, have another length than ``dim`` or hold null or non-finite components.  A component
    beyond the range in which distances are exact is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, found = [], []
            for row in batch.column(batch.num_columns - 1):
                x = row.values if row.is_valid and len(row) == dim and not row.values.null_count else None
                x = None if x is None else np.floor(np.float64(scale) * x.cast(pa.float64()).to_numpy(zero_copy_only=False))
                good.append(x is not None and not np.isnan(x).any() and not np.isinf(row.values.cast(pa.float64()).to_numpy(zero_copy_only=False)).any())
                if good[-1]:
                    if np.abs(x).max() >= _MOST:
                        raise ValueError(f"a component of {np.abs(x).max()} after scaling: distances are exact below {_MOST}")
                    found.append(x.astype("<i8").tobytes())
            rest = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(found, pa.binary())], [*rest.schema.names[:-1], "ints"])

    return vectors.select(*keys, F.col(vec_col).cast("array<double>")).mapInArrow(run, f"{names}, ints binary")


class Search:
    """Nearest centroids, ties to smaller numbers."""

    def __init__(self, centroids: np.ndarray):
        self.order = np.argsort(centroids.sum(axis=1), kind="stable")
        self.rows = centroids[self.order]
        self.sums = self.rows.sum(axis=1)
        self.deviation = _deviation(self.rows)
        self.measured = 0  # distances measured, for tests

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of each row."""
        n, dim = x.shape
        cluster, best = np.full(n, len(self.rows), dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
        sums, deviation = x.sum(axis=1), _deviation(x)
        gap = np.abs(sums[:, None] - self.sums).astype(np.float64) ** 2 / dim
        outward = np.argsort(gap, axis=1, kind="stable")
        live = np.arange(n)
        for step in range(len(self.rows)):
            at = outward[live, step]
            by_mean = gap[live, at]
            inside = by_mean * (1 - _SLACK) <= best[live]  # further out no mean is closer: all others are done
            live, at, by_mean = live[inside], at[inside], by_mean[inside]
            if not len(live):
                break
            near = (by_mean + (deviation[live] - self.deviation[at]) ** 2) * (1 - _SLACK) - _SLACK * (deviation[live] + self.deviation[at] + 1) <= best[live]
            rows, at = live[near], at[near]
            distance = ((x[rows] - self.rows[at]) ** 2).sum(axis=1)
            self.measured += len(rows)
            name = self.order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (name < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = distance[better], name[better]
        return cluster, best


def _deviation(x: np.ndarray) -> np.ndarray:
    """Root of the sum of squared differences from a row's own mean."""
    wide = x.astype(np.float64)
    return np.sqrt(((wide - wide.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, len(batch), _BLOCK):
            part = batch.slice(a, _BLOCK)
            yield part, np.frombuffer(b"".join(part.column(part.num_columns - 1).to_pylist()), dtype="<i8").reshape(-1, dim)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of each non-empty cluster's mean."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, count, total = Search(centroids), np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for _, x in _blocks(batches, dim):
            cluster, _ = search.nearest(x)
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = rows.select("ints").mapInArrow(run, "cluster long, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    after = centroids.copy()
    for r in cells.collect():  # centroids times dimensions
        after[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return after


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part.

    Components are floor(scale * x).  The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:id``, in
    that order (rows of equal ids by their components); each round assigns every vector to the nearest centroid, by squared distance, ties to the smaller
    number, and moves every non-empty centroid to the floor of its vectors' mean.  Vectors null, of another length, or holding null or
    non-finite components are left out.  Fewer than ``k`` vectors: as many centroids.  Rows repeated, under whatever id, count each, null ids
    (hashed as an empty text) too.  Other columns are ignored; an empty table gives an empty result.  Distances are exact; a scaled component of 2^26 or more is an error.
    """
    spark = vectors.sparkSession
    rows = keep(whole_numbers(vectors, [F.col(id_col).cast("long").alias("vec_id")], vec_col, "vec_id long", dim, scale), "vectors")
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select("ints").orderBy(lot, "ints").limit(k).collect()  # k rows
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    centroids = np.array([np.frombuffer(r["ints"], dtype="<i8") for r in first])
    for _ in range(rounds):
        centroids = _moved(rows, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for part, x in _blocks(batches, dim):
            found, distance = search.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = keep(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "placed")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k
    table = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
