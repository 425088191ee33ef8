"""Approximate nearest neighbours by cosine: cross-polytope hashing with several probes a table.

A vector is turned by three rounds of random signs and a Hadamard transform; its hash is the nearest signed axis.  A table
joins two such hashes: the first names a shard, the second a bucket inside it.  A query visits the buckets that cost it
least, where the cost of an axis is how much shorter the query is along it than along its own.  Shards lie in tiles,
queries in blocks; a task meets one block with one tile, scores the candidates of the probed buckets
exactly and hands on the best few of each query.  How many buckets are probed is fitted on a sample of queries, whose
true neighbours come from a scan of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

_CLOSE = 1e-9  # what two ways to sum a product of unit vectors may differ by


def vector_rows(vectors: DataFrame, keys: list[Column], vec_col: str, names: str) -> tuple[DataFrame, str]:
    """``keys`` and v: each vector's components as little-endian bytes of the column's own type, whose numpy name comes second.

    Vectors that are null, empty, zero, or hold null or non-finite components are left out.
    """
    single = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    kind, type_ = ("<f4", pa.float32()) if single else ("<f8", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            good, found = [], []
            for row in column:
                x = row.values.cast(type_) if row.is_valid else None
                if x is None or not len(x) or x.null_count:
                    good.append(False)
                    continue
                x = x.to_numpy(zero_copy_only=False)
                good.append(bool(np.isfinite(x).all() and x.any()))
                if good[-1]:
                    found.append(x.astype(kind).tobytes())
            rest = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(found, pa.binary())], [*rest.schema.names[:-1], "v"])

    plain = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    return vectors.select(*keys, plain.alias("v")).mapInArrow(run, f"{names}, v binary"), kind


def matrix(blobs: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Rows as doubles, scaled by a power of two each so that no square overflows or vanishes; cosines stay as they are."""
    x = np.frombuffer(b"".join(blobs), dtype=kind).astype(np.float64).reshape(-1, dim)
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0.0))
    return np.ldexp(x, -exponent[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; the number of columns is a power of two."""
    rows, dim = x.shape
    half = 1
    while half < dim:
        pair = x.reshape(rows, dim // (2 * half), 2, half)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(rows, dim)
        half *= 2
    return x / np.sqrt(dim)


class Rotations:
    """Two pseudo-rotations for each table."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.dim, self.tables = dim, tables
        self.wide = 1 << max(0, dim - 1).bit_length()
        self.axes = 2 * self.wide  # axis i and its opposite have numbers i and i + wide
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, self.wide))

    def turned(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        y = np.zeros((len(x), self.wide))
        y[:, :self.dim] = x / lengths(x)[:, None]
        for signs in self.signs[table, which]:
            y = hadamard(y * signs)
        return y

    def costs(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        """(rows, axes): how much each signed axis costs; the nearest one nothing."""
        y = self.turned(x, table, which)
        both = np.concatenate([y, -y], axis=1)
        return (both.max(axis=1)[:, None] - both) ** 2

    def codes(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        first, second = (np.argmin(self.costs(x, table, k), axis=1) for k in (0, 1))
        return first, second

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """(rows, axes, axes): the ``count`` cheapest pairs of axes of each row.

        The pair of the i-th cheapest first and the j-th cheapest second axis is no cheaper than i times j others, so only pairs
        with i * j up to ``count`` are looked at.
        """
        one, two = self.costs(x, table, 0), self.costs(x, table, 1)
        order_one, order_two = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        i, j = np.nonzero(np.outer(np.arange(1, self.axes + 1), np.arange(1, self.axes + 1)) <= count)
        total = np.take_along_axis(one, order_one, 1)[:, i] + np.take_along_axis(two, order_two, 1)[:, j]
        best = np.argpartition(total, min(count, len(i)) - 1, axis=1)[:, :count]
        row = np.arange(len(x))[:, None]
        visited = np.zeros((len(x), self.axes, self.axes), dtype=bool)
        visited[row, order_one[row, i[best]], order_two[row, j[best]]] = True
        return visited

    def place(self, x: np.ndarray, table: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How many pairs of axes are cheaper for each row than its (first, second)."""
        one, two = self.costs(x, table, 0), np.sort(self.costs(x, table, 1), axis=1)
        rows = np.arange(len(x))
        cost = one[rows, first] + self.costs(x, table, 1)[rows, second]
        return np.array([np.searchsorted(two[r], cost[r] - one[r] - 1e-12, "left").sum() for r in rows], dtype=np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


def _candidates(query: np.ndarray, x: np.ndarray, near: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of the rows of a tile, given their ``near`` scores (minus infinity: not probed)."""
    n = int(np.isfinite(near).sum())
    if not n:
        return np.empty(0), np.empty(0, dtype=np.int64)
    floor = np.partition(near, len(near) - k)[len(near) - k] if n > k else -2.0
    at = np.flatnonzero(near >= floor - _CLOSE)
    score = (x[at] * query).sum(axis=1) / (lengths(x[at]) * lengths(query[None])[0])  # row by row, so equal vectors score the same
    owned = [ids[i] for i in at]
    score, flat = np.repeat(score, [len(o) for o in owned]), np.concatenate(owned)
    chosen = _best(score, flat, k)
    return score[chosen], flat[chosen]


def _scored(units: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (units / lengths(units)[:, None]) @ (others / lengths(others)[:, None]).T


def fitted_probes(nodes: DataFrame, asking: DataFrame, kind: str, dim: int, turn: Rotations, k: int, sample: int, recall: float) -> int:
    """The fewest probes a table with which the sample's true neighbours are found to the wanted share.

    ``sample`` query vectors, chosen by a hash, are compared with all rows; their neighbours' buckets tell how many probes each needs.
    """
    chosen = [(r["node"], bytes(r["v"])) for r in asking.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(sample).collect()]  # at most ``sample``
    asked = matrix([v for _, v in chosen], kind, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            near = _scored(asked, matrix(blobs, kind, dim))
            out: tuple[list, ...] = ([], [], [], [])
            for q, (own, _) in enumerate(chosen):
                near[q, node == own] = -np.inf
                for i in _best(near[q], node, k):
                    if np.isfinite(near[q, i]):
                        for c, v in zip(out, (q, near[q, i], node[i], blobs[i])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.float64(), pa.int64(), pa.binary()))], ["q", "score", "node", "v"])

    true = nodes.select("node", "v").mapInArrow(run, "q int, score double, node long, v binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "node"))
    found = true.withColumn("place", place).where(F.col("place") <= k).collect()  # at most k for each of the sample
    if not found:
        return 1
    x, y = asked[[r["q"] for r in found]], matrix([bytes(r["v"]) for r in found], kind, dim)
    needed = np.min([turn.place(x, t, *turn.codes(y, t)) for t in range(turn.tables)], axis=0) + 1
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4, recall: float = 0.95,
            sample: int = 256, probes: int | None = None, tile: int = 2048, block: int = 512, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows found with the largest cosine to every query, but its own.

    Every row is in the index.  ``probes`` is how many of a table's buckets a query visits; where it is not given, it is fitted so
    that ``sample`` queries find the share ``recall`` of their true neighbours (all buckets, if it takes as many; then results are
    exact).  Scores are cosines of the original vectors in doubles; ties go to the smaller id.  Vectors that are null, empty, zero, or hold
    null or non-finite components take no part; vectors of several lengths are an error.  Equal vectors are folded before they meet,
    however many there are, and count each.  Fewer than k other rows: all that are found.  Ids are unique and not null; other columns are
    ignored; no queries or an empty table give an empty result.
    """
    spark = vectors.sparkSession
    raw, kind = vector_rows(vectors, [F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks")], vec_col, "id long, asks boolean")
    rows = keep(raw, "vectors")
    head = rows.agg(F.min(F.octet_length("v")).alias("least"), F.max(F.octet_length("v")).alias("most"), F.count_if("asks").alias("asking")).first()
    if not head["asking"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if head["least"] != head["most"]:
        raise ValueError("vectors of several lengths have no cosine")
    dim = head["least"] // np.dtype(kind).itemsize
    turn, more = Rotations(dim, tables, seed), k + 1  # one more, for a query finds itself

    # equal vectors are one node with their k + 1 smallest ids: no other of them can be among k results
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = keep(rows.select("id", "v").withColumn("_r", rank).where(F.col("_r") <= more).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                 .select(F.col("ids")[0].alias("node"), "ids", "v"), "nodes")
    asked = keep(rows.where("asks").join(nodes.select("node", "v"), "v").select(F.col("id").alias("query_id"), "node"), "asked")
    asking = keep(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "v"), "asking")
    count = probes or fitted_probes(nodes, asking, kind, dim, turn, k, sample, recall)
    count = min(count, turn.axes ** 2)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_pylist(), kind, dim)
            for t in range(tables):
                first, second = turn.codes(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(first, pa.int32()), pa.array(second, pa.int32()), *batch.columns],
                                                 ["t", "shard", "bucket", "node", "ids", "v"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.slice(a, 128)
                x = matrix(part.column(1).to_pylist(), kind, dim)
                for t in range(tables):
                    visited = turn.probes(x, t, count)
                    row, shard = np.nonzero(visited.any(axis=2))
                    masks = np.packbits(visited[row, shard], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t), pa.int32()), pa.array(shard, pa.int32()), pa.array([m.tobytes() for m in masks], pa.binary()),
                                                      *(c.take(pa.array(row)) for c in part.columns)], ["t", "shard", "mask", "node", "v"])

    indexed = nodes.select("node", "ids", "v").mapInArrow(index, "t int, shard int, bucket int, node long, ids array<long>, v binary")
    probing = asking.mapInArrow(visits, "t int, shard int, mask binary, node long, v binary")
    tiles = _tiled(indexed, "tile", tile, ["node", "ids", "bucket", "v"])
    blocks = _tiled(probing, "block", block, ["node", "mask", "v"])
    # which block meets which tile is listed by name first; the contents are joined to the list, so no shard is one key
    pairs = tiles.select("t", "shard", "tile").join(blocks.select("t", "shard", "block").hint("merge"), ["t", "shard"])
    met = pairs.join(tiles.withColumnRenamed("of", "points"), ["t", "shard", "tile"]).join(blocks.withColumnRenamed("of", "queries"), ["t", "shard", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points, queries in zip(batch.column(0), batch.column(1)):
                points, queries = points.values, queries.values
                x, y = matrix(points.field("v").to_pylist(), kind, dim), matrix(queries.field("v").to_pylist(), kind, dim)
                ids = [np.array(i, dtype=np.int64) for i in points.field("ids").to_pylist()]
                mask = np.unpackbits(np.frombuffer(b"".join(queries.field("mask").to_pylist()), dtype=np.uint8).reshape(len(y), -1), axis=1)[:, :turn.axes]
                near = np.where(mask[:, points.field("bucket").to_numpy()] == 1, _scored(y, x), -np.inf)
                found = [_candidates(y[q], x, near[q], ids, more) for q in range(len(y))]
                node = np.repeat(queries.field("node").to_numpy(), [len(s) for s, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], ["node", "id", "score"])

    best = met.select("points", "queries").mapInArrow(search, "node long, id long, score double")
    # a row found in several tables has one rank, and Spark keeps these ranks before the shuffle, too
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "id"))
    best = best.withColumn("_r", rank).where(F.col("_r") <= more).distinct().groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("best"))
    lists = keep(best, "best")
    own = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return asked.join(lists, "node").select("query_id", F.posexplode(own).alias("_p", "_b")).select(
        "query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_b.id").alias("vec_id"), (-F.col("_b.far")).alias("score"))


def _tiled(rows: DataFrame, name: str, most: int, cols: list[str]) -> DataFrame:
    """t, shard, ``name``, of: the rows of each shard in parts of about ``most``.

    There are tables times axes shards, whatever the number of rows, so their sizes may be broadcast.
    """
    kept = keep(rows, name)
    sizes = kept.groupBy("t", "shard").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_n"))
    dealt = kept.join(F.broadcast(sizes), ["t", "shard"]).withColumn(name, F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    return keep(dealt.groupBy("t", "shard", name).agg(F.collect_list(F.struct(*cols)).alias("of")), f"{name}s")
