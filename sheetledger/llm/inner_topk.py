"""Exact top-k by inner product over vectors sorted by length.

Vectors are whole numbers, packed in tiles by descending length.  A block of queries meets the tiles in that
order and keeps its k best so far.  By Cauchy-Schwarz no vector can score more than the
product of lengths, so a query is done with a tile, and with all later ones, once its k-th score is
higher than that.  Inside a tile, scores are summed over the directions of an SVD, strongest first;
after a few of them the rest is bounded by the product of the residual lengths, and only
the vectors that can still reach the k-th score are scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

_SLACK = 1e-6  # relative; what doubles may be off in a bound


#: Components beyond this, after scaling, are an error: their scores need not fit 64 bits.
_MOST = float(1 << 62)
_NONE = np.iinfo(np.int64).min


def quantized(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double, as long; null for vectors null, or with null or non-finite components."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(wide, lambda x: F.when(F.abs(x * F.lit(float(scale))) < _MOST, F.floor(x * F.lit(float(scale)))).otherwise(
        F.raise_error(F.lit("a component is too large for whole-number scores")).cast("long")))
    return F.when(sound, whole)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in doubles or 64 bits where they surely fit, else number by number."""
    most = len(query) * float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0))
    if most < 1 << 52:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return rows @ query
    found = rows.astype(object) @ query.astype(object)
    if any(abs(s) >= 1 << 63 for s in found):
        raise ValueError("a score does not fit 64 bits")
    return found.astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products: dim x dim numbers, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0), dim).astype(np.float64)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(total.ravel())], ["cell", "part"])

    cells = vectors.select("ints").mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("v")).collect()
    out = np.zeros(dim * dim)
    for r in cells:
        out[r["cell"]] = r["v"]
    return out.reshape(dim, dim)


class _Block:
    """Queries of one block with their k best (score, id) so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, basis: np.ndarray, k: int, lead: int):
        self.ids, self.rows, self.k, self.lead = ids, rows, k, lead
        wide = rows.astype(np.float64)
        self.turned = wide @ basis
        self.length = np.sqrt((wide ** 2).sum(axis=1))
        self.rest = np.sqrt((self.turned[:, lead:] ** 2).sum(axis=1))
        self.score = np.full((len(ids), k), _NONE)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, ids: np.ndarray, rows: np.ndarray, basis: np.ndarray) -> None:
        floor = np.where(self.score[:, -1] == _NONE, -np.inf, self.score[:, -1].astype(np.float64))
        wide = rows.astype(np.float64)
        length = np.sqrt((wide ** 2).sum(axis=1))
        reach = self.length * length.max() * (1 + _SLACK) + _SLACK
        live = np.flatnonzero(reach >= floor)
        if not len(live):
            return
        turned = wide @ basis[:, :self.lead]
        rest = np.sqrt(np.maximum(length ** 2 - (turned ** 2).sum(axis=1), 0))
        bound = self.turned[live, :self.lead] @ turned.T + self.rest[live, None] * rest[None, :]
        open_ = bound + _SLACK * (1 + self.length[live, None] * length[None, :]) >= floor[live, None]
        for i, q in enumerate(live.tolist()):
            at = np.flatnonzero(open_[i] & (ids != self.ids[q]))
            if not len(at):
                continue
            score = exact_scores(rows[at], self.rows[q])
            if len(at) > 4 * self.k:  # only ties with the k-th best of these can matter beyond it
                low = np.partition(score, len(score) - self.k)[len(score) - self.k]
                at, score = at[score >= low], score[score >= low]
            score, vec = np.concatenate([self.score[q], score]), np.concatenate([self.vec[q], ids[at]])
            order = np.lexsort((vec, ~score))[:self.k]
            self.score[q], self.vec[q] = score[order], vec[order]

    def rows_out(self) -> list[np.ndarray]:
        q, j = np.nonzero(self.score != _NONE)
        return [self.ids[q], self.vec[q, j], self.score[q, j]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding",
          block: int = 512, tile: int = 2048, lanes: int = 4, lead: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query with all rows but its own.

    Scores are of ``floor(scale * component)``, whole numbers, so they are exact; ties go to the smaller id.
    Vectors that are null or empty, or hold null or non-finite components, take no part; vectors of several lengths, components of 2^62 and more after scaling and
    scores beyond 64 bits are errors.  Fewer than k other rows: all of them.  Rows repeated under other ids
    count each.  Other columns are ignored; no queries or an empty table give an empty result.

    Every block of queries has to meet every tile, so blocks and tiles are spread over keys of their
    own; a task holds one block and one tile.
    """
    spark = vectors.sparkSession
    ints = quantized(F.col(vec_col), scale)
    rows = keep(vectors.select(F.col(id_col).cast("long").alias("id"), ints.alias("ints"), is_query.alias("asks")).where("ints is not null and size(ints) > 0"), "vectors")
    head = rows.agg(F.min(F.size("ints")).alias("dim"), F.max(F.size("ints")).alias("most"), F.max(F.array_max(F.transform("ints", lambda x: F.abs(x)))).alias("largest"), F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    out = "query_id long, vec_id long, score long"
    if not head["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = head["dim"]
    if dim != head["most"]:
        raise ValueError("vectors of several lengths have no inner product")
    kind = "<i4" if head["largest"] < 1 << 31 else "<i8"  # bytes of a number on the way
    energy, basis = np.linalg.eigh(_gram(rows, dim))
    basis = np.ascontiguousarray(basis[:, np.argsort(-energy)])
    lead_ = min(lead, dim)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows as tiles: the greatest length first, as they come sorted."""
        for batch in batches:
            for a in range(0, len(batch), tile):
                part = batch.slice(a, tile)
                if len(part):
                    x = _matrix(part.column(1), dim)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([float((x.astype(np.float64) ** 2).sum(axis=1).max())]), pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                         pa.array([x.astype(kind).tobytes()], pa.binary())], ["longest", "ids", "ints"])

    form = "longest double, ids binary, ints binary"
    norm = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n_tiles = max(1, -(-head["n"] // tile))
    ranged = rows.select("id", "ints", norm.alias("_n")).repartitionByRange(n_tiles, F.col("_n").desc(), "id").sortWithinPartitions(F.col("_n").desc(), "id")
    tiles = keep(ranged.select("id", "ints").mapInArrow(packed, form), "tiles")
    n_blocks = max(1, -(-head["q"] // block))
    asking = rows.where("asks").select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("blk"), "id", "ints")
    # a query set in blocks against all rows: each block is sent to each lane, each tile to each block
    queries = asking.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(
        "blk", "lane", F.lit(float("inf")).alias("longest"), "id", "ints", F.lit(None).cast("binary").alias("ids_b"), F.lit(None).cast("binary").alias("ints_b"))
    visits = tiles.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        "blk", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), "longest", F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("array<bigint>").alias("ints"), F.col("ids").alias("ids_b"), F.col("ints").alias("ints_b"))
    placed = queries.unionByName(visits).repartition(n_blocks * lanes, "blk", "lane").sortWithinPartitions("blk", "lane", F.col("longest").desc(), "id")
    shared = spark.sparkContext.broadcast(basis)  # dim x dim

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, now, block_, asked = shared.value, None, None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if block_ is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in block_.rows_out()], ["query_id", "vec_id", "score"])

        for batch in batches:
            for blk, lane, _, id_, ints_, ids_b, ints_b in zip(*(c.to_pylist() for c in batch.columns)):
                if (blk, lane) != now:
                    yield from done()
                    now, block_, asked = (blk, lane), None, ([], [])
                if ids_b is None:
                    asked[0].append(id_)
                    asked[1].append(ints_)
                    continue
                if block_ is None:
                    block_ = _Block(np.array(asked[0]), np.array(asked[1], dtype=np.int64), turn, k, lead_) if asked[0] else None
                if block_ is not None:
                    block_.meet(np.frombuffer(ids_b, dtype=np.int64), np.frombuffer(ints_b, dtype=kind).astype(np.int64).reshape(-1, dim), turn)
        yield from done()

    best = placed.mapInArrow(search, out)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
