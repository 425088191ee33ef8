"""Exact dedup by content-defined chunk recipes.

A text is normalised, cut where its own bytes say so, and described by the ordered list of its
chunks' identifiers.  Chunks go to a table in the shared folder; each distinct chunk is moved once
to verify that its identifier stands for one content only.  Texts are then compared by their short
recipes, so a long document is not moved again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, keep, row_runs

#: Bytes that normalising deletes: space and the control characters 9 to 13.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_WINDOW = 32
_STORE = ("doc_id long, pos int, chunk_key long, chunk binary, recipe array<bigint>, "
          "text_sha256 string, n_points long")


def _gear() -> np.ndarray:
    """A random 32-bit number for each byte value, from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)


def rolling(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at each place, by doubling the window five times."""
    h = gear[data]
    step = 1
    while step < _WINDOW:
        ahead = h.copy()
        ahead[step:] += h[:-step] << np.uint32(step) if len(h) > step else 0
        h, step = ahead, step * 2
    return h


def cuts(places: np.ndarray, size: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text: the first wanted place ``least`` bytes on, after ``most`` bytes at the latest."""
    ends, at = [], 0
    while size - at > least:
        k = int(np.searchsorted(places, at + least))
        end = int(places[k]) if k < len(places) else size
        end = min(end, at + most, size)
        ends.append(end)
        at = end
    if at < size or not ends:
        ends.append(size)
    return ends


def _key(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) - (1 << 63)


def chunk_store(docs: DataFrame, id_col: str, text_col: str, average: int, least: int, most: int,
                key: Callable[[bytes], int] = _key) -> DataFrame:
    """One row per chunk; the row of a text's first chunk also carries its recipe, digest and length."""
    if least < _WINDOW:
        raise ValueError(f"chunks need {_WINDOW} bytes at least: the hash must not look past the start of a text")
    mask = np.uint32((1 << (average.bit_length() - 1)) - 1) << np.uint32(8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, kept = _gear(), np.ones(256, dtype=bool)
        kept[list(BLANKS)] = False
        for batch in batches:
            ids = batch.column(0).to_pylist()
            offsets, data = byte_view(batch.column(1))
            for a, b in row_runs(offsets):
                raw = data[offsets[a]:offsets[b]]
                edge = offsets[a:b + 1] - offsets[a]
                stay = kept[raw]
                body = raw[stay]
                edges = np.concatenate([[0], np.cumsum(stay)])[edge]
                points = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[edge])
                wanted = np.flatnonzero((rolling(body, gear) & mask) == 0) + 1
                whole = body.tobytes()
                rows: dict[str, list] = {n: [] for n in ("doc", "pos", "key", "chunk", "recipe", "sha", "points")}
                for i in range(b - a):
                    s, e = int(edges[i]), int(edges[i + 1])
                    lo, hi = np.searchsorted(wanted, (s, e + 1))
                    ends = cuts(wanted[lo:hi] - s, e - s, least, most)
                    parts = [whole[s + x:s + y] for x, y in zip([0, *ends[:-1]], ends)]
                    keys = [key(p) for p in parts]
                    rows["doc"] += [ids[a + i]] * len(parts)
                    rows["pos"] += range(len(parts))
                    rows["key"] += keys
                    rows["chunk"] += parts
                    rest = [None] * (len(parts) - 1)
                    rows["recipe"] += [keys, *rest]
                    rows["sha"] += [hashlib.sha256(whole[s:e]).hexdigest(), *rest]
                    rows["points"] += [int(points[i]), *rest]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["doc"], pa.int64()), pa.array(rows["pos"], pa.int32()), pa.array(rows["key"], pa.int64()),
                     pa.array(rows["chunk"], pa.binary()), pa.array(rows["recipe"], pa.list_(pa.int64())),
                     pa.array(rows["sha"], pa.string()), pa.array(rows["points"], pa.int64())],
                    ["doc_id", "pos", "chunk_key", "chunk", "recipe", "text_sha256", "n_points"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _STORE)


def _told_apart(store: DataFrame) -> DataFrame | None:
    """For chunk keys that stand for several contents: (doc_id, marks) that tell these apart; None if there are none.

    Equal chunks fold before and after the shuffle, so each distinct chunk is moved about once.
    """
    shared = keep(store.select("chunk_key", "chunk").distinct().groupBy("chunk_key").count().where("count > 1").select("chunk_key"), "clash")
    if shared.isEmpty():
        return None
    hit = store.join(shared, "chunk_key", "left_semi").select("doc_id", "pos", "chunk_key", "chunk")
    # here, and only here, the content itself takes part in the comparison
    return hit.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("marks"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", average: int = 2048, least: int = 512,
                 most: int = 16384, key: Callable[[bytes], int] = _key) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points.

    Texts are equal when they are the same after deleting blanks (``BLANKS``).  Of equal texts the
    one with the most code points before that, then the smallest id, stays.  Null counts as empty;
    all empty texts are one group.  Other columns are ignored whatever their names.  Ids are unique
    and not null.  An empty table gives an empty result.
    """
    store = keep(chunk_store(docs, id_col, text_col, average, least, most, key), "chunks")
    recipes = store.where("pos = 0").select("doc_id", "recipe", "text_sha256", "n_points")
    marks = _told_apart(store)
    if marks is not None:
        recipes = recipes.join(marks, "doc_id", "left")
    keys = [c for c in ("recipe", "marks") if c in recipes.columns]
    several = (recipes.groupBy(*keys).agg(F.max(F.struct("n_points", (-F.col("doc_id")).alias("_turn"))).alias("_best"), F.count("*").alias("group_size"))
               .where("group_size > 1").select(*keys, (-F.col("_best._turn")).alias("keep_id"), "group_size"))
    groups = keep(several, "groups").select(*[F.col(k).alias(f"_{k}") for k in keys], "keep_id", "group_size")
    same = F.col("recipe") == F.col("_recipe")
    if marks is not None:
        same = same & F.col("marks").eqNullSafe(F.col("_marks"))
    # both sides are plain scans, so that AQE can split a group that holds a third of all rows
    return recipes.join(groups, same, "left").select(
        "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_id", "doc_id") == F.col("doc_id")).alias("kept"), "text_sha256", "n_points")
