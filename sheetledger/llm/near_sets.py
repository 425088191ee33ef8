"""Near copies by the exact similarity of their shingle sets, with SimHash fingerprints to find candidates.

Texts of equal sets fold into one node.  Nodes whose fingerprints lie within the radius are candidates, found tile by tile
as in ``simhash``; a spanning forest of them tells which nodes can be in one group at all.  Within such a neighbourhood nodes and their
shingle sets lie in tiles again, and the Jaccard similarity of two sets decides inside the task: groups grow as links are verified, so pairs of one
group are not compared any more, and what leaves a task is one link for every two groups that have a verified one, never a pair that was compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, text_bytes
from .components import connected
from .simhash import cross_links, fingerprint, shingle_hashes, spread, tile_hits, tile_labels


def _set_of(text: bytes, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words, 1)[:, 0])


def _nodes(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """doc_id, key (of the set), fp, size for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, sizes = [], [], []
            for text in text_bytes(batch.column(1)):
                own = _set_of(text, words)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(fingerprint(spread(own, bits // 64)))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())],
                                             ["doc_id", "key", "fp", "size"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, key binary, fp binary, size long")


def candidates(nodes: DataFrame, bits: int, radius: int, tile: int = 1024) -> DataFrame:
    """(a, b): pairs of nodes (id, fp, class) within the radius, enough to connect what all such pairs would.

    Those inside a tile lead to the first of their group.  Only nodes of one class or of neighbouring ones meet.
    """
    sizes = nodes.groupBy("class").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("_n"))
    width = bits // 64
    dealt = nodes.join(F.broadcast(sizes), "class").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    packed = dealt.groupBy("class", "chunk").agg(F.collect_list(F.struct("fp", "id")).alias("_f"))

    def matrix(fps: bytes) -> np.ndarray:
        return np.frombuffer(fps, dtype=np.uint64).reshape(-1, width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids, firsts = [], [], []
            for rows in batch.column(2).to_pylist():
                x = matrix(b"".join(r["fp"] for r in rows))
                order = np.argsort(np.bitwise_count(x).sum(axis=1, dtype=np.int64), kind="stable")  # so that blocks inside a tile can be skipped
                x = x[order]
                fps.append(x.tobytes())
                ids.append(np.array([r["id"] for r in rows], dtype=np.int64)[order].tobytes())
                firsts.append(tile_labels(x, radius).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in (fps, ids, firsts))],
                                             ["class", "chunk", "fps", "ids", "firsts"])

    tiles = keep(packed.mapInArrow(pack, "class int, chunk int, fps binary, ids binary, firsts binary"), "tiles")
    there = tiles.select(F.col("class").alias("class_b"), F.col("chunk").alias("chunk_b")).withColumn("class", F.explode(F.array(F.col("class_b"), F.col("class_b") - 1)))
    own = F.col("class") == F.col("class_b")
    # the list grows with the data, which its size before the explosion does not tell: never broadcast
    pairs = tiles.select("class", "chunk").join(there.hint("merge"), "class").where(~own | (F.col("chunk") <= F.col("chunk_b")))
    names = ["fps", "ids", "firsts"]
    near = tiles.withColumnsRenamed({c: f"{c}_a" for c in names})
    far = tiles.withColumnsRenamed({c: f"{c}_b" for c in ["class", "chunk", *names]})
    met = pairs.join(near, ["class", "chunk"]).join(far, ["class_b", "chunk_b"]).select(
        *[f"{c}_a" for c in names], *[f"{c}_b" for c in names], (own & (F.col("chunk") == F.col("chunk_b"))).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *blobs, same in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = matrix(blobs[0]), matrix(blobs[3])
                ids_a, firsts_a, ids_b, firsts_b = (np.frombuffer(b, dtype=np.int64) for b in (*blobs[1:3], *blobs[4:]))
                if same:
                    i = np.flatnonzero(firsts_a != np.arange(len(x)))
                    j = firsts_a[i]
                else:
                    i, j = cross_links(x, y, firsts_a, firsts_b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(ids_a[i]), pa.array(ids_b[j])], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


class Tile:
    """Nodes of one neighbourhood: ids, fingerprints, sorted shingle sets, and the first node of each one's group."""

    def __init__(self, ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], groups: np.ndarray | None = None):
        self.ids, self.fps, self.sets = ids, fps, sets
        self.groups = np.arange(len(ids)) if groups is None else groups

    @classmethod
    def of(cls, rows: pa.StructArray, width: int, groups: bytes | None = None) -> Tile:
        fps = np.frombuffer(b"".join(rows.field("fp").to_pylist()), dtype=np.uint64).reshape(-1, width)
        sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.field("hashes")]
        return cls(rows.field("id").to_numpy(), fps, sets, None if groups is None else np.frombuffer(groups, dtype="<i4").astype(np.int64))


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    small, large = sorted((len(x), len(y)))
    if small < least * large - 1e-9:
        return False
    if not large:
        return True
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0
    return common >= least * (len(x) + len(y) - common) - 1e-9


def united(a: Tile, b: Tile, radius: int, least: float) -> list[tuple[int, int]]:
    """Verified links (place in a, place in b) that join groups, nearest fingerprints first; ``a`` and ``b`` may be one tile.

    Pairs whose groups have been joined meanwhile are not compared.
    """
    i, j = tile_hits(a.fps, b.fps, radius)
    if a is b:
        i, j = i[i < j], j[i < j]
    order = np.argsort(np.bitwise_count(a.fps[i] ^ b.fps[j]).sum(axis=1, dtype=np.int64), kind="stable")
    root = list(range(len(a.ids))) + [len(a.ids) + k for k in range(len(b.ids))]

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    shift = 0 if a is b else len(a.ids)
    left, right = a.groups[i[order]].tolist(), (b.groups[j[order]] + shift).tolist()
    out = []
    for p, q, u, v in zip(left, right, i[order].tolist(), j[order].tolist()):
        p, q = find(p), find(q)
        if p != q and similar(a.sets[u], b.sets[v], least):
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    if a is b:
        a.groups = np.array([find(k) for k in range(len(a.ids))], dtype=np.int64)
    return out


def verified(near: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, radius: int, least: float, tile: int = 256, room: int = 1 << 19) -> DataFrame:
    """(a, b): verified links of nodes ``near`` (id, fp, size, part), enough to join whatever all links within the radius join in each part.

    A tile holds about ``tile`` nodes or ``room`` bytes of shingle hashes; parts larger than that lie in several tiles, which meet pair by pair.
    """
    width = bits // 64

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_set_of(t, words).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], ["id", "hashes"])

    chunks = near.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / F.lit(tile), F.sum("size") * 8 / F.lit(room))).cast("int").alias("_n")).where("_n > 1")
    dealt = near.join(chunks, "part", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_n")), F.lit(0)).cast("int")).select("id", "fp", "part", "chunk")
    dealt = keep(dealt, "dealt")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = texts.join(dealt.select("id"), "id", "left_semi").mapInArrow(sets, "id long, hashes binary")
    packed = held.join(dealt, "id").groupBy("part", "chunk").agg(F.collect_list(F.struct("id", "fp", "hashes")).alias("of"))
    form = "part long, chunk int, of array<struct<id: long, fp: binary, hashes: binary>>, groups binary, a array<long>, b array<long>"

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, left, right = [], [], []
            for rows in batch.column(2):
                own = Tile.of(rows.values, width)
                found = united(own, own, radius, least)
                groups.append(own.groups.astype("<i4").tobytes())
                left.append([int(own.ids[u]) for u, _ in found])
                right.append([int(own.ids[v]) for _, v in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.binary()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                                             ["part", "chunk", "of", "groups", "a", "b"])

    tiles = keep(packed.mapInArrow(inside, form), "tiles")
    own = tiles.select(F.explode(F.arrays_zip("a", "b")).alias("_l")).select("_l.a", "_l.b")
    # only parts of several tiles; which tiles meet is listed by name first, so no part is one key
    many = tiles.select("part", "chunk").join(chunks.select("part"), "part", "left_semi")
    pairs = many.join(many.withColumnRenamed("chunk", "chunk_b").hint("merge"), "part").where("chunk < chunk_b")
    met = (pairs.join(tiles.select("part", "chunk", "of", "groups"), ["part", "chunk"])
           .join(tiles.select("part", F.col("chunk").alias("chunk_b"), F.col("of").alias("of_b"), F.col("groups").alias("groups_b")), ["part", "chunk_b"]))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of_a, groups_a, of_b, groups_b in zip(*batch.columns):
                a, b = Tile.of(of_a.values, width, groups_a.as_py()), Tile.of(of_b.values, width, groups_b.as_py())
                found = united(a, b, radius, least)
                yield pa.RecordBatch.from_arrays([pa.array([int(a.ids[u]) for u, _ in found], pa.int64()), pa.array([int(b.ids[v]) for _, v in found], pa.int64())], ["a", "b"])

    links = keep(own.unionByName(met.select("of", "groups", "of_b", "groups_b").mapInArrow(across, "a long, b long")), "links")
    forget(dealt, tiles)
    return links


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 256, radius: int = 72, least: float = 0.8) -> DataFrame:
    """doc_id, component_id: the smallest id reachable by links of texts whose shingle sets have a Jaccard similarity of ``least`` or more.

    Every link is decided by the sets, so none is wrong; one is missed only if the fingerprints of a similar pair differ in
    more than ``radius`` bits.  Repeats of a shingle count once, in fingerprints and sizes too.  Fewer words than a shingle has
    give one shingle; texts without words are copies of each other.  Null counts as empty; ids are unique and not null.  Other columns are ignored;
    an empty table gives an empty result.
    """
    prints = keep(_nodes(docs, id_col, text_col, words, bits), "prints")
    step = float(-np.log(least))
    cls = F.floor(F.log(F.greatest(F.col("size"), F.lit(1))) / F.lit(step)).cast("int")
    nodes = keep(prints.groupBy("key", "fp", "size", cls.alias("class")).agg(F.min("doc_id").alias("id")), "nodes")
    pairs = keep(candidates(nodes.select("id", "fp", "class"), bits, radius), "pairs")
    parts = connected(pairs).select(F.col("node").alias("id"), F.col("component").alias("part"))
    near = keep(nodes.select("id", "fp", "size").join(parts, "id"), "near")
    links = verified(near, docs, id_col, text_col, words, bits, radius, least)
    found = connected(links).select(F.col("node").alias("id"), "component")
    named = keep(nodes.join(found, "id", "left").select(F.col("key").alias("_key"), F.coalesce("component", "id").alias("component_id")), "classes")
    forget(nodes, pairs, near, links)
    return prints.join(named, F.col("key") == F.col("_key")).select("doc_id", "component_id")
