"""SimHash near-dedup: fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints are dealt into classes by the population counts of their parts.  A pair
differs in at least as many bits as its population counts do, summed over the parts, so tiles of
classes further apart than the radius never meet.  Tiles that meet are compared pair by pair with
numpy exclusive-or and bit counts.  Groups are found inside each tile first; two tiles then give one
link for every two groups that have any, never all pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_bytes
from .components import connected

#: Seed of the shingles' XXH64, as Spark's own xxhash64 has it.
SEED = 42
_BLOCK = 1 << 15


def shingle_hashes(text: bytes, words: int, lanes: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included: (shingles, lanes) of 64 bits."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty((0, lanes), dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    spans = zip(starts[:len(tokens) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64, count=len(tokens) - width + 1)
    return spread(found, lanes)


def spread(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(shingles, lanes): hashes with further bits for longer fingerprints."""
    return np.stack([hashes, *(_mixed(hashes, k) for k in range(1, lanes))], axis=1)


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further bits for longer fingerprints, by a 64-bit finalizer."""
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def fingerprint(hashes: np.ndarray) -> bytes:
    """Big-endian bytes; a bit is 1 if it is set in over half the hashes.  No hashes: zero."""
    rows, lanes = hashes.shape
    tally = np.zeros(lanes * 64, dtype=np.int64)
    for a in range(0, rows, _BLOCK):
        octets = hashes[a:a + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, lanes * 8)
        tally += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(tally * 2 > rows).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """doc_id, fp (binary), n_shingles for every document."""
    lanes = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = [], []
            for text in text_bytes(batch.column(1)):
                hashes = shingle_hashes(text, words, lanes)
                prints.append(fingerprint(hashes))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64())],
                                             ["doc_id", "fp", "n_shingles"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, fp binary, n_shingles long")


def tile_hits(x: np.ndarray, y: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of two tiles within the radius; blocks whose population counts differ by more are skipped."""
    px, py = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    lefts, rights = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for s in range(0, len(x), block):
        for t in range(0, len(y), block):
            p, q = px[s:s + block], py[t:t + block]
            if p.min() - q.max() > radius or q.min() - p.max() > radius:
                continue
            gap = np.zeros((len(p), len(q)), dtype=np.uint16)
            for k in range(x.shape[1]):
                gap += np.bitwise_count(x[s:s + block, k, None] ^ y[None, t:t + block, k])
            i, j = np.nonzero(gap <= radius)
            lefts.append(i + s)
            rights.append(j + t)
    return np.concatenate(lefts), np.concatenate(rights)


def tile_labels(x: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a tile the first one that links inside the tile lead to."""
    i, j = tile_hits(x, x, radius)
    low = np.arange(len(x))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def cross_links(x: np.ndarray, y: np.ndarray, own: np.ndarray, theirs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """One link (i, j) for every two groups, by label, of two tiles that have any."""
    i, j = tile_hits(x, y, radius)
    _, first = np.unique(own[i] * len(y) + theirs[j], return_index=True)
    return i[first], j[first]


def _matrix(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint64).reshape(-1, width)


def near_offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within the radius, one of each pair of opposite ones."""
    reach = range(-radius, radius + 1)
    return [d for d in itertools.product(reach, repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]


def links(nodes: DataFrame, bits: int, radius: int, offsets: list[tuple[int, ...]], tile: int = 1024) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``nodes`` (fp, class array<int>), enough to connect
    whatever all links within the radius connect.

    ``offsets`` says which classes may hold links; the number of classes does not grow with the data,
    so their sizes may be broadcast.  Tiles hold about ``tile`` fingerprints.  Pairs of tiles are
    listed by name first; their contents are joined to the list, tile by tile, so no class is one key.
    """
    sizes = nodes.groupBy("class").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("_n"))
    dealt = nodes.join(F.broadcast(sizes), "class").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("_n")).cast("int"))
    # sorted by population count, so that blocks inside a tile can be skipped too
    ordered = F.array_sort(F.collect_list(F.struct(_popcount("fp", bits).alias("p"), "fp")))
    packed = dealt.groupBy("class", "chunk").agg(ordered.alias("_f")).select(
        "class", "chunk", F.unhex(F.array_join(F.transform("_f", lambda s: F.hex(s["fp"])), "")).alias("packed"))
    width = bits // 64

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tile_labels(_matrix(p, width), radius).astype("<i4").tobytes() for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "labels"])

    tiles = keep(packed.mapInArrow(label, "class array<int>, chunk int, packed binary, labels binary"), "tiles")
    moves = F.array(*[F.array(*[F.lit(v) for v in d]) for d in offsets])
    there = tiles.select("class", F.col("chunk").alias("chunk_b"), F.explode(moves).alias("_d"))
    there = there.select(F.zip_with("class", "_d", lambda c, d: c + d).alias("class"), F.col("class").alias("class_b"), "chunk_b")
    own = F.col("class") == F.col("class_b")
    # the list grows with the data, which its size before the explosion does not tell: never broadcast
    pairs = tiles.select("class", "chunk").join(there.hint("merge"), "class").where(~own | (F.col("chunk") <= F.col("chunk_b")))
    far = tiles.select(F.col("class").alias("class_b"), F.col("chunk").alias("chunk_b"), F.col("packed").alias("b"), F.col("labels").alias("labels_b"))
    met = (pairs.join(tiles.withColumnsRenamed({"packed": "a", "labels": "labels_a"}), ["class", "chunk"]).join(far, ["class_b", "chunk_b"])
           .select("a", "labels_a", "b", "labels_b", (own & (F.col("chunk") == F.col("chunk_b"))).alias("same")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets = width * 8
        for batch in batches:
            lefts, rights = [], []
            for a, labels_a, b, labels_b, same in zip(*(c.to_pylist() for c in batch.columns)):
                own_ = np.frombuffer(labels_a, dtype="<i4").astype(np.int64)
                if same:  # inside a tile each is linked to the first of its group
                    i = np.flatnonzero(own_ != np.arange(len(own_)))
                    j = own_[i]
                else:
                    i, j = cross_links(_matrix(a, width), _matrix(b, width), own_, np.frombuffer(labels_b, dtype="<i4").astype(np.int64), radius)
                lefts += [a[k * octets:(k + 1) * octets] for k in i.tolist()]
                rights += [b[k * octets:(k + 1) * octets] for k in j.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], ["a", "b"])

    return met.mapInArrow(run, "a binary, b binary")


def _words(fp: str, bits: int) -> list:
    """The 16-bit parts of a fingerprint as numbers."""
    return [F.conv(F.hex(F.substring(fp, 2 * k + 1, 2)), 16, 10).cast("int") for k in range(bits // 16)]


def _popcount(fp: str, bits: int):
    return sum((F.bit_count(w) for w in _words(fp, bits)), F.lit(0))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64, radius: int = 3,
                size_ratio: float | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Words are the runs of other bytes than space and 9 to 13, after lower-casing A-Z; fewer words than a shingle
    has give one shingle, none the fingerprint zero, which links like any other.  Fingerprints link
    at ``radius`` or fewer differing bits; ``component_id`` is the smallest id reachable.  Equal
    fingerprints are folded before they meet.  With ``size_ratio`` (similarity joins) only texts
    whose numbers of shingles stand in at least this ratio are sure to meet, for less similar sizes
    rule out the similarity; without it every fingerprint meets every other that its population counts allow.
    Null texts count as empty; other columns are ignored; an empty table gives an empty result.  Ids are unique and not null.
    """
    prints = keep(fingerprints(docs, id_col, text_col, words, bits), "prints")
    if size_ratio is None:
        parts = _words("fp", bits)
        each = len(parts) // 4
        group = F.array(*[sum((F.bit_count(w) for w in parts[k * each:(k + 1) * each]), F.lit(0)).cast("int") for k in range(4)])
        offsets = near_offsets(4, radius)
    else:
        step = -np.log(size_ratio)
        group = F.array(F.floor(F.log(F.greatest(F.col("n_shingles"), F.lit(1))) / F.lit(float(step))).cast("int"))
        offsets = [(0,), (1,)]
    folded = keep(prints.groupBy("fp", group.alias("class")).agg(F.min("doc_id").alias("first")), "folded")
    found = links(folded.select("fp", "class"), bits, radius, offsets)
    reach = connected(found)
    firsts = folded.groupBy("fp").agg(F.min("first").alias("first"))
    named = keep(firsts.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first"), "named")
    roots = keep(named.groupBy("component").agg(F.min("first").alias("component_id")), "groups")
    # plain scans on both sides: a component, or a fingerprint, that a third of all rows have can be split
    table = keep(named.join(roots, "component").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return prints.join(table, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
