"""Fuzzy text join: bounds on the ratio rule pairs out, the exact ratio decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


class Rails:
    """Texts laid side by side as the bits of one number, a free bit behind each, so that a longest common subsequence with all of them comes
    from one walk over the other text.

    Matching blocks stand in the same order in both texts, so they are never longer together than such a subsequence.
    """

    def __init__(self, texts: Sequence[str]):
        self.sizes = [len(t) for t in texts]
        self.widths = [n // 8 + 1 for n in self.sizes]  # whole bytes; a carry out of a text ends in a free bit
        self.blank = [bytes(w) for w in self.widths]
        self.full = [((1 << n) - 1).to_bytes(w, "little") for n, w in zip(self.sizes, self.widths)]
        self.places: list[dict[str, bytes]] = []
        for text, width in zip(texts, self.widths):
            places: dict[str, int] = {}
            for i, c in enumerate(text):
                places[c] = places.get(c, 0) | 1 << i
            self.places.append({c: bits.to_bytes(width, "little") for c, bits in places.items()})

    def common(self, text: str, chosen: Sequence[int]) -> list[int]:
        """Length of a longest common subsequence of ``text`` and each of the chosen texts."""
        tables = [(self.places[j], self.blank[j]) for j in chosen]
        places = {c: int.from_bytes(b"".join([t.get(c, none) for t, none in tables]), "little") for c in set(text)}
        row = full = int.from_bytes(b"".join([self.full[j] for j in chosen]), "little")
        for bits in map(places.__getitem__, text):
            hit = row & bits
            row = (row + hit | row ^ hit) & full
        left, at, out = row.to_bytes(sum(self.widths[j] for j in chosen), "little"), 0, []
        for j in chosen:
            out.append(self.sizes[j] - int.from_bytes(left[at:at + self.widths[j]], "little").bit_count())
            at += self.widths[j]
        return out


def common_length(a: str, b: str) -> int:
    """Length of a longest common subsequence."""
    return Rails([a]).common(b, [0])[0]


def _tally(texts: Sequence[Sequence[str]], letters: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(letters)), dtype=np.int32)
    for i, t in enumerate(texts):
        for c, n in Counter(t).items():
            if c in letters:
                out[i, letters[c]] = n
    return out


def _twos(text: str) -> list[str]:
    return list(map("".join, zip(text, text[1:])))


LONG = 200  # from this length of the second text on, SequenceMatcher begins no block at a character of over 1 % + 1 of its places


def close_pairs(left: list[str], right: list[str], threshold: float) -> Iterator[tuple[str, str, float]]:
    """Pairs of two lists with ratio at or above the threshold.

    Each bound is never below the ratio: lengths, then common characters, then neighbours (long texts), then the longest common subsequence.
    Of a long text every matching block, but for one at the start of both, holds a rare character, so blocks are few and most of their
    characters stand beside each other in both texts.
    """
    letters = {c: i for i, c in enumerate(sorted(set("".join(right))))}
    # by length, so that the texts within the reach of another are one slice
    right = sorted(right, key=len)
    theirs, sizes, rails = _tally(right, letters), np.array([len(t) for t in right]), Rails(right)
    first = int(np.searchsorted(sizes, LONG))
    beside = [_twos(t) for t in right[first:]]
    twos = {g: i for i, g in enumerate(sorted(set().union(*beside)))}
    pairs, rare = _tally(beside, twos), np.where(theirs <= sizes[:, None] // 100 + 1, theirs, 0)[first:]
    for x, own in zip(left, _tally(left, letters)):
        least = threshold * (len(x) + sizes) / 2 - 1e-9
        fits = np.flatnonzero(np.minimum(len(x), sizes) >= least)
        if len(fits) == 0:
            continue
        near = slice(fits[0], fits[-1] + 1)
        chosen = np.flatnonzero(np.minimum(theirs[near], own).sum(axis=1) >= least[near]) + fits[0]
        long = chosen[chosen >= first]
        if len(long):
            blocks = 1 + np.minimum(rare[long - first], own).sum(axis=1)
            shared = np.minimum(pairs[long - first], _tally([_twos(x)], twos)).sum(axis=1)
            chosen = np.concatenate([chosen[chosen < first], long[shared >= least[long] - blocks]])
        chosen = chosen.tolist()
        if chosen:
            for j, length in zip(chosen, rails.common(x, chosen)):
                if length >= least[j]:
                    ratio = SequenceMatcher(None, x, right[j]).ratio()
                    if ratio >= threshold:
                        yield x, right[j], ratio


def _tiles(texts: DataFrame, name: str, spread: float, tile: int) -> DataFrame:
    """Distinct texts in tiles of about ``tile``, by length: band (lengths within the reach of each other lie at most one
    band apart), chunk, list.  The number of bands grows with the logarithm of the longest text only, so their sizes may be broadcast."""
    rows = cut_lineage(texts.select("text").where(F.length("text") > 0).distinct().withColumn("band", F.floor(F.log(F.length("text")) / F.log(F.lit(spread))).cast("int")))
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / tile).alias("_n"))
    return (rows.join(F.broadcast(sizes), "band").withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("_n")))
            .groupBy("band", "chunk").agg(F.collect_list("text").alias(name)))


def similar_texts(a: DataFrame, b: DataFrame, threshold: float, tile: int = 256) -> DataFrame:
    """Pairs of *distinct* texts with ratio at or above the threshold: text_a, text_b, ratio.  No such pair is missed.

    Copies are folded first: a text held by a third of all rows is compared once.  Texts of lengths that rule the ratio out do not
    meet; the others meet tile by tile, so the work is the product of the distinct texts of a length.
    """
    spread = (2.0 - threshold) / threshold
    # what a task makes of a right tile serves four times as many left texts
    left, right = cut_lineage(_tiles(a, "left", spread, 4 * tile)), cut_lineage(_tiles(b, "right", spread, tile))
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    there = right.select(F.col("band").alias("band_b"), F.col("chunk").alias("chunk_b"), near.alias("_d")).withColumn("band", F.col("band_b") + F.col("_d")).drop("_d")
    pairs = left.select("band", "chunk").join(there, "band")  # names of tiles only
    held = right.select(F.col("band").alias("band_b"), F.col("chunk").alias("chunk_b"), "right")
    met = pairs.join(left, ["band", "chunk"]).join(held, ["band_b", "chunk_b"]).select("left", "right")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y in zip(batch["left"], batch["right"]):
                yield pd.DataFrame(list(close_pairs(list(x), list(y), threshold)), columns=["text_a", "text_b", "ratio"])

    spread_to = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(spread_to).mapInPandas(compare, "text_a string, text_b string, ratio double")


def similar_join(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Rows of two lists (id, ref, text) that mean the same: equal reference, else similar text.

    Two rows that both name a reference match only when the references are equal.
    """
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    left = a.select(F.col("id").alias("id_a"), F.col("ref").alias("ref_a"), F.col("text").alias("text_a"))
    right = b.select(F.col("id").alias("id_b"), F.col("ref").alias("ref_b"), F.col("text").alias("text_b"))
    by_ref = (left.where(has("ref_a")).join(right.where(has("ref_b")), F.col("ref_a") == F.col("ref_b"))
              .select("id_a", "id_b", F.lit(1.0).alias("score"), F.lit(True).alias("ref_exact")))
    pairs = similar_texts(a, b, threshold)
    by_text = (left.join(pairs, "text_a").join(right, "text_b").where(~(has("ref_a") & has("ref_b")))
               .select("id_a", "id_b", F.col("ratio").alias("score"), F.lit(False).alias("ref_exact")))
    return by_ref.unionByName(by_text)
