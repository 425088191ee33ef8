"""Quality classifier by supervised subword embeddings.

A text's features are its words and the character n-grams around each word, hashed into buckets, and a
mark for each word that repeats the one before.  Every bucket has a learned vector; a text is the
average of its features' vectors, and a softmax over two classes gives the score.  Vectors and
output weights are trained by stochastic gradient descent in numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, filtered, row_runs

GRAMS = (3, 4)
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass
class Embeddings:
    """Frozen model: bucket vectors (buckets, dim), output weights (dim, 2) and bias (2)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """Each bucket's part in the difference of the two outputs: averaging and the output layer are linear."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    h = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets - 1)).astype(np.int64)


def features(data: np.ndarray, edges: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of the texts between the edges, in no order.

    The last bucket is the mark of a repeated word.  Characters are code points; words are runs of
    others than blanks (space and below).
    """
    body = np.full(len(data) + len(edges), 0x0A, dtype=np.uint8)  # each text ends with a blank, and one stands before
    places = np.arange(len(data)) + np.repeat(np.arange(1, len(edges)), np.diff(edges))
    body[places] = data
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    # the texts' ends among the code points
    lead = (body & 0xC0) != 0x80
    ends = np.cumsum(lead)[edges + np.arange(len(edges))] - 1
    text = np.repeat(np.arange(len(edges)), np.diff(np.concatenate([[-1], ends]))) - 1
    blank = points <= 0x20
    size = len(points)
    owners, buckets_of = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if size < n:
                continue
            inner = ~blank[1:size - n + 2]
            for k in range(2, n - 1):
                inner = inner & ~blank[k:size - n + 1 + k]
            at = np.flatnonzero(inner)
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = h * _BASE + points[at + k]
            owners.append(text[at + 1])
            buckets_of.append(_bucket(h, buckets))
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        stops = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        powers = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((points + np.uint64(1)) * powers, dtype=np.uint64)])
        back = np.cumprod(np.full(size, _BACK, dtype=np.uint64))
        words = (total[stops] - total[starts]) * back[starts]
    owners.append(text[starts])
    buckets_of.append(_bucket(words, buckets))
    same = np.flatnonzero((words[1:] == words[:-1]) & (text[starts[1:]] == text[starts[:-1]])) + 1
    owners.append(text[starts[same]])
    buckets_of.append(np.full(len(same), buckets - 1, dtype=np.int64))
    return np.concatenate(owners), np.concatenate(buckets_of)


def bags(docs: DataFrame, text_col: str, label_col: str, buckets: int) -> DataFrame:
    """label, buckets, shares: the distinct features of each text and their share of all its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_view(batch.column(1))
            found, shares = [], []
            for i in range(len(batch)):
                body = data[offsets[i]:offsets[i + 1]]
                _, b = features(body, np.array([0, len(body)]), buckets)
                ids, n = np.unique(b, return_counts=True)
                found.append(ids.astype(np.int32))
                shares.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                                             ["label", "buckets", "shares"])

    return docs.select(F.col(label_col).cast("int"), F.col(text_col).cast("string")).mapInArrow(run, "label int, buckets array<int>, shares array<float>")


def descend(labels: np.ndarray, found: list[np.ndarray], shares: list[np.ndarray], buckets: int, dim: int, epochs: int, rate: float, seed: int) -> Embeddings:
    """Stochastic gradient descent, one text a step, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            pace = np.float32(rate * (1 - done / steps))
            done += 1
            hidden = shares[i] @ vectors[found[i]]
            out = hidden @ weights + bias
            p = np.exp(out - out.max())
            slope = p / p.sum()
            slope[labels[i]] -= 1
            pull = weights @ slope
            weights -= pace * np.outer(hidden, slope)
            bias -= pace * slope
            vectors[found[i]] -= pace * shares[i][:, None] * pull
    return Embeddings(vectors, weights, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 4000,
          buckets: int = 1 << 16, dim: int = 16, epochs: int = 8, rate: float = 2.0, seed: int = 11) -> Embeddings:
    """Model from about ``rows`` labelled texts (all, if fewer), chosen by a hash of the id.

    Labels other than 0 and 1, null labels and rows without a text are not learned from.  The driver
    gets the sample's features, bounded by ``rows``.  Nothing to learn from gives scores of one half.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"))
    total = known.count()
    place = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.where(place < F.lit(min(1.0, rows / max(1, total))))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    chosen_bags = bags(texts.join(F.broadcast(chosen), "_id").orderBy("_id"), "_text", "_label", buckets)  # about ``rows`` rows on either side
    got = chosen_bags.toArrow().combine_chunks()
    if not got.num_rows:
        return Embeddings(np.zeros((buckets, dim), np.float32), np.zeros((dim, 2), np.float32), np.zeros(2, np.float32))
    label, found, shares = (got.column(i).combine_chunks() for i in range(3))
    edges = found.offsets.to_numpy()[1:-1]
    return descend(label.to_numpy(), np.split(found.flatten().to_numpy(), edges), np.split(shares.flatten().to_numpy(), edges), buckets, dim, epochs, rate, seed)


def _scores(texts: pa.Array, margins: np.ndarray, bias: float, buckets: int) -> np.ndarray:
    offsets, data = byte_view(texts)
    found = [np.empty(0)]
    for a, b in row_runs(offsets, 1 << 18):
        owner, hit = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], buckets)
        total, n = np.bincount(owner, weights=margins[hit], minlength=b - a), np.bincount(owner, minlength=b - a)
        found.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))
    return np.concatenate(found)


def _shared(docs: DataFrame, model: Embeddings):
    """The frozen model as one number a bucket: its size is fixed by the number of buckets."""
    return docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0]), len(model.vectors)))


def score(docs: DataFrame, model: Embeddings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row: the softmax output for label 1.

    Null and empty texts have no features and get the output of a zero average.  Rows keep their places; other
    columns are ignored; an empty table gives an empty result.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), *shared.value), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def passing(docs: DataFrame, model: Embeddings, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score ``least`` or more, with all their columns as they are."""
    shared = _shared(docs, model)
    return filtered(docs, text_col, lambda texts: _scores(texts, *shared.value) >= least)
