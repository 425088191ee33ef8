"""Language ID by prediction by partial matching.

For each language a tree of byte contexts up to three bytes long is filled from a sample of labelled
texts and then frozen.  A byte seen in the longest known context has its share there; any other
costs that context's escape probability and is coded in the next shorter one, without the bytes
that the longer one had (exclusion); below order 0 all unseen bytes are alike.  The language under which a
text's exact code length is shortest is its prediction.

Frozen contexts are laid out as rows of one table per language, so the code lengths of a whole
batch are table reads in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_view, filtered, row_runs

ORDER = 3
UNDETERMINED = "und"
_START = 0x0A  # what stands before a text


@dataclass
class Trees:
    """Frozen statistics: code lengths in bits of each symbol in each context row, by language."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol; bytes that no sample has share the last symbol
    row: np.ndarray     # three symbols of context -> row
    bits: np.ndarray    # (language, row * symbols + symbol)

    @property
    def symbols(self) -> int:
        return int(round(len(self.row) ** (1 / ORDER)))


def sample(docs: DataFrame, id_col: str, lang_col: str, per_language: int) -> DataFrame:
    """About ``per_language`` labelled rows of each language (all, if fewer), chosen by a hash of the id."""
    sizes = docs.groupBy(lang_col).count().collect()  # one row per language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col(lang_col) == r[lang_col], min(1.0, per_language / r["count"])).otherwise(share)
    place = F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return docs.where(place < share)


def _contexts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each byte those one, two and three places before it; before a text stand line ends."""
    out = []
    for k in range(1, ORDER + 1):
        before = np.full(len(data), data.dtype.type(_START))
        before[k:] = data[:-k] if len(data) > k else before[k:]
        for j in range(k):
            before[starts[sizes > j] + j] = _START
        out.append(before)
    return out


def gram_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, gram (three bytes of context and the byte, as one number), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            offsets, data = byte_view(batch.column(1))
            sizes = np.diff(offsets)
            c1, c2, c3 = _contexts(data[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0], sizes)
            own = data[offsets[0]:offsets[-1]].astype(np.uint32)
            grams = c3.astype(np.uint32) << 24 | c2.astype(np.uint32) << 16 | c1.astype(np.uint32) << 8 | own
            of = np.repeat(langs, sizes)
            for lang in dict.fromkeys(langs):
                found, n = np.unique(grams[of == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                                                 ["lang", "gram", "n"])

    counted = docs.select(lang_col, F.col(text_col).cast("string")).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def freeze(languages: list[str], grams: list[np.ndarray], counts: list[np.ndarray], contexts: int) -> Trees:
    """Trees from each language's grams and their counts; at most ``contexts`` contexts of the highest order,
    the most frequent over all languages, have rows of their own."""
    seen = np.zeros(256, dtype=bool)
    for g in grams:
        for shift in (0, 8, 16, 24):
            seen[np.unique(g >> shift & 255)] = True
    seen[_START] = True
    size = int(seen.sum()) + 1
    symbol = np.full(256, size - 1, dtype=np.int64)
    symbol[seen] = np.arange(size - 1)
    weight = np.ones(size)
    weight[-1] = 256 - size + 1  # bytes behind the last symbol
    parts = [[symbol[g >> s & 255] for s in (24, 16, 8, 0)] for g in grams]

    def names(order: int) -> list[np.ndarray]:
        out = []
        for c3, c2, c1, _ in parts:
            ctx = np.zeros_like(c1)
            for c in (c3, c2, c1)[ORDER - order:]:
                ctx = ctx * size + c
            out.append(ctx)
        return out

    levels = []  # per order: names of its contexts, in rows one after another
    for order in range(ORDER + 1):
        own = names(order)
        found, back = np.unique(np.concatenate([*own, np.zeros(1, dtype=np.int64)]), return_inverse=True)
        if order == ORDER:
            total = np.bincount(back, weights=np.concatenate([*counts, [0]]), minlength=len(found))
            found = np.sort(found[np.argsort(-total, kind="stable")[:contexts]])
        levels.append((own, found))
    base = np.cumsum([0] + [len(f) for _, f in levels])
    bits = np.empty((len(languages), int(base[-1]) * size), dtype=np.float32)
    # rows that a context falls back to: its own name without the earliest symbol
    parent = [np.searchsorted(levels[k - 1][1], levels[k][1] % size ** (k - 1)) for k in range(1, ORDER + 1)]
    for li in range(len(languages)):
        lower = np.full((1, size), 1 / 256)
        for order, (own, found) in enumerate(levels):
            if order:
                lower = lower[parent[order - 1]]
            at = np.searchsorted(found, own[li])
            hit = (at < len(found)) & (found[np.minimum(at, len(found) - 1)] == own[li])
            n = np.bincount(at[hit] * size + parts[li][3][hit], weights=counts[li][hit], minlength=len(found) * size).reshape(-1, size)
            kinds, whole = (n > 0).sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
            left = ((n == 0) * lower * weight).sum(axis=1, keepdims=True)  # what exclusion leaves of the lower order
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(left > 0, kinds / (whole + kinds), 0.0)
                p = np.where(n > 0, n / whole * (1 - escape), escape * lower / left)
            lower = np.where(whole > 0, p, lower)
            bits[li, base[order] * size:base[order + 1] * size] = -np.log2(np.maximum(lower, 1e-30)).ravel()
    row = np.zeros(1, dtype=np.int64)
    for order in range(1, ORDER + 1):
        row = np.tile(row, size)  # a longer context reads as its last symbols do, until it has a row itself
        found = levels[order][1]
        row[found] = base[order] + np.arange(len(found))
    return Trees(languages, symbol.astype(np.int32), row.astype(np.int32), bits)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000,
          contexts: int = 20_000) -> Trees:
    """Frozen trees from about ``per_language`` labelled rows of each language, whole texts.

    Rows without a language or text are not learned from.  What reaches the driver is the sample's
    distinct byte quadruples, bounded by the two limits given, not by the table.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = gram_counts(sample(known, id_col, lang_col, per_language), lang_col, text_col).toPandas()
    languages = sorted(rows["lang"].unique()) if len(rows) else []
    each = [rows[rows["lang"] == lang] for lang in languages]
    return freeze(languages, [e["gram"].to_numpy(np.int64) for e in each], [e["n"].to_numpy(np.float64) for e in each], contexts)


def code_lengths(trees: Trees, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(text, language) bits for the texts between the edges."""
    size = trees.symbols
    c1, c2, c3 = (trees.symbol[c] for c in _contexts(data, edges[:-1], np.diff(edges)))
    at = trees.row[(c3 * size + c2) * size + c1] * np.int32(size) + trees.symbol[data]
    out = np.empty((len(edges) - 1, len(trees.languages)))
    for k in range(len(trees.languages)):
        total = np.concatenate([[0.0], np.cumsum(trees.bits[k][at], dtype=np.float64)])
        out[:, k] = total[edges[1:]] - total[edges[:-1]]
    return out


def _languages(texts: pa.Array, trees: Trees) -> tuple[list[str], np.ndarray]:
    offsets, data = byte_view(texts)
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not trees.languages:
        return langs, scores
    for a, b in row_runs(offsets):
        body, edges = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        bits = code_lengths(trees, body, edges)
        share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
        for i, k in enumerate(bits.argmin(axis=1).tolist()):
            if any(map(str.isalpha, body[edges[i]:edges[i + 1]].tobytes().decode("utf-8", "replace"))):
                langs[a + i], scores[a + i] = trees.languages[k], share[i]
    return langs, scores


def predict(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; the score is the language's share at equal priors.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.  Ties go to the language
    that sorts first.  Rows keep their places; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by ``train``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _languages(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def passing(docs: DataFrame, trees: Trees, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return filtered(docs, text_col, lambda texts: _languages(texts, shared.value)[1] >= least)
