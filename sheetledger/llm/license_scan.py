"""License scans: phrases by place, and an exact set-similarity join of text blocks with templates.

A block is a window of words, line ends or not: twice as many as the longest template has, and every so many words a new one
starts, so whatever is as long as a template lies whole in one.  Tokens are ordered by how many blocks of the whole table hold them, rarest
first.  A block that holds the threshold's share of a template's tokens shares one of the template's first
tokens (prefix filter), has enough tokens itself (length filter), and from the place of the
shared token on both sides enough tokens are left (positional filter).  Only pairs that pass are counted out.
All of it is DataFrame work; texts are read once and never moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import literal_table
from .common import keep

#: What separates words, after lower-casing A-Z.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """Text in which no word differs, as far as a-z go, from lower-casing A-Z alone.

    Only two other characters lower to something with a letter of a-z (U+212A, U+0130); texts with these take the slow way.
    """
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _windows(words: Column, stride: int) -> Column:
    """Runs of twice ``stride`` words, one from every ``stride``-th word on."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda i: F.slice(words, i + 1, F.lit(2 * stride)))


def _places(words: Column, whole: Column, phrase: Sequence[str]) -> Column:
    """Starts (from 0) of a phrase's words standing one after another."""
    last = F.size(words) - len(phrase)

    def here(i: Column) -> Column:
        cond = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            cond = cond & (F.get(words, i + k) == w)
        return cond

    may = last >= 0
    for w in dict.fromkeys(phrase):
        may = may & F.contains(whole, F.lit(w))
    return F.when(may, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]], templates: Sequence[tuple[str, str]], threshold: float = 0.8,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    ``phrases``: (words, label), found wherever the words stand one after another, also over line ends and overlapping;
    ``templates``: (words, label), found in every window (twice the words of the longest template) that holds at least ``threshold`` of the template's
    distinct tokens, so over line ends, too.  Labels are distinct, sorted and joined by commas ('' without any); ``score`` is the best share of a template
    found, 1 with a phrase, 0 without anything.  Null counts as empty; a document without words has null places.
    Other columns are ignored; an empty table gives an empty result.  Ids are unique and not null.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(words.split()))) for words, label in templates]
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    vocab = F.array(*[F.lit(t) for t in vocabulary]).cast("array<string>")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.regexp_replace(lowered(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), _GAPS, " ").alias("_t"))
    stride = max((len(words.split()) for words, _ in templates), default=1)
    worded = plain.select("doc_id", "_t", F.filter(F.split("_t", " "), lambda w: w != "").alias("_w"))
    placed = worded.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"),
        *[_places(F.col("_w"), F.col("_t"), words.split()).alias(f"_p{i}") for i, (words, _) in enumerate(phrases)],
        F.filter(F.transform(_windows(F.col("_w"), stride), lambda ws: F.struct(F.size(ws).alias("size"), F.array_intersect(ws, vocab).alias("hits"))),
                 lambda b: F.size(b["hits"]) > 0).alias("blocks"))
    found = [F.col(f"_p{i}") for i in range(len(phrases))]
    every = F.flatten(F.array(*found)) if found else F.array().cast("array<int>")
    names = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(found, phrases)])) if found else F.array()
    scanned = keep(placed.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(names.cast("array<string>"))).alias("base"), "blocks"), "windows")

    blocks = scanned.select("doc_id", F.posexplode("blocks").alias("block", "_b")).select("doc_id", "block", "_b.size", "_b.hits")
    # one row per template token: bounded by the templates
    often = {r["t"]: r["n"] for r in blocks.select(F.explode("hits").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (often.get(t, 0), t)))}
    index, wanted = [], []
    for k, (label, tokens) in enumerate(sets):
        need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        ordered = sorted(tokens, key=order.__getitem__)
        wanted.append((k, label, need, ordered))
        index += [(t, k, place) for place, t in enumerate(ordered[:len(ordered) - need + 1])]
    # tables made from the caller's templates: their size is known and may be broadcast
    prefixes = literal_table(spark, index, "token string, template int, place int")
    names_of = literal_table(spark, wanted, "template int, label string, need int, tokens array<string>")
    rank = F.create_map(*[x for t, k in order.items() for x in (F.lit(t), F.lit(k))]) if order else F.create_map().cast("map<string,int>")
    sorted_hits = F.transform(F.array_sort(F.transform("hits", lambda t: F.struct(rank[t].alias("k"), t.alias("t")))), lambda s: s["t"])
    least = min((w[2] for w in wanted), default=1)
    fit = blocks.where((F.col("size") >= least) & (F.size("hits") >= least)).select("doc_id", "block", "size", sorted_hits.alias("hits"))
    met = (fit.select("doc_id", "block", "size", "hits", F.posexplode("hits").alias("at", "token"))
           .join(F.broadcast(prefixes), "token").join(F.broadcast(names_of), "template")
           .where((F.col("size") >= F.col("need")) & (F.col("at") <= F.size("hits") - F.col("need"))
                  & (1 + F.least(F.size("tokens") - F.col("place"), F.size("hits") - F.col("at")) > F.col("need"))))
    share = met.withColumn("_n", F.size(F.array_intersect("hits", "tokens"))).where("_n >= need").select("doc_id", "label", (F.col("_n") / F.size("tokens")).alias("share"))
    labelled = share.groupBy("doc_id").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return scanned.drop("blocks").join(labelled, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
