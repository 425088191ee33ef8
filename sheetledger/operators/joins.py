"""Joins (JOI) other than the geometric ones, which are in ``spatial``.

No broadcast hint is set on data tables: Catalyst and AQE broadcast a side only after checking
its size, and split skewed sort-merge partitions.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_down
from .common import null_safe_join
from .quantiles import median_by


def enrich(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Inner equi-joins to dimensions given as (dimension, fact key, dimension key)."""
    for dim, fact_key, dim_key in dims:
        fact = fact.join(dim, F.col(fact_key) == F.col(dim_key)).drop(dim_key)
    return fact


def left_enrich(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.join(b, list(on), "left")


def visible_to(df: DataFrame, members: DataFrame, key: str, user_col: str, user, left_at: str) -> DataFrame:
    """Rows with an active membership of the user."""
    active = members.where((F.col(user_col) == user) & F.col(left_at).isNull()).select(key)
    return df.join(active, key, "left_semi")


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(done.select(*keys), list(keys), "left_anti")


def latest_per(left: DataFrame, right: DataFrame, key: str, order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """For each left row its latest right row, if any (the rank limit is applied before the shuffle too)."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    latest = right.withColumn("_rank", rank).where("_rank = 1").select(key, *cols)
    return left.join(latest, key, "left")


def overlay(src: DataFrame, status: DataFrame, keys: Sequence[str], native: Column) -> DataFrame:
    """Overlay status wins over the native default; the note comes from the overlay only."""
    over = status.select(*keys, F.col("status").alias("_over"), "note")
    return src.join(over, list(keys), "left").withColumn("status", F.coalesce("_over", native)).drop("_over")


def join_text(a: DataFrame, b: DataFrame, a_key: str, b_key: str, how: str = "inner") -> DataFrame:
    """Keys of different types met as text."""
    return a.join(b, F.col(a_key).cast("string") == F.col(b_key).cast("string"), how)


def std_key(col: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", ""))


def std_base(col: Column) -> Column:
    """Number without its year."""
    return F.regexp_replace(std_key(col), r"-[^-]*$", "")


def match_library(refs: DataFrame, library: DataFrame, ref: str = "std_no", book: str = "book_id",
                  lib_no: str = "lib_std_no") -> DataFrame:
    """matched (same key) / version_mismatch (same base key) / missing; ``library``: book_id, lib_std_no."""
    lib = library.where(F.length(lib_no) > 0)
    full = lib.groupBy(std_key(F.col(lib_no)).alias("_full")).agg(F.max(F.struct(book, lib_no)).alias("_fb"))
    base = lib.groupBy(std_base(F.col(lib_no)).alias("_base")).agg(F.min(F.struct(book, lib_no)).alias("_bb"))
    joined = (refs.withColumn("_full", std_key(F.col(ref))).withColumn("_base", std_base(F.col(ref)))
              .join(full, "_full", "left").join(base, "_base", "left"))
    state = (F.when(F.col("_fb").isNotNull(), "matched").when(F.col("_bb").isNotNull(), "version_mismatch")
             .otherwise("missing"))
    hit = F.coalesce("_fb", "_bb")
    return joined.select(*refs.columns, state.alias("state"), hit[book].alias(book), hit[lib_no].alias(lib_no))


def reconcile(actual: DataFrame, expected: DataFrame, key: str, listed_only: bool = False) -> DataFrame:
    """``actual`` and ``expected`` are counts per key; diff > 0 means too few found."""
    joined = expected.select(key, "expected").join(actual.select(key, "actual"), key, "left" if listed_only else "full")
    exp, act = F.coalesce("expected", F.lit(0)), F.coalesce("actual", F.lit(0))
    return joined.select(key, exp.cast("long").alias("expected"), act.cast("long").alias("actual"),
                         (exp - act).cast("long").alias("diff"))


def with_parent(orgs: DataFrame, users: DataFrame, projects: DataFrame) -> DataFrame:
    """Organizations (org_id, name, parent_id) with parent name and counts; children are counted
    before the join, so nothing fans out."""
    parent = orgs.select(F.col("org_id").alias("parent_id"), F.col("name").alias("parent_name"))
    n_users = users.groupBy("org_id").agg(F.count_distinct("user_id").alias("user_count"))
    n_projects = projects.groupBy("org_id").agg(F.count_distinct("project_id").alias("project_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (orgs.join(parent, "parent_id", "left").join(n_users, "org_id", "left").join(n_projects, "org_id", "left")
            .select("org_id", "name", "parent_name", zero("user_count"), zero("project_count")))


def activity(log: DataFrame, key: str, *id_sets: DataFrame) -> DataFrame:
    """Log rows whose id is in the union of the id sets (each a one-column frame)."""
    ids = reduce(lambda a, b: a.union(b), [s.toDF(key) for s in id_sets])
    return log.join(ids, key, "left_semi")


def changed_since(rows: DataFrame, marks: DataFrame, key: str, updated: str, built: str) -> DataFrame:
    """Rows changed after the watermark of their project; all rows where it is null or absent."""
    return (rows.join(marks.select(key, built), key, "left")
            .where(F.col(built).isNull() | (F.col(updated) > F.col(built))))


def contains_pairs(texts: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Distinct (text, word) with the word inside the text, as an equi-join.

    Short texts (titles) are cut into their substrings of the lengths that words have.
    """
    terms = words.select(F.col(word)).where(F.length(word) > 0).distinct()
    lengths = terms.agg(F.collect_set(F.length(word)).alias("_lens"))
    titles = null_safe_join(texts.select(text).where(F.col(text).isNotNull()).distinct(), lengths, [])
    cut = titles.select(text, F.explode("_lens").alias("_len")).where(F.length(text) >= F.col("_len"))
    pieces = cut.select(text, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - F.col("_len") + 1),
        lambda i: F.substring(F.col(text), i, F.col("_len"))))).alias(word))
    return pieces.join(terms, word).select(text, word)


def match_entries(entries: DataFrame, titles: DataFrame, normal) -> DataFrame:
    """Entry → drawing: same normalized title, else the shortest title that ends with the entry.

    ``entries``: entry; ``titles``: title, id; ``normal`` is a Column function.
    """
    keyed = entries.select("entry", normal(F.col("entry")).alias("_key")).where("_key <> ''").distinct()
    index = (titles.select("title", "id", normal(F.col("title")).alias("_norm")).where("_norm <> ''"))
    exact = index.groupBy(F.col("_norm").alias("_key")).agg(F.min("id").alias("_exact"))
    lengths = keyed.agg(F.collect_set(F.length("_key")).alias("_lens"))
    one = index.groupBy("_norm").agg(F.min(F.struct(F.length("title").alias("n"), "title", "id")).alias("_t"))
    ends = null_safe_join(one, lengths, []).select(
        "_t", "_norm", F.explode("_lens").alias("_len")).where(F.length("_norm") >= F.col("_len"))
    suffix = (ends.select("_t", F.expr("right(_norm, _len)").alias("_key"))
              .join(keyed.select("_key").distinct(), "_key", "left_semi")
              .groupBy("_key").agg(F.min("_t").alias("_best")))
    return (keyed.join(exact, "_key", "left").join(suffix, "_key", "left")
            .select("entry", F.coalesce("_exact", F.col("_best.id")).alias("id"),
                    F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_best").isNotNull(), "suffix").alias("how")))


# Fixed value: vertical offset allowed on one row, in label heights.
ROW_TOLERANCE_RATIO = 1.2


def field_value(tokens: DataFrame, keys: Sequence[str], label: str, other_labels: Sequence[str]) -> DataFrame:
    """First non-label token on the row of the label, to its right.

    ``tokens``: keys, text, x0, y0, x1, y1, seq.  One label row per sheet, so each token meets at most one.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    height = F.greatest(F.abs(F.col("y1") - F.col("y0")), F.lit(1.0))
    return field_value_at(tokens.select(*keys, "text", "seq", cx.alias("x"), cy.alias("y"), height.alias("h")), keys, label, other_labels)


def field_value_at(tokens: DataFrame, keys: Sequence[str], label: str, other_labels: Sequence[str]) -> DataFrame:
    """``field_value`` of tokens with known centre and height (keys, text, x, y, h, seq): nothing is rounded on the way to the comparison."""
    clean = F.regexp_replace(F.trim("text"), r"^[:：]+|[:：]+$", "")
    placed = tokens.select(*keys, "text", "seq", clean.alias("_clean"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("h").alias("_h"))
    anchor = (placed.where(F.col("_clean") == label).groupBy(*keys)
              .agg(F.min_by(F.struct("_x", "_y", "_h"), "seq").alias("_l")))
    right = placed.where((F.col("_clean") != label) & ~F.col("_clean").isin(list(other_labels)))
    return (null_safe_join(right, anchor, keys)
            .where((F.col("_x") > F.col("_l._x")) & (F.abs(F.col("_y") - F.col("_l._y")) <= F.col("_l._h") * ROW_TOLERANCE_RATIO))
            .groupBy(*keys).agg(F.min_by("text", F.struct("_x", "seq")).alias("value")))


def learn_aliases(aliases: DataFrame, titled: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """alias → unit where all titles that contain the alias agree and no other alias has that unit."""
    votes = titled.where(F.col("unit").isNotNull() & (F.col("unit") != ""))
    if ignore:
        votes = votes.where(~F.col("unit").isin(list(ignore)))
    pairs = contains_pairs(votes, "title", aliases, "alias").join(votes.select("title", "unit").distinct(), "title")
    agreed = (pairs.groupBy("alias").agg(F.count_distinct("unit").alias("_n"), F.min("unit").alias("unit"))
              .where("_n = 1"))
    sole = agreed.groupBy("unit").agg(F.count("*").alias("_n"), F.min("alias").alias("alias")).where("_n = 1")
    return sole.select("alias", "unit")


def screen(docs: DataFrame, clauses: DataFrame, discipline: str = "discipline", general: str = "general") -> DataFrame:
    """Every document with the clauses that apply: its discipline's, the general and the mandatory ones.

    The OR is a scope key on both sides, so it is an equi-join with the clause library.
    """
    common = F.col("clause_discipline").isNull() | (F.col("clause_discipline") == general) | F.col("mandatory")
    scoped = clauses.withColumn("_scope", F.when(common, "*").otherwise(F.col("clause_discipline")))
    scopes = F.array_distinct(F.array(F.lit("*"), F.coalesce(F.col(discipline), F.lit("*"))))
    return docs.withColumn("_scope", F.explode(scopes)).join(scoped, "_scope").drop("_scope")


def cooccur(df: DataFrame, group: str, item: str, project: str) -> DataFrame:
    """Item pairs met in one group, with distinct groups and project coverage.

    Items are a dictionary (disciplines), so a group's set is bounded by the dictionary.
    """
    sets = df.groupBy(group, project).agg(F.array_sort(F.collect_set(item)).alias("_items"))
    left = sets.select(group, project, "_items", F.posexplode("_items").alias("_i", "item_a"))
    pairs = left.select(group, project, "item_a",
                        F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(
        F.count_distinct(group).alias("n_groups"), F.count_distinct(project).alias("n_projects"))


def align(a: DataFrame, b: DataFrame, key: str, label: str, pos_a: str, pos_b: str) -> DataFrame:
    """Per key of ``a``: offset onto ``b`` (median difference of shared labels), residual (median error), n."""
    shared = a.join(b, label).withColumn("_diff", F.col(pos_b) - F.col(pos_a))
    offset = median_by(shared, [key], "_diff", "offset", "shared")
    errors = shared.join(offset.select(key, "offset"), key).withColumn("_err", F.abs(F.col("offset") - F.col("_diff")))
    residual = median_by(errors, [key], "_err", "residual")
    return offset.join(residual, key)


# Gap matching.
MAX_MERGE_SPAN, SCALE_TOLERANCE, MIN_MATCH_GAPS = 3, 0.02, 5
_STEP = 0.0806  # twice ln(1.02 / 0.98), so the sums close to a gap lie in two buckets at most, mostly in one
_PREFIX = 5  # gaps that both sides meet by


@F.pandas_udf(T.StructType([T.StructField("paths", T.LongType()), T.StructField("end", T.IntegerType()), T.StructField("spans", T.ArrayType(T.IntegerType()))]))
def _walk(target: pd.Series, anchor: pd.Series, start: pd.Series) -> pd.DataFrame:
    """Ways to lay ``target`` on ``anchor`` from ``start`` on, where the last one ends, and how many anchor gaps each target gap takes on the way there."""
    out = []
    for gaps, base, first in zip(target, anchor, start):
        ways: dict[int, tuple[int, list[int]]] = {int(first): (1, [])}
        for gap in gaps:
            nxt: dict[int, tuple[int, list[int]]] = {}
            for pos, (n, taken) in ways.items():
                total = 0.0
                for w in range(1, MAX_MERGE_SPAN + 1):
                    if pos + w > len(base):
                        break
                    total += base[pos + w - 1]
                    if abs(gap - total) <= total * SCALE_TOLERANCE:
                        more = nxt.get(pos + w)
                        nxt[pos + w] = (n + more[0], more[1]) if more else (n, [*taken, w])
            ways = nxt
            if not ways:
                break
        end = max(ways, default=-1)
        out.append((sum(n for n, _ in ways.values()), end, ways[end][1] if ways else []))
    return pd.DataFrame(out, columns=["paths", "end", "spans"])


def match_gaps(targets: DataFrame, anchors: DataFrame, min_gaps: int = MIN_MATCH_GAPS) -> DataFrame:
    """Target gap sequences with exactly one place over *all* anchors: target_id, anchor_id, start, end, spans, scale_ratio.

    ``spans`` says how many anchor gaps each target gap took, ``scale_ratio`` is the target's length over the length of these.

    ``targets``: target_id, gaps; ``anchors``: anchor_id, gaps (arrays of positive numbers; adjacent
    anchor gaps may merge).  Equal sequences are folded first — two equal anchors make any hit
    ambiguous — and places are found by the buckets of the first five target gaps (fewer, if ``min_gaps`` is less).
    """
    clean = lambda df: df.where(F.expr("size(gaps) > 0 and forall(gaps, g -> g > 0)"))
    number = F.monotonically_increasing_id()  # fixed by writing it down
    asked = clean(targets).where(F.size("gaps") >= min_gaps)
    wanted = write_down(asked.select("gaps").distinct().withColumn("_t", number))
    library = write_down(clean(anchors).groupBy("gaps").agg(F.count("*").alias("_copies"), F.min("anchor_id").alias("anchor_id")).withColumn("_l", number))
    depth = max(1, min(min_gaps, _PREFIX))
    keys = [f"_b{i}" for i in range(depth)]
    meet = "".join(keys)
    at = lambda c: F.log(c) / _STEP
    # where a sum lies beside its bucket's start, in 32nds of a bucket; a gap's reach ends less than half a bucket beside it
    beside = lambda c, key: F.floor((at(c) - F.col(key)) * 32).cast("int") + 16
    ends = lambda gap: [at(gap / (1 + SCALE_TOLERANCE) * (1 - 1e-9)), at(gap / (1 - SCALE_TOLERANCE) * (1 + 1e-9))]
    reach = wanted.agg(*[f(e).alias(f"{n}{i}") for i in range(depth) for n, f, e in zip("ab", (F.min, F.max), ends(F.element_at("gaps", i + 1)))]).first()
    probe = wanted.withColumn("_fine", F.lit(0))
    places = library.select("gaps", "_l", F.explode(F.sequence(F.lit(0), F.size("gaps") - 1)).alias("start")).withColumns({"_at": F.col("start"), "_fine": F.lit(0)})
    for i, key in enumerate(keys):
        gap = F.element_at("gaps", i + 1)
        probe = probe.withColumn(key, F.explode(F.array_distinct(F.array(*[F.floor(e).cast("int") for e in ends(gap)]))))
        probe = probe.withColumn("_fine", F.col("_fine") + F.shiftleft(beside(gap, key), 6 * i))
        more = [F.when(F.col("_w") > w, F.get("gaps", F.col("_at") + w)).otherwise(0.0) for w in range(1, MAX_MERGE_SPAN)]
        taken = sum(more, F.get("gaps", F.col("_at")))
        # gaps that the rest of the prefix needs at least are left over, and some target gap lies within reach
        places = (places.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in range(1, MAX_MERGE_SPAN + 1)])))
                  .where(F.col("_at") + F.col("_w") + (depth - 1 - i) <= F.size("gaps"))
                  .withColumn("_sum", taken).where(at(F.col("_sum")).between(reach[f"a{i}"], reach[f"b{i}"])).withColumn(key, F.floor(at(F.col("_sum"))).cast("int"))
                  .withColumn("_fine", F.col("_fine") + F.shiftleft(beside(F.col("_sum"), key), 6 * i)).withColumn("_at", F.col("_at") + F.col("_w")).drop("_w", "_sum"))
    # Numbers only meet here, by all buckets at once, and the places in the buckets rule most of them out; the sequences themselves come back for the candidates.
    # A written table is small beside the rows made of it, so its size must not call for a broadcast.
    probe = probe.select("_t", F.size("gaps").alias("_need"), F.hash(*keys).alias(meet), F.col("_fine").alias("_mine")).hint("merge")
    places = places.select("_l", "start", (F.size("gaps") - F.col("start")).alias("_room"), F.hash(*keys).alias(meet), "_fine")
    part = lambda c, i: F.shiftright(F.col(c), 6 * i).bitwiseAND(F.lit(63))
    under, over = (math.floor(32 * math.log(1 + SCALE_TOLERANCE) / _STEP) + 2, math.floor(-32 * math.log(1 - SCALE_TOLERANCE) / _STEP) + 2)
    close = reduce(lambda x, y: x & y, [(part("_fine", i) - part("_mine", i)).between(-under, over) for i in range(depth)])
    cands = probe.join(places, meet).where((F.col("_need") <= F.col("_room")) & close).select("_t", "_l", "start").distinct()
    cands = cands.join(wanted.hint("merge"), "_t").join(library.withColumnRenamed("gaps", "base").hint("merge"), "_l")
    hits = (cands.withColumn("_w", _walk("gaps", "base", "start")).where("_w.paths > 0")
            .groupBy("_t").agg(F.sum(F.col("_w.paths") * F.col("_copies")).alias("_n"), F.min("anchor_id").alias("anchor_id"), F.min("start").alias("start"),
                               F.min("_w.end").alias("end"), F.min("_w.spans").alias("spans"), F.first("gaps").alias("gaps"), F.first("base").alias("base"))
            .where("_n = 1"))
    whole = lambda c: F.aggregate(c, F.lit(0.0), lambda a, g: a + g)
    ratio = whole(F.col("gaps")) / whole(F.slice("base", F.col("start") + 1, F.col("end") - F.col("start")))
    return asked.join(hits.hint("merge"), "gaps").select("target_id", "anchor_id", "start", "end", "spans", ratio.alias("scale_ratio"))


# A ratio further from 1 than this is to be looked at.
SCALE_RATIO_REVIEW = 0.01


def propagate_zones(candidates: DataFrame, anchors: DataFrame, confirmed: DataFrame | None = None, review: float = SCALE_RATIO_REVIEW) -> DataFrame:
    """Zone labels of anchors for the candidates whose gaps lie in one place only: drawing_id, zone_index, zone_label, anchor_drawing_id, anchor_zone_index,
    scale_ratio, needs_review.

    ``candidates`` (drawing_id, zone_index, gaps); ``anchors`` (drawing_id, zone_index, direction, zone_label, gaps).  Drawings that are anchors, and zones in ``confirmed``
    (drawing_id, zone_index), get none.  A ratio further than ``review`` from 1 marks a label for review, it does not reject it.  A candidate's zone may have
    several sequences; each is matched by itself.
    """
    open_ = candidates.join(anchors.select("drawing_id").distinct(), "drawing_id", "left_anti")
    if confirmed is not None:
        open_ = open_.join(confirmed.select("drawing_id", "zone_index"), ["drawing_id", "zone_index"], "left_anti")
    number = F.struct("drawing_id", "zone_index", "direction")
    library = anchors.select(number.alias("anchor_id"), F.col("gaps").cast("array<double>").alias("gaps"))
    places = match_gaps(open_.select(F.struct("drawing_id", "zone_index").alias("target_id"), F.col("gaps").cast("array<double>").alias("gaps")), library)
    labels = anchors.select(number.alias("anchor_id"), F.trim(F.coalesce("zone_label", F.lit(""))).alias("zone_label"))
    return places.join(labels, "anchor_id").select(
        "target_id.drawing_id", "target_id.zone_index", "zone_label", F.col("anchor_id.drawing_id").alias("anchor_drawing_id"), F.col("anchor_id.zone_index").alias("anchor_zone_index"),
        F.round("scale_ratio", 4).alias("scale_ratio"), (F.abs(F.col("scale_ratio") - 1) > review).alias("needs_review"))
