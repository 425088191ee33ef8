"""Scores of predicted compliance issues against gold ones, with the causes of what went wrong."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggs import rate
from ..functions.strings import norm_ref
from ..session import cut_lineage
from .common import null_safe_join
from .fusion import SIMILAR_TEXT
from .matching import one_to_one
from .ordered import numbered
from .similarity import similar_texts

# Ranks of severities, how far two may lie apart, obligation levels.
SEVERITY_RANK, SEVERITY_TOLERANCE = {"info": 0, "minor": 1, "major": 2, "critical": 3}, 1
OBLIGATIONS = ("MUST", "SHOULD", "MAY", "MUST_NOT")


def obligation_of(description: Column) -> Column:
    """The level in brackets that a description starts with, else SHOULD."""
    found = F.regexp_extract(F.coalesce(description, F.lit("")), r"^\[(MUST_NOT|MUST|SHOULD|MAY)\]", 1)
    return F.when(found == "", F.lit("SHOULD")).otherwise(found)


def _rank(severity: Column) -> Column:
    level = F.lit(SEVERITY_RANK["major"])
    for name, rank in SEVERITY_RANK.items():
        level = F.when(F.lower(severity) == name, F.lit(rank)).otherwise(level)
    return level


def _slim(df: DataFrame, keys: Sequence[str], id_col: str, text: str, tag: str, more: Mapping[str, Column] | None = None) -> DataFrame:
    ref = norm_ref(F.col("ref"))
    return df.select(*keys, F.col(id_col).alias(f"_{tag}"), ref.alias(f"_ref_{tag}"), F.coalesce(F.col(text), F.lit("")).alias(f"_text_{tag}"),
                     *[c.alias(n) for n, c in (more or {}).items()])


def _links(a: DataFrame, b: DataFrame, tags: tuple[str, str], threshold: float) -> DataFrame:
    """Similar distinct texts of two slim tables, with the ratio."""
    left, right = (d.select(F.col(f"_text_{t}").alias("text")) for d, t in zip((a, b), tags))
    return similar_texts(left, right, threshold).select(F.col("text_a").alias(f"_text_{tags[0]}"), F.col("text_b").alias(f"_text_{tags[1]}"), "ratio")


def _alike(a: DataFrame, b: DataFrame, links: DataFrame, tags: tuple[str, str], keys: Sequence[str]) -> DataFrame:
    """Rows of two slim tables with similar texts within the same keys, with the ratio."""
    return null_safe_join(a.join(links, f"_text_{tags[0]}"), b, [*keys, f"_text_{tags[1]}"])


def match_issues(gold: DataFrame, found: DataFrame, keys: Sequence[str], recalled: DataFrame | None = None, threshold: float = SIMILAR_TEXT,
                 tolerance: int = SEVERITY_TOLERANCE) -> DataFrame:
    """keys, mark, gold_id, found_id, ref_exact, gold_level, found_level: one row per match and per row without one.

    ``gold``: keys, gold_id, ref, snippet, severity, obligation; ``found``: keys, found_id, ref, description, severity (ids unique and ordered within keys).
    Within ``keys`` issues are matched one to one: first those of equal references (without blanks and the year of the standard) in id order; then, of the
    others, texts by falling ratio from ``threshold`` on (ties by ids), but never two that both name a reference.  Marks: ``tp``; ``wrong_severity`` (matched, but
    more than ``tolerance`` ranks apart; unknown severities count as major); of found issues without a match ``wrong_ref`` (its text is like a gold one's) or ``spurious``; of gold
    issues without a match ``dropped`` (``recalled``, rows like ``found``, has its reference or a text like it) or ``missed``.  Null texts and references count as
    empty; empty texts are like none.
    """
    level = F.upper(F.coalesce(F.col("obligation"), F.lit("SHOULD")))
    of_gold = {"_rank_g": _rank(F.col("severity")), "gold_level": F.when(level.isin(*OBLIGATIONS), level).otherwise("SHOULD")}
    of_found = {"_rank_p": _rank(F.col("severity")), "found_level": obligation_of(F.col("description"))}
    g, p = cut_lineage(_slim(gold, keys, "gold_id", "snippet", "g", of_gold)), cut_lineage(_slim(found, keys, "found_id", "description", "p", of_found))
    # both sides are numbered in one pass; rows of one number are a match, and a number that one side has alone is still open
    ends = {t: [c for c in d.columns if c not in keys] for t, d in (("g", g), ("p", p))}
    named = [d.where(f"_ref_{t} <> ''").withColumns({"_ref": F.col(f"_ref_{t}"), "_side": F.lit(t)}) for t, d in (("g", g), ("p", p))]
    turns = numbered(named[0].unionByName(named[1], allowMissingColumns=True), [*keys, "_ref", "_side"], ["_g", "_p"], "_n")
    met = cut_lineage(turns.groupBy(*keys, "_ref", "_n").agg(*[F.first(c, ignorenulls=True).alias(c) for c in (*ends["g"], *ends["p"])]))
    by_ref = met.where("_g is not null and _p is not null").select(*keys, *ends["g"], *ends["p"])

    def free(df: DataFrame, tag: str, other: str) -> DataFrame:
        cols = [*keys, *ends[tag]]
        return met.where(f"_{other} is null").select(cols).unionByName(df.where(f"_ref_{tag} = ''").select(cols))

    def without(df: DataFrame, tag: str, other: DataFrame) -> DataFrame:
        taken = other.select(*keys, f"_{tag}").withColumn("_taken", F.lit(True))
        return null_safe_join(df, taken, [*keys, f"_{tag}"], "left").where("_taken is null").drop("_taken")

    free_g, free_p = free(g, "g", "p"), free(p, "p", "g")
    slim = {t: [*keys, f"_{t}", f"_ref_{t}", f"_text_{t}"] for t in "gp"}
    # two that both name a reference never meet
    links = cut_lineage(_links(free_g, free_p, ("g", "p"), threshold))
    pairs = _alike(free_g.where("_ref_g = ''").select(slim["g"]), free_p.select(slim["p"]), links, ("g", "p"), keys).unionByName(
        _alike(free_g.where("_ref_g <> ''").select(slim["g"]), free_p.where("_ref_p = ''").select(slim["p"]), links, ("g", "p"), keys))
    cost = F.struct((-F.col("ratio")).alias("r"), "_g", "_p")
    # null keys meet too, so matching goes by key as one value
    whole = F.to_json(F.struct(*keys)) if keys else F.lit("")
    by_text = one_to_one(pairs.withColumn("_key", whole), ["_key", "_g"], ["_key", "_p"], cost, cost).select(*keys, "_g", "_p")
    told = null_safe_join(null_safe_join(by_text, free_g, [*keys, "_g"]), free_p, [*keys, "_p"])
    judged = by_ref.withColumn("ref_exact", F.lit(True)).unionByName(told.withColumn("ref_exact", F.lit(False)))
    judged = judged.withColumn("mark", F.when(F.abs(F.col("_rank_g") - F.col("_rank_p")) <= tolerance, "tp").otherwise("wrong_severity"))
    open_p, open_g = without(free_p.select(slim["p"]), "p", by_text), without(free_g.select(slim["g"]), "g", by_text)
    like_gold = _alike(open_p, g.select(*keys, "_text_g").distinct(), cut_lineage(_links(open_p, g, ("p", "g"), threshold)), ("p", "g"), keys).select(*keys, "_p").distinct().withColumn("mark", F.lit("wrong_ref"))
    false = null_safe_join(open_p.select(*keys, "_p"), like_gold, [*keys, "_p"], "left").select(*keys, "_p", F.coalesce("mark", F.lit("spurious")).alias("mark"))
    missing = open_g.select(*keys, "_g")
    if recalled is None:
        missing = missing.withColumn("mark", F.lit("missed"))
    else:
        u = _slim(recalled, keys, "found_id", "description", "u")
        same = null_safe_join(open_g.where("_ref_g <> ''"), u.where("_ref_u <> ''").select(*keys, F.col("_ref_u").alias("_ref_g")).distinct(), [*keys, "_ref_g"])
        like = _alike(open_g, u, cut_lineage(_links(open_g, u, ("g", "u"), threshold)), ("g", "u"), keys)
        there = same.select(*keys, "_g").unionByName(like.select(*keys, "_g")).distinct().withColumn("mark", F.lit("dropped"))
        missing = null_safe_join(missing, there, [*keys, "_g"], "left").select(*keys, "_g", F.coalesce("mark", F.lit("missed")).alias("mark"))
    full = judged.unionByName(false, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)
    return full.select(*keys, "mark", F.col("_g").alias("gold_id"), F.col("_p").alias("found_id"), "ref_exact", "gold_level", "found_level")


def issue_scores(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, rates and causes per ``keys`` (none: one row over all); rates come from summed counts, never from other rates."""
    n = lambda *names: F.count_if(F.col("mark").isin(*names))
    hit = F.col("mark") == "tp"
    must = F.count_if(hit & (F.col("gold_level") == "MUST"))
    counts = marks.groupBy(*keys).agg(
        n("tp").alias("tp"), n("wrong_ref", "spurious", "wrong_severity").alias("fp"), n("missed", "dropped").alias("fn"), F.count_if(hit & F.col("ref_exact")).alias("ref_hits"),
        *[n(m).alias(m) for m in ("spurious", "wrong_ref", "wrong_severity", "missed", "dropped")], must.alias("_must"),
        F.count_if(hit & (F.col("gold_level") == "MUST") & (F.col("found_level") != "MUST")).alias("_down"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*keys, "tp", "fp", "fn", rate(tp, tp + fp, 4).alias("precision"), rate(tp, tp + fn, 4).alias("recall"), rate(2 * tp, 2 * tp + fp + fn, 4).alias("f1"),
                         "ref_hits", rate(F.col("ref_hits"), tp, 4).alias("hit_rate"), "spurious", "wrong_ref", "wrong_severity", "missed", "dropped",
                         rate(F.col("_down"), F.col("_must"), 4).alias("downgrade_rate"))


def obligation_confusion(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, gold_level, found_level, n over true positives."""
    return marks.where("mark = 'tp'").groupBy(*keys, "gold_level", "found_level").agg(F.count("*").alias("n"))
