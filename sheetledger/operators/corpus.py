"""Text corpus jobs (TXT): each works on the rows of its document, without a shuffle where it can."""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import CLOSURE_PATTERNS, COST_WORDS, closure, any_word
from ..session import cut_lineage
from .topk import cost_risk
from .windows import row_bands, split_by_gap

# Article numbers, obligation words, sentence ends, contents lines, page numbers, scan limit.
ARTICLE_PATTERN = r"\d{1,2}\.\d{1,2}\.\d{1,2}"
OBLIGATION_WORDS = ("必须", "严禁", "不应", "不得", "不宜", "应", "宜", "可")
SENTENCE_END = "[。；]"
TOC_PATTERN = r"[·.．]{3,}|[·.．]{2,}\s*\d+\s*$"
MIN_ARTICLE_CHARS, MAX_PAGE_DIGITS, MIN_CHARS_PER_PAGE = 12, 3, 200
WATERMARKS = ("住房城乡建设部信息公开", "浏览专用", "住房和城乡建设部信息公开")


def _article_test(words: Sequence[str], sentence_end: str) -> str:
    """One pattern over the trimmed text: long enough, not a bare number, and behind its leading number
    an obligation word or a full sentence."""
    named = "|".join(re.escape(w) for w in words)
    return (rf"(?s)^(?=.{{6}})(?!\d+$)[\d.．\s]*+(?=.{{4}})"
            rf"(?:.*?(?:{named})|(?=.{{{MIN_ARTICLE_CHARS}}}).*?{sentence_end})")


def looks_like_article(text: Column, words: Sequence[str] = OBLIGATION_WORDS, sentence_end: str = SENTENCE_END) -> Column:
    """An obligation word, or a full sentence of some length; bare numbers and short headings are not."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "").rlike(_article_test(words, sentence_end))


def is_page_number(line: Column) -> Column:
    return line.rlike(rf"^\s*\d{{1,{MAX_PAGE_DIGITS}}}\s*$")


def split_articles(df: DataFrame, key: str, text: str, article: str = ARTICLE_PATTERN,
                   words: Sequence[str] = OBLIGATION_WORDS, sentence_end: str = SENTENCE_END) -> DataFrame:
    """Numbered articles of a text: key, idx, article_no, body.

    Page-number lines are dropped, continuation lines joined, what precedes the first number is not
    an article.  The text is cut before every line that starts with a number.
    """
    # Whole-text patterns instead of a line loop; each step is a column of its own, so none runs twice.  Articles are cut, kept
    # and numbered inside their row: no text is shuffled.
    flat = df.select(key, F.regexp_replace(text, rf"(?m)^\s*\d{{1,{MAX_PAGE_DIGITS}}}\s*$", "").alias("_t"))
    parts = flat.select(key, F.filter(F.split("_t", rf"(?m)^[ \t]*(?={article})"), lambda p: p.rlike(rf"^{article}")).alias("_p"))
    body = lambda p: F.regexp_replace(F.regexp_replace(p, rf"^{article}", ""), r"\s*\n\s*|^\s+|\s+$", "")
    made = parts.select(key, F.transform("_p", lambda p: F.struct(F.regexp_extract(p, rf"^{article}", 0).alias("article_no"), body(p).alias("body"))).alias("_a"))
    kept = made.select(key, F.filter("_a", lambda a: a["body"].rlike(_article_test(words, sentence_end))).alias("_a"))
    return kept.select(key, F.posexplode("_a").alias("idx", "_r")).select(key, "idx", "_r.article_no", "_r.body")


def strip_boilerplate(df: DataFrame, key: str, text: str, watermarks: Sequence[str] = WATERMARKS, toc: str = TOC_PATTERN) -> DataFrame:
    """Text without watermark, contents and page-number lines, with how many lines of each were cut."""
    kind = lambda l: (F.when(any_word(l, watermarks), "watermark").when(is_page_number(l), "page_number")
                      .when(l.rlike(toc), "contents").otherwise("keep"))
    rows = df.select(key, F.transform(F.split(text, "\n"), lambda l: F.struct(kind(l).alias("k"), l.alias("l"))).alias("_l"))
    count = lambda k: F.size(F.filter("_l", lambda s: s["k"] == k)).alias(k)
    kept = F.array_join(F.transform(F.filter("_l", lambda s: s["k"] == "keep"), lambda s: s["l"]), "\n")
    return rows.select(key, kept.alias("text"), count("watermark"), count("page_number"), count("contents"))


def is_scanned(chars: Column, pages: Column, limit: float = MIN_CHARS_PER_PAGE) -> Column:
    """Too few characters per page; no pages means a failed parse, not a scan."""
    return F.coalesce((pages > 0) & (chars / pages < limit), F.lit(False))


def semantic_candidates(df: DataFrame, key: str, fields: Mapping[str, float], patterns: Mapping[str, str]) -> DataFrame:
    """Unit, zone and space names found in several fields: key, node_type, label, source, confidence.

    ``fields`` maps a column to the confidence of a hit in it, in order of preference; a name found
    again in a later field is not repeated.  ``patterns`` maps a node type to a regular expression.
    """
    def hits(rank: int, field: str, conf: float, kind: str, pattern: str) -> Column:
        names = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(field), F.lit("")), F.lit(pattern), F.lit(0)))
        return F.transform(names, lambda v: F.struct(F.lit(kind).alias("node_type"), v.alias("label"), F.lit(rank).alias("n"),
                                                     F.lit(field).alias("source"), F.lit(float(conf)).alias("confidence")))

    found = F.flatten(F.array(*[hits(i, field, conf, kind, p) for i, (field, conf) in enumerate(fields.items()) for kind, p in patterns.items()]))
    rows = df.select(key, F.explode(found).alias("_s")).select(key, "_s.*")
    return rows.groupBy(key, "node_type", "label").agg(F.min_by(F.struct("source", "confidence"), "n").alias("_f")).select(
        key, "node_type", "label", "_f.source", "_f.confidence")


def to_lines(tokens: DataFrame, keys: Sequence[str], seq: str, gap_factor: float = 6.0,
             min_gap: float = 40.0, row_tol: float = 3.0) -> DataFrame:
    """Tokens (x, y, text) of a page to lines: columns by large gaps, then rows, then x; repeats at one spot once.

    Only the tokens of a single line meet in one array.
    """
    spots = tokens.dropDuplicates([*keys, "x", "y", "text"])
    columns = cut_lineage(split_by_gap(spots, keys, "x", seq, gap_factor, min_gap, "column"))
    rows = row_bands(columns, [*keys, "column"], "y", row_tol)
    ordered = F.array_sort(F.collect_list(F.struct("x", "y", seq, "text")))
    return rows.groupBy(*keys, "column", "row_no").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "").alias("line"), F.count("*").alias("tokens"))


def search_articles(df: DataFrame, q: str, cols: Sequence[str], mandatory: Column, order: Sequence[Column], limit: int = 20,
                    preview: str | None = None, chars: int = 300) -> DataFrame:
    """Case-insensitive substring search, mandatory articles first, with a preview of the text."""
    from .projections import search

    hits = search(df, q, cols).withColumn("is_mandatory", mandatory)
    if preview:
        hits = hits.withColumn("preview", F.substring(preview, 1, chars))
    return hits.orderBy(F.desc("is_mandatory"), *order).limit(limit)


def risk_profile(df: DataFrame, key: str, text: str, problems: Mapping[str, tuple[str, float, int]],
                 closures: Mapping[str, str] = CLOSURE_PATTERNS, cost_words: str = COST_WORDS) -> DataFrame:
    """Problem types, highest reliable lift and closure flags of every document."""
    body = F.coalesce(F.col(text), F.lit(""))
    types = F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(n)) for n, (p, _, _) in problems.items()]))
    return df.select(key, types.alias("problem_types"), cost_risk(F.col(text), problems).alias("max_lift"),
                     *closure(F.col(text), closures, cost_words))


def checklist(docs: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """Each checklist item of the document's discipline as (applies, covered).

    ``docs``: key, discipline, text, has_location, has_meta, interface_conflict, risk_level;
    ``items``: discipline, item, kind (meta, location, interface, constructability, risk, concern), words.
    Items are the rule library, so the equi-join fans out by a fixed number.
    """
    hit = F.exists("words", lambda w: F.col("text").contains(w))
    kind = F.col("kind")
    applies = F.when(kind == "interface", F.col("interface_conflict") | hit).when(kind == "risk", F.col("risk_level") != "low").when(
        kind == "constructability", hit).when(kind == "concern", hit).otherwise(True)
    covered = (F.when(kind == "meta", F.col("has_meta")).when(kind == "location", F.col("has_location"))
               .when(kind == "interface", hit & F.col("has_location")).when(kind == "risk", F.col("risk_level") == "high")
               .when(kind == "constructability", hit & F.col("has_meta")).otherwise(hit))
    return docs.join(items, "discipline").select(
        key, "discipline", "item", "kind", F.coalesce(applies, F.lit(False)).alias("applies"),
        F.coalesce(applies & covered, F.lit(False)).alias("covered"))


def checklist_summary(rows: DataFrame, key: str) -> DataFrame:
    """Checked, covered, ratio and the uncovered items per document."""
    return rows.groupBy(key).agg(
        F.count_if("applies").alias("checked"), F.count_if("covered").alias("covered"),
        F.coalesce(F.round(F.try_divide(F.count_if("covered"), F.count_if("applies")), 2), F.lit(0.0)).alias("ratio"),
        F.array_sort(F.collect_set(F.when(F.col("applies") & ~F.col("covered"), F.col("item")))).alias("uncovered"))


def audit(df: DataFrame, key: str, text: str, discipline: Column, disciplines: Mapping[str, Mapping[str, Sequence[str]]],
          concerns: Mapping[str, Sequence[str]], high_signals: Sequence[str], medium_signals: Sequence[str],
          scenarios: Sequence[tuple[str, Sequence[str]]], patterns: Mapping[str, Sequence[str]], top: int = 3) -> DataFrame:
    """Full review record per document, as chained Column stages in one pass.

    discipline (given, else the one with most terms), objects, locations, concerns, risk, scenario,
    questions and evidence gaps.  ``disciplines`` maps a code to its ``terms``, ``objects`` and ``interfaces``.
    """
    from ..functions.strings import locations

    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda words: sum((body.contains(w).cast("int") for w in words), F.lit(0))
    codes = list(disciplines)
    scores = F.array(*[F.struct((-count(disciplines[c].get("terms", ()))).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("code")) for i, c in enumerate(codes)])
    stage = df.withColumn("_best", F.array_min(F.filter(scores, lambda s: s["n"] < 0)))
    given = discipline.isin(codes)
    stage = stage.withColumn("_code", F.when(given, discipline).otherwise(F.coalesce(F.col("_best.code"), F.lit("general"))))
    stage = stage.withColumn("_basis", F.when(given, "stated").when(F.col("_best").isNotNull(), "inferred").otherwise("default"))
    pick = lambda field: F.coalesce(*[F.when(F.col("_code") == c, F.array_compact(F.array(
        *[F.when(body.contains(w), F.lit(w)) for w in disciplines[c].get(field, ())] or [F.lit(None).cast("string")]))) for c in codes],
        F.array().cast("array<string>"))
    stage = stage.withColumn("_objects", pick("objects")).withColumn("_interfaces", pick("interfaces"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-count(ws)).alias("n"), F.lit(i).alias("i"), F.lit(label).alias("label"))
                                             for i, (label, ws) in enumerate(concerns.items())]), lambda s: s["n"] < 0))
    stage = stage.withColumn("_concerns", F.transform(F.slice(ranked, 1, top), lambda s: s["label"]))
    stage = stage.withColumn("_place", locations(F.col(text), patterns))
    conflict = F.size("_interfaces") >= 2
    stage = stage.withColumn("_risk", F.when(any_word(body, high_signals) | conflict, "high").when(any_word(body, medium_signals), "medium").otherwise("low"))
    scenario = F.lit("routine")
    for name, words in reversed(list(scenarios)):
        scenario = F.when(any_word(body, words), F.lit(name)).otherwise(scenario)
    stage = stage.withColumn("_scenario", scenario)
    placed = F.size(F.flatten(F.array(*[F.col(f"_place.{k}") for k in patterns]))) > 0
    gaps = F.array_compact(F.array(F.when(~placed, "location"), F.when(F.size("_concerns") == 0, "concern"), F.when(F.size("_objects") == 0, "object")))
    subject = F.coalesce(F.get("_objects", F.lit(0)), F.get("_concerns", F.lit(0)), F.lit("this item"))
    questions = F.array_compact(F.array(
        F.concat(F.lit("Which drawing governs "), subject, F.lit("?")), F.when(~placed, F.lit("Where exactly is it?")),
        F.when(conflict, F.concat(F.lit("Who decides between "), F.array_join("_interfaces", " and "), F.lit("?")))))
    return stage.select(key, F.struct(F.col("_code").alias("code"), F.col("_basis").alias("basis")).alias("discipline"),
                        F.col("_objects").alias("objects"), F.col("_place").alias("location"), F.col("_concerns").alias("concerns"),
                        F.col("_risk").alias("risk"), F.col("_scenario").alias("scenario"), questions.alias("questions"), gaps.alias("gaps"))
