"""Labelled data and evaluation (EVL)."""

from __future__ import annotations

from bisect import bisect_left
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggs import rate
from ..functions.strings import norm_ref
from .matching import one_to_one
from .ordered import running


def split_groups(df: DataFrame, project: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """train/val/test per project: no project in two splits, the same seed gives the same split.

    Projects are ordered by a seeded hash and cut where the running sample count passes the ratios;
    the running sum goes part by part of the order.
    """
    total_ratio = float(sum(ratios))
    sizes = df.groupBy(project).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), project)))
    summed = running(sizes, [], ["_h"], F.col("_n"), "_before", before=True)
    total = sizes.agg(F.sum("_n").alias("_all")).withColumn("_k", F.lit(0))
    at = (F.col("_before") + F.col("_n") / 2) / F.col("_all")
    named = summed.withColumn("_k", F.lit(0)).join(F.broadcast(total), "_k").withColumn(
        "split", F.when(at <= ratios[0] / total_ratio, "train").when(at <= (ratios[0] + ratios[1]) / total_ratio, "val").otherwise("test"))
    return df.join(named.select(project, "split"), project)


def leaks(df: DataFrame, project: str, split: str = "split") -> DataFrame:
    return df.groupBy(project).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def split_stats(df: DataFrame, project: str, cls: str, classes: Sequence[str], split: str = "split") -> DataFrame:
    """Projects, samples and class counts per split (classes given, so no pass to find them)."""
    return df.groupBy(split).agg(F.count_distinct(project).alias("projects"), F.count("*").alias("samples"),
                                 *[F.count_if(F.col(cls) == c).alias(f"class_{c}") for c in classes])


def weak_label(df: DataFrame, layer: str, block: str, rules: Sequence[Mapping]) -> DataFrame:
    """Class from layer and block names: aliases, then the block's prefix or part, then the layer's.

    A rule has ``kind`` and any of ``aliases``, ``prefixes``, ``substrings``, ``patterns``.
    """
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    names = {"layer": up(F.col(layer)), "block": up(F.col(block))}
    tests = {"aliases": lambda c, vs: c.isin([v.upper() for v in vs]), "prefixes": lambda c, vs: _any(c.startswith(v.upper()) for v in vs),
             "parts": lambda c, vs: _any(c.contains(v.upper()) for v in vs), "patterns": lambda c, vs: _any(c.rlike("(?i)" + v) for v in vs)}
    steps = [("layer", "aliases"), ("block", "aliases"), ("block", "prefixes"), ("block", "parts"), ("layer", "prefixes"), ("layer", "parts")]
    found, source = F.lit(None).cast("string"), F.lit("none")
    for where, test in reversed(steps):
        for rule in reversed(rules):
            hit = F.lit(False)
            if test == "parts":
                hit = tests["parts"](names[where], rule.get("substrings", ())) | tests["patterns"](names[where], rule.get("patterns", ()))
            elif rule.get(test):
                hit = tests[test](names[where], rule[test])
            hit = hit & (names[where] != "")
            found, source = F.when(hit, F.lit(rule["kind"])).otherwise(found), F.when(hit, F.lit(where)).otherwise(source)
    return df.withColumn("label", found).withColumn("label_source", source)


def _any(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def weak_label_report(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "label_source").agg(F.count("*").alias("n"))


# What a gold note may say, and its defaults.
SEVERITIES, OBLIGATIONS = ("critical", "major", "minor", "info"), ("MUST", "MUST_NOT", "SHOULD", "MAY")


def gold(actions: DataFrame, keys: Sequence[str], target: str, action: str, note: str, order: Sequence[str]) -> DataFrame:
    """Latest action per target; a reject removes it; broken or odd notes fall back to the defaults."""
    latest = (actions.where(F.col(target).isNotNull() & (F.col(target).cast("string") != "")).groupBy(*keys, target)
              .agg(F.max_by(F.struct(F.col(action).alias("action"), F.col(note).alias("note")), F.struct(*order)).alias("_l")))
    text = lambda f: F.try_variant_get(F.try_parse_json(F.col("_l.note")), f"$.{f}", "string")
    severity, level = F.lower(F.coalesce(text("severity"), F.lit("major"))), F.upper(F.coalesce(text("obligation_level"), F.lit("SHOULD")))
    return latest.where("_l.action <> 'reject'").select(
        *keys, norm_ref(F.col(target).cast("string")).alias("ref"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise("major").alias("severity"),
        F.when(level.isin(*OBLIGATIONS), level).otherwise("SHOULD").alias("obligation_level"), F.coalesce(text("snippet"), F.lit("")).alias("snippet"))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = rate(tp, tp + fp, 6), rate(tp, tp + fn, 6)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
            rate(2 * tp, 2 * tp + fp + fn, 4).alias("f1")]


def outcome(gt: DataFrame, pred: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Gold (keys, gt_class) and predictions (keys, pred_class) side by side, one row per key."""
    return gt.join(pred, [*keys, *extra], "full")


def prf(gt: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 per class and overall (class ``*``)."""
    both = outcome(gt, pred, keys)
    hit = F.coalesce(F.col("gt_class") == F.col("pred_class"), F.lit(False))
    marks = F.array_compact(F.array(
        F.when(hit, F.struct(F.col("gt_class").alias("cls"), F.lit("tp").alias("m"))),
        F.when(~hit & F.col("pred_class").isNotNull(), F.struct(F.col("pred_class").alias("cls"), F.lit("fp").alias("m"))),
        F.when(~hit & F.col("gt_class").isNotNull(), F.struct(F.col("gt_class").alias("cls"), F.lit("fn").alias("m")))))
    counted = both.select(F.explode(marks).alias("_m")).select("_m.cls", "_m.m").rollup("cls").agg(
        *[F.count_if(F.col("m") == m).alias(f"_{m}") for m in ("tp", "fp", "fn")])
    return counted.select(F.coalesce("cls", F.lit("*")).alias("cls"), *_scores(F.col("_tp"), F.col("_fp"), F.col("_fn")))


def panoptic(matches: DataFrame, n_gt: DataFrame, n_pred: DataFrame, key: str) -> DataFrame:
    """SQ (mean IoU of matches), RQ and PQ per key from ``pair_boxes`` output; counts: key, n."""
    hits = matches.groupBy(key).agg(F.count("*").alias("_tp"), F.sum("iou").alias("_iou"))
    rows = n_gt.select(key, F.col("n").alias("_g")).join(n_pred.select(key, F.col("n").alias("_p")), key, "full").join(hits, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tp, fp, fn = zero("_tp"), zero("_p") - zero("_tp"), zero("_g") - zero("_tp")
    sq, rq = F.coalesce(F.try_divide("_iou", tp), F.lit(0.0)), F.coalesce(F.try_divide(tp.cast("double"), tp + 0.5 * fp + 0.5 * fn), F.lit(0.0))
    return rows.select(key, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(sq, 6).alias("sq"), F.round(rq, 6).alias("rq"), F.round(sq * rq, 6).alias("pq"))


def confusion(gt: DataFrame, pred: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """True × predicted with missed and spurious ones; one column per class."""
    both = outcome(gt, pred, keys).select(F.coalesce("gt_class", F.lit("__spurious__")).alias("gt_class"),
                                          F.coalesce("pred_class", F.lit("__missed__")).alias("_p"))
    return both.groupBy("gt_class").agg(*[F.count_if(F.col("_p") == c).alias(f"pred_{c}") for c in [*classes, "__missed__"]])


def micro(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum tp, fp, fn over samples, then take the ratios."""
    sums = df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in ("tp", "fp", "fn")], F.count("*").alias("samples"))
    return sums.select(*keys, *_scores(F.col("_tp"), F.col("_fp"), F.col("_fn")), "samples")


def compare(predictions: DataFrame, gt: DataFrame, keys: Sequence[str], method: str, methods: Sequence[str]) -> DataFrame:
    """Every method against one gold set; a method without predictions still owes all of the gold."""
    owed = gt.withColumn(method, F.explode(F.array(*[F.lit(m) for m in methods])))
    both = owed.join(predictions, [*keys, method], "full")
    hit = F.coalesce(F.col("gt_class") == F.col("pred_class"), F.lit(False))
    counted = both.groupBy(method).agg(
        F.count_if(hit).alias("_tp"), F.count_if(~hit & F.col("pred_class").isNotNull()).alias("_fp"), F.count_if(~hit & F.col("gt_class").isNotNull()).alias("_fn"))
    return counted.select(method, *_scores(F.col("_tp"), F.col("_fp"), F.col("_fn")))


def match_values(pred: DataFrame, gold_values: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Predictions in falling confidence take the nearest free gold value within the tolerance.

    ``pred``: keys, pred_id, value, confidence; ``gold_values``: keys, gold_id, gold.  Values meet by
    cells of tolerance width; predictions, as a rule the fewer, go to three of them.
    """
    near = pred.withColumn("_c", F.explode(F.array(*[F.floor(F.col("value") / tol) + i for i in (-1, 0, 1)])))
    pairs = (near.join(gold_values.withColumn("_c", F.floor(F.col("gold") / tol)), [*keys, "_c"])
             .withColumn("gap", F.abs(F.col("value") - F.col("gold"))).where(F.col("gap") <= tol).drop("_c"))
    return one_to_one(pairs, [*keys, "pred_id"], [*keys, "gold_id"], F.struct("gap", "gold_id"), F.struct((-F.col("confidence")).alias("c"), "pred_id"))


@F.arrow_udf(T.DoubleType())
def _lcs_share(found: pa.Array, wanted: pa.Array) -> pa.Array:
    """Items become Python objects a row at a time: a batch of long lists would hold many times its bytes."""
    out = []
    for a, b in zip(found, wanted):
        if not b.is_valid or len(b.values) == 0 or not a.is_valid:
            out.append(None)
            continue
        a, b = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
        known = set(b)
        a = [x for x in a if x in known]
        if not a:
            out.append(None)
            continue
        if len(known) == len(b):  # of distinct items a longest common subsequence is a longest rising run of their places
            place, ends = {x: i for i, x in enumerate(b)}, []
            for at in map(place.__getitem__, a):
                i = bisect_left(ends, at)
                ends[i:i + 1] = [at]
            out.append(len(ends) / len(b))
            continue
        row = np.zeros(len(b) + 1, dtype=np.int64)
        goal = np.array(list(b), dtype=object)
        for item in a:
            best = np.maximum(row[1:], np.where(goal == item, row[:-1] + 1, 0))
            row[1:] = np.maximum.accumulate(best)
        out.append(float(row[-1]) / len(b))
    return pa.array(out, pa.float64())


def order_fidelity(df: DataFrame, found: str, wanted: str) -> DataFrame:
    """Longest common subsequence of the hits with the gold order, over the gold length; null when undecidable."""
    return df.withColumn("fidelity", _lcs_share(found, wanted))


# Arbitration policy.
STRONG_RULE, MODEL_MIN, AGREEMENT_BOOST, PRIORITY_GAIN, DEFAULT_PRIORITY = 0.85, 0.45, 0.10, 0.20, 5
RULE_PRIORITY = {"column": 10, "beam": 9, "slab": 8, "wall": 8, "door": 6, "window": 6, "pipe": 5, "equipment": 5, "axis": 4}


def arbitrate(pairs: DataFrame, priority: Mapping[str, int] = RULE_PRIORITY) -> DataFrame:
    """Paired candidates (rule_class, rule_conf, model_class, model_conf): same class agrees and gains, a strong
    rule stands, else the model wins only with enough confidence above the rule's weighted score."""
    rank = F.lit(DEFAULT_PRIORITY)
    for name, value in priority.items():
        rank = F.when(F.col("rule_class") == name, value).otherwise(rank)
    top = max([*priority.values(), DEFAULT_PRIORITY])
    same, strong = F.col("rule_class") == F.col("model_class"), F.col("rule_conf") >= STRONG_RULE
    model = (F.col("model_conf") >= MODEL_MIN) & (F.col("model_conf") > F.col("rule_conf") + PRIORITY_GAIN * (rank / top))
    decision = F.when(same, "consensus").when(strong, "rule_protected").when(model, "model_override").otherwise("rule_wins")
    return (pairs.withColumn("decision", decision)
            .withColumn("final_class", F.when(F.col("decision") == "model_override", F.col("model_class")).otherwise(F.col("rule_class")))
            .withColumn("final_conf", F.when(same, F.least(F.greatest("rule_conf", "model_conf") + AGREEMENT_BOOST, F.lit(1.0)))
                        .when(F.col("decision") == "model_override", F.col("model_conf")).otherwise(F.col("rule_conf"))))


MIN_TILE_KEEP = 0.5


def tiles(df: DataFrame, page_w: int, page_h: int, tile: int, overlap: int) -> DataFrame:
    """Boxes (cx, cy, w, h as page shares) to the overlapping tiles that hold their centre, clipped and
    normalized to the tile; a box cut to less than half its area is left out."""
    step, out, left = max(1, tile - overlap), df, F.lit(1.0)
    cut: dict[str, Column] = {}
    for axis, page, centre, extent in (("x", page_w, "cx", "w"), ("y", page_h, "cy", "h")):
        last = max(0, -(-(page - tile) // step))  # index of the last tile
        at, half = F.col(centre) * page, F.col(extent) * page / 2
        low = F.greatest(F.lit(0), F.least(F.lit(last), F.ceil((at - tile) / step)))
        high = F.least(F.lit(last), F.greatest(F.lit(0), F.floor(at / step)))
        out = out.where(at.between(0, page)).where(low <= high).withColumn(f"t{axis}", F.explode(F.sequence(low, high)))
        start = F.col(f"t{axis}") * step
        stop = F.least(start + tile, F.lit(page))
        head, tail = F.greatest(at - half, start), F.least(at + half, stop)  # what of the box lies inside, on this axis
        left = left * (tail - head)
        cut[centre], cut[extent] = ((head + tail) / 2 - start) / (stop - start), (tail - head) / (stop - start)
    whole = F.greatest(F.col("w") * page_w * (F.col("h") * page_h), F.lit(1e-9))
    kept = out.where((left > 0) & (left >= MIN_TILE_KEEP * whole))
    rest = [c for c in df.columns if c not in cut]
    return kept.select(*rest, "tx", "ty", *[c.alias(n) for n, c in cut.items()])


def acceptance(entities: DataFrame, bom: DataFrame, key: str) -> DataFrame:
    """Per type: vertical-reality, location and confirmed rates, and count accuracy against the bill (null without one).

    ``entities``: key, z_source, grid_ref, review_state; ``bom``: key, expected.
    """
    real = F.col("z_source").isNotNull() & (F.col("z_source") != "story_default")
    rates = entities.groupBy(key).agg(
        F.count("*").alias("total"), rate(F.count_if(real), F.count("*")).alias("vertical_rate"),
        rate(F.count("grid_ref"), F.count("*")).alias("location_rate"), rate(F.count_if(F.col("review_state") == "confirmed"), F.count("*")).alias("confirmed_rate"))
    joined = rates.join(bom.select(key, "expected"), key, "full")
    actual = F.coalesce("total", F.lit(0))
    accuracy = F.when(F.col("expected") > 0, F.round(1 - F.abs(F.col("expected") - actual) / F.col("expected"), 4))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return joined.select(key, actual.alias("total"), zero("vertical_rate"), zero("location_rate"), zero("confirmed_rate"), accuracy.alias("count_accuracy"))
