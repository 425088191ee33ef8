"""Dashboard, cost, coverage and list aggregations (AGG)."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.aggs import rate, share_where
from .common import exact_sum, literal_table, null_safe_join
from .ordered import neighbour
from .quantiles import exact_quantiles, median_by


def funnel(df: DataFrame, status: str, amount: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("cnt"),
                                  F.coalesce(exact_sum(amount), F.lit(0)).cast("double").alias("total"))


def counts_where(df: DataFrame, keys: Sequence[str], **preds: Column) -> DataFrame:
    """Several conditional counts in one pass."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(p).alias(n) for n, p in preds.items()])


def kpi_breach(projects: DataFrame, proposals: DataFrame, key: str, output: str, saving: str, created: str,
               accepted: Column, since: str, min_output: float, min_saving: float) -> DataFrame:
    """Projects with large output whose saving since the date is under the line, incl. none at all."""
    year = (proposals.where(accepted & (F.col(created) >= F.lit(since).cast("timestamp")))
            .groupBy(key).agg(exact_sum(saving).alias("_s")))
    total = F.coalesce(F.col("_s"), F.lit(0)).cast("double")
    return (projects.where(F.col(output) >= min_output).join(year, key, "left")
            .where(total < min_saving).select(*projects.columns, total.alias("year_saving")))


def cost_by(df: DataFrame, engine: str, ts: str, now: str, days: int, tokens: Column, cost: Column, latency: str,
            ok: Column) -> DataFrame:
    recent = df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return recent.groupBy(engine).agg(
        F.count("*").alias("call_count"), F.sum(tokens).cast("long").alias("total_tokens"),
        F.sum(cost.cast("decimal(28,4)")).cast("double").alias("total_cost"),
        F.round(F.avg(latency)).alias("avg_latency"), F.count_if(~ok).alias("error_count"))


def cost_summary(calls: DataFrame, keys: Sequence[str], latency: str, prompt: str, completion: str, cost: Column,
                 ok: Column) -> DataFrame:
    """Calls, successes, mean and exact interpolated p95 latency, tokens and cost per group."""
    sums = [
        F.count("*").alias("total_calls"), F.count_if(ok).alias("success_calls"),
        F.round(F.avg(latency)).alias("avg_latency"), F.sum(prompt).cast("long").alias("prompt_tokens"),
        F.sum(completion).cast("long").alias("completion_tokens"),
        F.round(F.sum(cost.cast("decimal(28,6)")), 4).cast("double").alias("total_cost")]
    return exact_quantiles(calls, keys, latency, {"p95_latency": 0.95}, also=sums)


def daily(df: DataFrame, ts: str, key: str, now: str, days: int, cost: Column) -> DataFrame:
    recent = df.where(F.col(ts) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return recent.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), key).agg(
        F.sum(cost.cast("decimal(28,4)")).cast("double").alias("cost"), F.count("*").alias("calls"))


def layer_status(articles: DataFrame, book: str, mandatory: Column, graph_id: str, vector_id: str) -> DataFrame:
    """How far each layer of a book is: articles, mandatory, graphed, vectorized."""
    return articles.groupBy(book).agg(
        F.count("*").alias("total"), F.count_if(mandatory).alias("mandatory"), F.count(graph_id).alias("graphed"),
        F.count(vector_id).alias("vectored"), F.count_distinct(vector_id).alias("vectors"))


def label_summary(df: DataFrame, fine: Column, coarse: Column) -> DataFrame:
    return (df.groupBy(F.coalesce(fine, coarse).alias("label"))
            .agg(F.bool_or(fine.isNotNull()).alias("is_detail"), F.count("*").alias("cnt")))


def with_sources(df: DataFrame, keys: Sequence[str], source: str, page: int = 1000) -> DataFrame:
    """Distinct non-null sources of each group in pages of at most ``page`` ids, with totals.

    A group with more sources than a page gives more rows, so no row grows with the data.
    Pages are cut by hash, so all of this is partial aggregation.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("observations"), F.count_distinct(source).alias("sources"))
    ids = null_safe_join(df.where(F.col(source).isNotNull()).select(*keys, source).distinct(), counts, keys)
    n_pages = F.ceil(F.col("sources") / F.lit(page))
    paged = ids.groupBy(*keys, "observations", "sources", F.pmod(F.xxhash64(source), n_pages).alias("page")).agg(
        F.array_sort(F.collect_set(source)).alias("source_list"))
    empty = counts.where("sources = 0").select(
        *keys, "observations", "sources", F.lit(0).cast("long").alias("page"),
        F.array().cast(paged.schema["source_list"].dataType).alias("source_list"))
    return paged.select(*keys, "observations", "sources", "page", "source_list").unionByName(empty)


def facets(df: DataFrame, dims: Sequence[str], flag: Column) -> DataFrame:
    """Total, per-dimension and flagged counts: counted once by all dimensions, then added up over grouping sets."""
    sets = [[]] + [[F.col(x)] for x in dims]
    fine = df.groupBy(*dims).agg(F.count("*").alias("_n"), F.coalesce(F.sum(flag.cast("int")), F.lit(0)).alias("_flag"))
    grouped = (fine.groupingSets(sets, *[F.col(x) for x in dims])
               .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_flag"), F.lit(0)).cast("long").alias("flagged"),
                    *[F.grouping(x).alias(f"_g_{x}") for x in dims]))
    name, value = F.lit("total"), F.lit(None).cast("string")
    for x in dims:
        name = F.when(F.col(f"_g_{x}") == 0, F.lit(x)).otherwise(name)
        value = F.when(F.col(f"_g_{x}") == 0, F.col(x).cast("string")).otherwise(value)
    return grouped.select(name.alias("facet"), value.alias("value"), "n", "flagged")


def qto_rollup(df: DataFrame, dims: Sequence[str], gross: Column, net: Column, formwork: Column,
               estimated: Column) -> DataFrame:
    """Quantities for every prefix of ``dims`` (project, building, floor, type …): summed at the finest level, then rolled up.

    Sums are exact to ten places and rounded to four once.
    """
    exact = lambda c: F.sum(c.cast("decimal(28,10)"))
    fine = df.groupBy(*dims).agg(
        F.count("*").alias("elements"), exact(gross).alias("gross"), exact(net).alias("net"), exact(formwork).alias("formwork"),
        F.count_if(~estimated).alias("measured"), F.count_if(estimated).alias("estimated"), F.count_if(gross <= 0).alias("uncovered"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    money = lambda c: F.round(F.sum(c), 4).cast("double").alias(c)
    return fine.rollup(*dims).agg(
        F.grouping_id().cast("long").alias("level"), total("elements"), money("gross"), money("net"), money("formwork"),
        total("measured"), total("estimated"), total("uncovered"))


# Actions that mean rework, name of the bucket without a label.
REWORK_ACTIONS = ("reclass", "reject", "addbox")
UNLABELED = "unlabeled"


def rework_rate(df: DataFrame, action: str, by: str) -> DataFrame:
    kind = F.col(action)
    label = F.coalesce(F.when(F.col(by) != "", F.col(by)), F.lit(UNLABELED))
    return df.groupBy(label.alias("label")).agg(
        F.count("*").alias("total"), F.count_if(kind.isin(*REWORK_ACTIONS)).alias("rework"),
        share_where(kind.isin(*REWORK_ACTIONS)).alias("rework_rate"), share_where(kind == "confirm").alias("confirm_rate"),
        share_where(kind == "reclass").alias("reclass_rate"), share_where(kind == "reject").alias("reject_rate"),
        share_where(kind == "addbox").alias("addbox_rate"))


def rework_trend(df: DataFrame, action: str, ts: str) -> DataFrame:
    return (df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("period"))
            .agg(share_where(F.col(action).isin(*REWORK_ACTIONS)).alias("rework_rate"), F.count("*").alias("cnt"))
            .orderBy("period"))


def first_to_first(a: DataFrame, b: DataFrame, key: str, ts: str) -> DataFrame:
    """Median hours from the first A to the first B of a project; negatives dropped, null without sample."""
    pairs = a.groupBy(key).agg(F.min(ts).alias("_a")).join(b.groupBy(key).agg(F.min(ts).alias("_b")), key)
    hours = (F.unix_micros("_b") - F.unix_micros("_a")) / 3.6e9
    spans = pairs.select(hours.alias("_h")).where("_h >= 0")
    result = median_by(spans, [], "_h", "median_hours", "sample_size")
    empty = a.sparkSession.range(1).select()
    return empty.join(result, F.lit(True), "left").select(
        F.round("median_hours", 2).alias("median_hours"), F.coalesce("sample_size", F.lit(0)).alias("sample_size"))


def adoption(df: DataFrame, kind: str, status: str) -> DataFrame:
    """accepted / (accepted + dismissed) per kind; open ones do not count; null when none is resolved."""
    yes, no = F.count_if(F.col(status) == "accepted"), F.count_if(F.col(status) == "dismissed")
    return df.groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(
        yes.alias("accepted"), no.alias("dismissed"), rate(yes, yes + no, 4, None).alias("rate"))


def coverage(everything: DataFrame, status: DataFrame, key: str, group: str) -> DataFrame:
    """Ready / failed / untouched against all members; a percentage is a whole number."""
    rows = everything.select(key, group).join(status.select(key, "status", "error"), key, "left")
    counted = rows.groupBy(group).agg(
        F.count("*").alias("total"), F.count("status").alias("with_status"),
        F.count_if(F.col("status") == "ready").alias("ready"), F.count("error").alias("failed"))
    return counted.select(
        "*", (F.col("total") - F.col("with_status")).alias("unprocessed"),
        F.bround(F.col("ready") * 100 / F.col("total"), 0).cast("long").alias("percent"),
        F.bround(F.col("with_status") * 100 / F.col("total"), 0).cast("long").alias("processed_percent"))


def conf_stats(df: DataFrame, key: str, conf: str) -> DataFrame:
    stats = df.groupBy(key).agg(F.count(conf).alias("cnt"), F.avg(conf).alias("mean"), F.min(conf).alias("min"),
                                F.max(conf).alias("max"))
    return null_safe_join(stats, median_by(df, [key], conf, "median"), [key], "left")


def calibration(df: DataFrame, keys: Sequence[str], conf: str, hit: Column) -> DataFrame:
    """Point-biserial correlation of confidence and hit, null when either does not vary."""
    sample = df.withColumn("_hit", hit.cast("double"))
    varies = (F.min(conf) < F.max(conf)) & (F.min("_hit") < F.max("_hit"))
    return sample.groupBy(*keys).agg(F.count("*").alias("n"), F.when(varies, F.corr(conf, "_hit")).alias("corr"))


# Fixed value: projects needed before a pattern's lift is trusted.
MIN_RELIABLE_PROJECTS = 5


def lift(df: DataFrame, text: str, patterns: Mapping[str, str], cost: Column, project: str,
         min_projects: int = MIN_RELIABLE_PROJECTS) -> DataFrame:
    """Lines per pattern, cost rate ÷ base rate, project coverage; all patterns and the base in one pass."""
    names = F.array_compact(F.array(F.lit("*"), *[F.when(F.col(text).rlike(p), F.lit(n)) for n, p in patterns.items()]))
    hits = df.select(F.explode(names).alias("pattern"), cost.cast("int").alias("_cost"), F.col(project).alias("_p"))
    table = hits.groupBy("pattern").agg(F.count("*").alias("lines"), F.avg("_cost").alias("cost_rate"),
                                        F.count_distinct("_p").alias("projects"))
    base = table.where("pattern = '*'").select(F.col("cost_rate").alias("_base"))
    return (null_safe_join(table.where("pattern <> '*'"), base, [])
            .select("pattern", "lines", "cost_rate", F.try_divide("cost_rate", "_base").alias("lift"), "projects",
                    (F.col("projects") >= min_projects).alias("reliable")))


def normal_line(col: Column) -> Column:
    """Line without digits, punctuation and space: the form in which recurring lines meet."""
    return F.regexp_replace(F.lower(col), r"[0-9\s.,;:!?()\[\]|\-]+", "")


def recurring(df: DataFrame, project: str, date: str, line: str, min_length: int = 6) -> DataFrame:
    """Distinct lines per project, and how many are seen on at least two and three dates."""
    rows = df.select(project, date, normal_line(F.col(line)).alias("_l")).where(F.length("_l") >= min_length)
    spread = rows.groupBy(project, "_l").agg(F.count_distinct(date).alias("_n"))
    return spread.groupBy(project).agg(F.count("*").alias("lines"), F.count_if(F.col("_n") >= 2).alias("on_2_dates"),
                                       F.count_if(F.col("_n") >= 3).alias("on_3_dates"))


def duplicates(df: DataFrame, number: str, version: str) -> DataFrame:
    """Numbers held by several rows; several versions are a conflict. Versions are letters, a small set."""
    filled = F.when(F.col(version) != "", F.col(version))
    return (df.groupBy(number).agg(F.count("*").alias("copies"), F.array_sort(F.collect_set(filled)).alias("versions"))
            .where("copies > 1").withColumn("conflict", F.size("versions") > 1))


def location_key(levels: Column, axes: Column) -> Column:
    """Sorted levels and axes joined; null when both are empty."""
    lv, ax = F.coalesce(levels, F.array().cast("array<string>")), F.coalesce(axes, F.array().cast("array<string>"))
    return F.when((F.size(lv) > 0) | (F.size(ax) > 0), F.concat(
        F.array_join(F.array_sort(lv), "|"), F.lit("@"), F.array_join(F.array_sort(ax), "|")))


def clusters(df: DataFrame, key: Column, drawing: str, discipline: str, min_drawings: int = 2) -> DataFrame:
    """Issues that share a location over several drawings (members: join back on location_key)."""
    return (df.withColumn("location_key", key).where("location_key is not null").groupBy("location_key")
            .agg(F.count("*").alias("cnt"), F.count_distinct(drawing).alias("drawings"),
                 F.array_sort(F.collect_set(discipline)).alias("disciplines"))
            .where(F.col("drawings") >= min_drawings))


def top_objects(df: DataFrame, json_col: str, path: str) -> DataFrame:
    """Names of nested objects by count."""
    items = F.from_json(F.get_json_object(json_col, path), "array<struct<name:string>>")
    return (df.select(F.explode(items).alias("_o")).where("_o.name is not null and _o.name <> ''")
            .groupBy(F.col("_o.name").alias("name")).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "name"))


def distribution(df: DataFrame, col: str, bins: Sequence[str]) -> DataFrame:
    """Counts over a fixed list of bins, zeros included."""
    fixed = literal_table(df.sparkSession, [(i, b) for i, b in enumerate(bins)], f"rank int, {col} string")
    counts = df.where(F.col(col).isin(list(bins))).groupBy(col).agg(F.count("*").alias("_n"))
    return F.broadcast(fixed).join(counts, col, "left").select("rank", col, F.coalesce("_n", F.lit(0)).alias("n"))


def engine_map(issues: DataFrame, key: str, engine: str) -> DataFrame:
    """Per report a map engine → issue count (engines are a fixed list)."""
    counts = issues.groupBy(key, engine).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(engine, "_n")))).alias("engines"),
        F.sum("_n").alias("total"))


def mark_index(df: DataFrame, text: Column, pattern: str, drawing: str, floor: str) -> DataFrame:
    """Component mark → drawings and floors that show it, wide-spread marks first.

    Counts instead of lists: the member lists are the (mark, drawing) rows of ``mark_rows``.
    """
    return (mark_rows(df, text, pattern, drawing, floor).groupBy("mark")
            .agg(F.count_distinct(drawing).alias("drawing_count"), F.count_distinct(floor).alias("floor_count"))
            .orderBy(F.desc("drawing_count"), "mark"))


def mark_rows(df: DataFrame, text: Column, pattern: str, drawing: str, floor: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return df.select(drawing, floor, F.explode(found).alias("mark")).distinct()


def steel_demand(df: DataFrame, diameter: str, grade: str, length_mm: str, count: str, rates: Sequence[tuple[int, float]],
                 target_rate: float, price_per_ton: float) -> DataFrame:
    """Steel weight per diameter and grade (d²/162 kg per metre), site waste against a target rate.

    ``rates``: (largest diameter, waste rate) rising; waste = length · r / (1 − r).
    """
    field = F.lit(rates[-1][1])
    for top, value in reversed(list(rates[:-1])):
        field = F.when(F.col(diameter) <= top, F.lit(value)).otherwise(field)
    kg = F.col(diameter) * F.col(diameter) / 162.0 / 1000.0
    sums = df.groupBy(diameter, grade).agg(
        F.sum(F.col(count)).cast("long").alias("pieces"),
        F.sum((F.col(length_mm) * F.col(count)).cast("decimal(28,2)")).cast("double").alias("length"))
    field_mm = F.col("length") * field / (1 - field)
    target_mm = F.col("length") * target_rate / (1 - target_rate)
    saving = F.greatest((field_mm - target_mm) * kg, F.lit(0.0))
    return sums.select(diameter, grade, "pieces", F.round("length", 2).alias("length_mm"),
                       F.round(F.col("length") * kg, 2).alias("steel_kg"), F.round(field_mm * kg, 2).alias("field_waste_kg"),
                       F.round(saving, 2).alias("saving_kg"), F.round(saving / 1000 * price_per_ton, 2).alias("saving_cost"))


def task_counts(sources: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(key, severity, pending rows) → one board row each, high severity and large counts first."""
    rows = [df.agg(F.count("*").alias("cnt")).select(F.lit(k).alias("task"), F.lit(s).alias("severity"), "cnt")
            for k, s, df in sources]
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return reduce(lambda a, b: a.unionByName(b), rows).orderBy(rank, F.desc("cnt"))


def eta(jobs: DataFrame, history: DataFrame, key: str, size_kb: str, took_ms: str, order: Sequence[Column],
        recent: int = 20) -> DataFrame:
    """Expected seconds from the mean of recent runs, else from the size."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    mean = (history.withColumn("_r", rank).where(F.col("_r") <= recent).groupBy(key)
            .agg(F.floor(F.avg(took_ms)).alias("_ms")))
    clamp = lambda c, low: F.greatest(F.lit(low), F.least(F.lit(900), c)).cast("long")
    size_mb = F.greatest(F.lit(1), F.floor(F.coalesce(size_kb, F.lit(0)) / 1024))
    return jobs.join(mean, key, "left").select(
        *jobs.columns, F.when(F.col("_ms") > 0, clamp(F.floor(F.col("_ms") / 1000 * 1.25), 45))
        .otherwise(clamp(90 + size_mb * 6, 90)).alias("eta_seconds"))


def reason_summary(df: DataFrame, keys: Sequence[str], reason: str, not_applicable: Sequence[str],
                   actionable: Sequence[str]) -> DataFrame:
    """Totals with "does not apply" kept apart from "failed"."""
    col = F.col(reason)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(col.isNull()).alias("assigned"),
        F.count_if(col.isin(*not_applicable)).alias("not_applicable"), F.count_if(col.isin(*actionable)).alias("actionable"))


def scale_from_spacing(df: DataFrame, keys: Sequence[str], direction: str, pos: str, spacing_mm: str, tie: str,
                       page_height: float) -> DataFrame:
    """Scale from stated spacing over drawn spacing: middle sample, sample count, spread."""
    prev = neighbour(df, [*keys, direction], [pos, tie], {"_prev": pos}, -1)
    drawn = F.abs(F.col(pos) - F.col("_prev")) * page_height
    samples = (prev.where(F.col("_prev").isNotNull() & (F.col(spacing_mm) > 0)).withColumn("_d", drawn)
               .where("_d > 1e-6").withColumn("_s", F.col(spacing_mm) / 1000.0 / F.col("_d")))
    middle = exact_quantiles(samples, keys, "_s", {"scale": 0.5}, method="index")
    ends = samples.groupBy(*keys).agg(F.count("*").alias("samples"), (F.max("_s") - F.min("_s")).alias("_range"))
    return null_safe_join(middle, ends, keys).select(
        *keys, F.round("scale", 8).alias("scale"), "samples",
        F.round(F.coalesce(F.try_divide("_range", "scale"), F.lit(0.0)), 4).alias("spread"))


def distinct_counts(df: DataFrame, keys: Sequence[str], approximate: bool = False, **cols: str) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(*[fn(c).alias(n) for n, c in cols.items()])
