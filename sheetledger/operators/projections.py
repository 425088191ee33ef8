"""Projections, filters and predicates (PRJ)."""

from __future__ import annotations

import string
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_of, any_of

# Severity and status vocabularies.
ENGINE_SEVERITY = {"critical": "critical", "major": "high", "minor": "medium", "info": "low"}
SYMBOL_STATUS = {"pending": "pending", "confirmed": "remediated", "rejected": "closed", "reclassed": "remediated"}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def where_all(df: DataFrame, **conds: Any) -> DataFrame:
    """Conjunction of the given, non-null arguments; a list means membership."""
    for name, wanted in conds.items():
        if wanted is None:
            continue
        df = df.where(F.col(name).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(name) == wanted)
    return df


def search(df: DataFrame, q: str, cols: Sequence[str]) -> DataFrame:
    """Case-insensitive substring over several columns; signs in ``q`` are literal."""
    escaped = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(any_of([F.col(c).ilike(f"%{escaped}%") for c in cols]))


def map_values(col: Column, mapping: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for code, value in reversed(list(mapping.items())):
        out = F.when(col == code, F.lit(value)).otherwise(out)
    return out


def severity_of(conf: Column, conflict: Column | None = None) -> Column:
    graded = (F.when(conf.isNull(), "medium").when(conf < 0.5, "high").when(conf < 0.8, "medium").otherwise("low"))
    return graded if conflict is None else F.when(F.coalesce(conflict, F.lit(False)), "high").otherwise(graded)


def has_saving(severity: Column, text: Column, words: Sequence[str]) -> Column:
    """High severity and any keyword hit."""
    return severity.isin("critical", "high") & any_of([F.coalesce(text, F.lit("")).contains(w) for w in words])


def coalesce_label(fine: Column, coarse: Column) -> Column:
    return F.coalesce(fine, coarse)


def in_range(col: Column, low: float, high: float) -> Column:
    """True only for a present value inside the range."""
    return F.coalesce(col.between(low, high), F.lit(False))


# One paper point in metres, legal scale denominators, confidence floor.
POINT_METRES = 0.0254 / 72
MIN_DENOMINATOR, MAX_DENOMINATOR, MIN_TRANSFORM_CONFIDENCE = 20.0, 2000.0, 0.5


def trusted(scale_m_pt: Column, conf: Column, low: float = MIN_DENOMINATOR, high: float = MAX_DENOMINATOR,
            floor: float = MIN_TRANSFORM_CONFIDENCE) -> Column:
    """Scale denominator in the legal range and confidence high enough; unknown never passes."""
    return in_range(scale_m_pt / POINT_METRES, low, high) & F.coalesce(conf >= floor, F.lit(False))


def min_conf(df: DataFrame, floor: float, conf: str = "confidence") -> DataFrame:
    return df.where(F.col(conf) >= floor)


def min_conf_audit(df: DataFrame, keys: Sequence[str], floor: float, conf: str = "confidence") -> DataFrame:
    """What the floor keeps and drops, per group."""
    ok = F.coalesce(F.col(conf) >= floor, F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def with_reason(df: DataFrame, ladder: Sequence[tuple[str, Column]], alias: str = "reason") -> DataFrame:
    """First matching exclusion reason, null = keep."""
    out = F.lit(None).cast("string")
    for reason, cond in reversed(list(ladder)):
        out = F.when(cond, F.lit(reason)).otherwise(out)
    return df.withColumn(alias, out)


def fill_from(primary: DataFrame, secondary: DataFrame, keys: Sequence[str], cols: Sequence[str],
              missing: Column, usable: Column) -> DataFrame:
    """Take an item whole from the second layer, only where the first has none."""
    second = secondary.where(usable).select(*keys, F.struct(*cols).alias("_second"))
    joined = primary.join(second, list(keys), "left")
    fill = missing & F.col("_second").isNotNull()
    chosen = F.when(fill, F.col("_second")).otherwise(F.struct(*cols))
    rest = [c for c in primary.columns if c not in cols]
    return joined.select(*rest, *[chosen[c].alias(c) for c in cols],
                         F.when(fill, "secondary").otherwise("primary").alias("layer"))


def resolve_params(projects: DataFrame, settings: DataFrame, defaults: DataFrame, project: str = "project_id"
                   ) -> DataFrame:
    """Project value over global value over schema default.

    ``defaults`` (key, value) is the declared schema, fixed in size, hence the broadcast.
    """
    schema = F.broadcast(defaults.select("key", F.col("value").alias("_default")))
    own = settings.where(F.col(project).isNotNull()).select(project, "key", F.col("value").alias("_own"))
    shared = settings.where(F.col(project).isNull()).select("key", F.col("value").alias("_global"))
    full = projects.select(project).withColumn("_one", F.lit(1)).join(
        schema.join(shared, "key", "left").withColumn("_one", F.lit(1)), "_one").drop("_one")
    return full.join(own, [project, "key"], "left").select(
        project, "key", F.coalesce("_own", "_global", "_default").alias("value"),
        F.when(F.col("_own").isNotNull(), "project").when(F.col("_global").isNotNull(), "global")
        .otherwise("default").alias("scope"))


# ---- declarative rules ---------------------------------------------------------------

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _blank(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(True)
    col, kind = F.col(field), df.schema[field].dataType
    if isinstance(kind, _NUMERIC):
        return col.isNull() | (col == 0)
    if isinstance(kind, T.BooleanType):
        return col.isNull() | ~col
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull() | (col.cast("string") == "")


def _text(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit("")
    return F.when(_blank(df, field), "").otherwise(F.col(field).cast("string"))


def _as_written(df: DataFrame, field: str) -> Column:
    """Text of a value in comparisons; an absent value reads ``None``."""
    return F.coalesce(F.col(field).cast("string"), F.lit("None")) if field in df.columns else F.lit("None")


def condition(df: DataFrame, cond: Mapping[str, Any]) -> Column:
    """Compile one rule condition; an unknown kind never fires."""
    kind, field = cond.get("type", ""), cond.get("field", "")
    if kind in ("and", "or"):
        parts = [condition(df, c) for c in cond.get("conditions", [])]
        return all_of(parts) if kind == "and" else any_of(parts)
    if kind in ("empty", "not_empty"):
        return _blank(df, field) if kind == "empty" else ~_blank(df, field)
    if kind == "regex":
        found = _text(df, field).rlike("(?im)" + cond["pattern"])
        return ~found if cond.get("negate", True) else found
    if kind in ("in", "not_in"):
        found = _as_written(df, field).isin([str(v) for v in cond.get("values", [])])
        return found if kind == "in" else ~found
    if kind == "contains":
        text, part = _text(df, field), str(cond.get("value", ""))
        found = text.contains(part) if cond.get("case_sensitive", False) else F.lower(text).contains(part.lower())
        return ~found if cond.get("negate", False) else found
    if kind in ("gte", "gt", "lte", "lt"):
        value = F.coalesce(F.col(field).try_cast("double"), F.lit(0.0)) if field in df.columns else F.lit(0.0)
        bound = float(cond["value"])
        return {"gte": value >= bound, "gt": value > bound, "lte": value <= bound, "lt": value < bound}[kind]
    if kind in ("eq", "neq"):
        same = _as_written(df, field) == str(cond["value"])
        return same if kind == "eq" else ~same
    return F.lit(False)


def fmt(df: DataFrame, template: str) -> Column:
    """Fill ``{field}`` marks; the template stays as it is when a field is unknown."""
    try:
        parts = list(string.Formatter().parse(template))
    except ValueError:
        return F.lit(template)
    pieces: list[Column] = []
    for text, field, spec, _ in parts:
        if text:
            pieces.append(F.lit(text))
        if field is not None:
            if field not in df.columns or spec:
                return F.lit(template)
            pieces.append(_text(df, field))
    return F.concat(*pieces) if pieces else F.lit("")


def apply_rules(df: DataFrame, rules: Sequence[Mapping[str, Any]], keys: Sequence[str]) -> DataFrame:
    """One row per fired rule; every rule is evaluated in the same pass over the data."""
    fired = []
    for rule in rules:
        fired.append(F.when(condition(df, rule.get("condition", {})), F.struct(
            F.lit(rule.get("id", "")).alias("rule_id"),
            F.lit(rule["severity"] if rule.get("severity") in RULE_SEVERITIES else "info").alias("severity"),
            F.lit(rule.get("category", "")).alias("category"),
            fmt(df, rule.get("message", rule.get("name", ""))).alias("message"),
            fmt(df, rule.get("suggestion", "")).alias("suggestion"),
            F.lit(rule.get("regulation_ref", "")).alias("regulation_ref"))))
    hits = F.filter(F.array(*fired), lambda r: r.isNotNull())
    return df.select(*keys, F.explode(hits).alias("_r")).select(*keys, "_r.*")


# Severities a rule may name.
RULE_SEVERITIES = ("critical", "major", "minor", "info")
