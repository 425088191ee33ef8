"""Array, map and JSON functions (ARR)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def json_or(col: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, or the default when it is absent, broken or of another type."""
    parsed = F.try_parse_json(col)
    wanted = "ARRAY" if schema.strip().lower().startswith("array") else "OBJECT"
    kind = F.schema_of_variant(parsed)
    fits = kind.startswith(wanted)
    return F.when(F.coalesce(fits, F.lit(False)), F.from_json(col, schema)).otherwise(default)


def sizes(*cols: str) -> list[Column]:
    """Element count of each JSON array, 0 when absent."""
    return [F.coalesce(F.json_array_length(c), F.lit(0)).alias(f"{c}_count") for c in cols]


def patch(base: Column, delta: Column) -> Column:
    """Shallow merge of two JSON objects as text; the patch wins, an absent side counts as empty."""
    kind = "map<string,variant>"
    empty = F.create_map().cast(kind)
    a, b = F.coalesce(F.from_json(base, kind), empty), F.coalesce(F.from_json(delta, kind), empty)
    return F.to_json(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)))


def samples(df: DataFrame, keys: Sequence[str], text: str, seq: str, k: int = 8, cut: int = 40) -> DataFrame:
    """First k distinct texts of each group, cut to n characters, in order of first appearance."""
    trimmed = df.select(*keys, F.trim(text).alias("_t"), seq).where("_t <> ''")
    firsts = trimmed.groupBy(*keys, "_t").agg(F.min(seq).alias("_s"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_s", "_t"))
    kept = firsts.withColumn("_r", rank).where(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.substring("_t", 1, cut).alias("t")))), lambda s: s["t"]).alias("samples"))


def explode_keep(df: DataFrame, col: str, alias: str = "item") -> DataFrame:
    """Array to rows with its position; an empty or absent array keeps its row with a null item."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode_outer(col).alias("pos", alias))


def collect_keep(df: DataFrame, keys: Sequence[str], pos: str = "pos", item: str = "item", alias: str = "items") -> DataFrame:
    """Inverse of ``explode_keep``: rows of one former array back in order.

    Positions and items travel as two plain lists, filled row by row alike, which take about half the room of a list of structs.
    """
    there, blank = F.col(pos).isNotNull(), F.col(item).isNull()
    lists = df.groupBy(*keys).agg(F.collect_list(F.when(there & ~blank, F.col(pos))).alias("_p"), F.collect_list(F.when(there & ~blank, F.col(item))).alias("_i"),
                                  F.collect_list(F.when(there & blank, F.col(pos))).alias("_b"))
    nothing = F.lit(None).cast(df.schema[item].dataType)
    rows = F.concat(F.zip_with("_p", "_i", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), F.transform("_b", lambda p: F.struct(p.alias("p"), nothing.alias("i"))))
    return lists.select(*keys, F.transform(F.array_sort(rows), lambda s: s["i"]).alias(alias))


def nest(parents: DataFrame, children: DataFrame, key: str, seq: str, cols: Sequence[str], page: int = 1000) -> DataFrame:
    """Parent rows with their children as ordered arrays of structs, ``page`` children to an array.

    Pages follow the integer ``seq``, so a parent with very many children gives several rows instead
    of one huge one; a parent without children has one empty array.
    """
    child = F.struct(F.col(seq), *[F.col(c) for c in cols if c != seq])
    lists = children.groupBy(key, F.floor(F.col(seq) / page).alias("page")).agg(
        F.array_sort(F.collect_list(child)).alias("children"), F.count("*").alias("listed"))
    empty = F.array().cast(lists.schema["children"].dataType)
    return parents.join(lists, key, "left").withColumn("children", F.coalesce("children", empty)).withColumn(
        "listed", F.coalesce("listed", F.lit(0))).withColumn("page", F.coalesce("page", F.lit(0)))


def unlisted(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Number of children whose parent is absent."""
    return children.join(parents.select(key), key, "left_anti").agg(F.count("*").alias("unlisted"))
