"""Pluggable checks, analyzers, models, table functions and aggregates (UDF)."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "engine string, severity string, description string"


class Registry:
    """Named functions DataFrame → DataFrame with one shape; one that fails to build its plan is left out and reported.

    A failure at run time fails the job: Spark has retried the task by then.
    """

    def __init__(self, columns: list[str]):
        self.columns, self.functions = columns, {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame] | None = None):
        if fn is None:
            return lambda f: self.register(name, f)
        self.functions[name] = fn
        return fn

    def run(self, df: DataFrame, tag: str) -> tuple[DataFrame, dict[str, str]]:
        """(union of the results with their function's name, errors by name)."""
        parts, errors = [], {}
        for name, fn in self.functions.items():
            try:
                parts.append(fn(df).select(*self.columns).withColumn(tag, F.lit(name)))
            except Exception as exc:  # noqa: BLE001 - one broken function must not stop the others
                errors[name] = f"{type(exc).__name__}: {exc}"
        if not parts:
            raise ValueError(f"no function could be planned: {errors}")
        return reduce(lambda a, b: a.unionByName(b), parts), errors


CHECKS = Registry(["doc_id", "severity", "description"])
ANALYZERS = Registry(["kind", "target", "impact", "confidence"])


def register_check(name: str, fn=None):
    return CHECKS.register(name, fn)


def register_analyzer(name: str, fn=None):
    return ANALYZERS.register(name, fn)


def with_model(df: DataFrame, col: str, load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str = "string", alias: str = "label") -> DataFrame:
    """Recognizer over Arrow batches; ``load`` runs once per worker task, not once per row."""
    @F.pandas_udf(kind)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.withColumn(alias, apply(col))


def mock_model() -> Callable[[pd.Series], pd.Series]:
    """Deterministic stand-in for a recognizer: names the longest word."""
    return lambda texts: texts.fillna("").map(lambda t: max(t.split(), key=lambda w: (len(w), w), default=""))


class SplitSentences:
    """Table function: text → (idx, sentence)."""

    def eval(self, text: str):
        import re

        parts = re.split(r"(?<=[.!?。；])\s*", text or "")
        for i, part in enumerate(p for p in parts if p.strip()):
            yield i, part.strip()


class SplitArticles:
    """Table function: text → (idx, article_no, body), cut where a line starts with a number of three parts."""

    def eval(self, text: str):
        import re

        parts = re.split(r"(?m)^(?=\d{1,2}\.\d{1,2}\.\d{1,2})", text or "")
        found = [re.match(r"(\d{1,2}\.\d{1,2}\.\d{1,2})(.*)", p, re.S) for p in parts]
        for i, hit in enumerate(h for h in found if h):
            yield i, hit.group(1), " ".join(hit.group(2).split())


class NamedRefs:
    """Table function: text → (std_no) of every standard written as letters, number and year."""

    def eval(self, text: str):
        import re

        for prefix, number, year in re.findall(r"\b([A-Z]{2,4}(?:/[TZ])?)\s*(\d{4,6})-(\d{4})\b", text or ""):
            yield (f"{prefix} {number}-{year}",)


def register_table_functions(spark: SparkSession) -> None:
    """``split_sentences``, ``split_articles`` and ``refs`` for SQL (use with LATERAL)."""
    spark.udtf.register("split_sentences", F.udtf(SplitSentences, returnType="idx int, sentence string"))
    spark.udtf.register("split_articles", F.udtf(SplitArticles, returnType="idx int, article_no string, body string"))
    spark.udtf.register("refs", F.udtf(NamedRefs, returnType="std_no string"))


def nearest_rank(value: Column | str, p: float) -> Column:
    """Ranked (not interpolated) quantile of a small group: element ``min(floor(p·n), n − 1)``."""
    col = F.col(value) if isinstance(value, str) else value
    ordered = F.array_sort(F.collect_list(col))
    return F.get(ordered, F.least(F.floor(F.lit(p) * F.size(ordered)), F.size(ordered) - 1).cast("int"))
