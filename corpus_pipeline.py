"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last
return the columns of documents; the last returns the pieces of the packed sequences.  Stages run one after another: a
stage's result is written before the next one is called on it, and that call removes the working tables of the stages before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sheetledger.llm import exact_dedup, language_id, near_sets, packing, quality
from sheetledger.llm.common import drop_folder, remainder, scratch, shared_folder, without

#: Near copies share 0.8 of their distinct five-word shingles. Fingerprints of 256 bits find candidates: those of such texts differ
#: in 39 bits on average, with a deviation of 6 (48 for the shortest texts); unrelated ones in 128, with a deviation of 8.
NEAR = {"words": 5, "bits": 256, "radius": 72, "least": 0.8}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Folders of working tables, by the place of their stage.
_WORK: dict[int, list[str]] = {}


def _stage(place: int) -> Callable[[Stage], Stage]:
    """A stage with a folder of its own for working tables; those of earlier stages go, unless ``docs`` still reads them."""

    def wrap(fn: Stage) -> Stage:
        @wraps(fn)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            read = docs.inputFiles()
            for earlier in [p for p in _WORK if p < place]:
                live = [f for f in _WORK[earlier] if any(f in name for name in read)]
                for folder in set(_WORK.pop(earlier)) - set(live):
                    drop_folder(spark, folder)
                if live:
                    _WORK[earlier] = live
            with scratch(spark) as folder:
                _WORK.setdefault(place, []).append(folder)
                return fn(spark, docs, sf_dir)

        return run

    return wrap


@_stage(0)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier scores under 0.3; it learns from labels outside the fold of remainder 0.

    Null and empty texts score like any text without features; rows repeated under other ids are judged alike; ties do not arise.  An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    return quality.passing(docs, quality.train(docs, labels), least=0.3)


@_stage(1)
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, null and empty ones among them, and those whose language is a tie between learned ones.

    The score is a share among the learned languages, so a text in none of them can stay.  An empty table stays empty.
    """
    return language_id.passing(docs, language_id.train(docs), least=0.5)


@_stage(2)
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks the longest stays, of equally long ones the smallest id; null counts as empty.  An empty table stays empty."""
    return without(docs, exact_dedup.exact_groups(docs).where("not kept"))


@_stage(3)
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays; texts without words, null ones among them, are copies of each other.  An empty table stays empty."""
    return without(docs, near_sets.similar_groups(docs, **NEAR).where("doc_id <> component_id"))


@_stage(4)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, a row per piece; null and empty texts are an end alone.  An empty table gives no piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [("quality", quality_stage), ("language", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: Trained models, components and tokens are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
