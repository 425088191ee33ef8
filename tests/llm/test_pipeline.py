"""The pipeline on a small folder of its own, and the registered queries over the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetledger.llm import near_sets
from sheetledger.llm.queries import QUERIES

from .conftest import CLASHES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = spark.createDataFrame([(200_000, None), (200_001, ""), (200_002, "123 456"), (200_003, "words " * 20)], "doc_id long, text string")
    docs = docs.unionByName(extra).unionByName(odd, allowMissingColumns=True).withColumn("_gone", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        before, kept = {r["doc_id"] for r in docs.select("doc_id").collect()}, [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= before, name
        if name == "language":
            assert not set(kept) & {200_000, 200_001, 200_002}
        if name == "exact_dedup":
            assert len(kept) < len(before) and not set(kept) & {100_000, 100_001, 100_002}
        docs = spark.createDataFrame(after.collect(), docs.schema)
    name, stage = corpus_pipeline.STAGES[-1]
    assert {r["doc_id"] for r in stage(spark, docs, SMALL).select("doc_id").collect()} == {r["doc_id"] for r in docs.collect()}


def test_near_stage_keeps_one_of_each_group(spark):
    base = [f"w{i * 7919 % 701}" for i in range(400)]
    texts = [" ".join(base)] + [" ".join([*base[:k * 40], f"other{k}", *base[k * 40 + 1:]]) for k in range(1, 9)] + [" ".join(reversed(base)), " ".join(base[:150]), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect())
    assert kept == [0, 9, 10, 11]


def brute_near(texts):
    """The smallest id that links of exact similarity 0.8 lead to, for each text."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    ids = list(range(len(texts)))
    while True:
        new = [min(ids[j] for j in range(len(texts)) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])) for i in range(len(texts))]
        if new == ids:
            return ids
        ids = new


def test_near_stage_decides_by_exact_similarity(spark):
    """Pairs around 0.8, chains of them, and passages repeated inside a text, against brute force."""
    texts = []
    for g, (words, changed) in enumerate([(w, c) for w in (64, 104, 204, 304) for c in (0.70, 0.75, 0.79, 0.80, 0.82, 0.85)] * 4):
        base = [f"g{g}w{i}" for i in range(words)]
        texts.append(" ".join(base))
        cut = words - 4 - round((words - 4) * 2 * changed / (1 + changed))  # this many shingles at the end are others
        texts.append(" ".join([*base[:words - cut], *(f"g{g}x{i}" for i in range(cut))]))
    passage = [f"p{i}" for i in range(400)]
    texts += [" ".join(passage), " ".join(passage + passage[:60] * 4), " ".join(passage[:200] * 5), " ".join(passage[:200])]
    chain = [f"c{i}" for i in range(204)]
    texts += [" ".join([f"d{i}" for i in range(k)] + chain[k:]) for k in range(0, 100, 15)]
    wanted = [i for i, c in enumerate(brute_near(texts)) if i == c]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, SMALL).collect()) == wanted
    assert len(texts) // 2 < len(wanted) < len(texts) - 40


def test_run_and_queries_give_rows(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_empty_tables_and_clashing_columns(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    extra = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 40").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name
        got = stage(spark, extra, SMALL)
        assert name == "packing" or got.columns == extra.columns, name
        assert got.count() > 0, name


def test_near_groups_lie_in_several_tiles(spark):
    """A neighbourhood of many nodes, cut into small tiles: the same groups as brute force, and few links."""
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)] + [" ".join(w if (i * 31 + k * 17) % 43 else f"x{k}" for i, w in enumerate(base)) for k in range(40)]
    texts += [" ".join(w if (i * 29 + k * 13) % 9 else f"y{k}" for i, w in enumerate(base)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kinds = docs.select("doc_id", "text")
    prints = near_sets._nodes(kinds, "doc_id", "text", 5, 256).select(F.col("doc_id").alias("id"), "fp", "size", F.lit(1).cast("long").alias("part"))
    links = near_sets.verified(prints, docs, "doc_id", "text", 5, 256, 256, 0.8, tile=6).collect()
    root = list(range(len(texts)))
    for r in links:
        a, b = root[r["a"]], root[r["b"]]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == brute_near(texts)
    assert len(links) < len(texts) * 12


def test_working_tables_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 60")
    corpus_pipeline._WORK.clear()
    before = None
    for name, stage in corpus_pipeline.STAGES[2:]:
        out = stage(spark, docs, SMALL)
        rows_ = out.collect()
        if before:
            assert not os.path.exists(before.removeprefix("file:"))
        before = corpus_pipeline._WORK[max(corpus_pipeline._WORK)][-1]
        docs = spark.createDataFrame(rows_, out.schema)
    assert os.path.exists(before.removeprefix("file:"))
