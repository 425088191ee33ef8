"""Connected components against union-find, and order fidelity against the plain table of subsequences."""

import random

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from sheetledger.operators import evaluation, retrieval


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(root))


def test_components_of_chains_hubs_and_scattered_edges(spark):
    rng = random.Random(1)
    chain = [(i, -i - 1) for i in range(40)] + [(i + 1, -i - 1) for i in range(39)]
    hub = [(100 + i, -500) for i in range(300)]
    scattered = [(1000 + rng.randrange(120), -1000 - rng.randrange(90)) for _ in range(110)]
    edges = chain + hub + scattered + scattered[:5]
    got = retrieval.components(spark.createDataFrame(edges, "a long, b long").withColumn("extra", F.lit(1)), "a", "b")
    assert rows(got) == union_find(edges)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_order_fidelity_of_distinct_and_repeated_items(spark):
    rng = random.Random(2)
    pairs = [([rng.randrange(12) for _ in range(rng.randrange(15))], [rng.randrange(12) for _ in range(rng.randrange(10))]) for _ in range(60)]
    pairs += [(rng.sample(range(30), 20), rng.sample(range(30), 25)) for _ in range(20)] + [([], [1]), ([1], [])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, found array<int>, wanted array<int>")
    for i, fidelity in rows(evaluation.order_fidelity(df, "found", "wanted"), "i", "fidelity"):
        found, wanted = pairs[i]
        decided = wanted and set(found) & set(wanted)
        assert pd.isna(fidelity) if not decided else abs(fidelity - lcs(found, wanted) / len(wanted)) < 1e-12
