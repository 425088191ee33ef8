"""Ordered scans when one key holds all rows: many parts, the same results as a plain window."""

import random
from bisect import bisect_left

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetledger.operators import ordered, ranks
from sheetledger.operators.ordered import Run, in_parts, scan
from sheetledger.operators.windows import inversions, lis_outliers


@pytest.fixture
def many_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def hot(spark, n=400):
    """One key with nearly all rows, a null key, and a small one."""
    rng = random.Random(5)
    data = [("hot" if i < n - 40 else None if i < n - 10 else "cold", i * 7 % n, rng.randrange(60), rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(data, "k string, t int, v int, start boolean"), data


def test_one_key_lies_in_many_parts(many_parts):
    df, _ = hot(many_parts)
    sizes = in_parts(df.where("k = 'hot'"), ["k"], ["t"]).groupBy("_part").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 200


def test_scan_equals_plain_windows(many_parts):
    df, _ = hot(many_parts)
    got = scan(df, ["k"], ["t"], lags={"p": "v", "pt": "t"}, leads={"n": "v"},
               runs={"s": Run(F.col("v")), "sb": Run(F.col("v"), before=True), "m": Run(F.col("v"), "max", before=True), "r": Run(F.col("v"), reverse=True, before=True)})
    w = W.partitionBy("k").orderBy("t")
    frame = w.rowsBetween(W.unboundedPreceding, 0)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    after = w.rowsBetween(1, W.unboundedFollowing)
    want = df.select("*", F.lag("v").over(w).alias("p"), F.lag("t").over(w).alias("pt"), F.lead("v").over(w).alias("n"), F.sum("v").over(frame).alias("s"),
                     F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sb"), F.max("v").over(before).alias("m"), F.coalesce(F.sum("v").over(after), F.lit(0)).alias("r"))
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_windows_do_not_reach_beyond_a_part(many_parts):
    df, _ = hot(many_parts)
    plan = scan(df, ["k"], ["t"], lags={"p": "v"})._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(k#" in plan.replace("'", "") and "_part#" in plan


def test_scan_without_keys_and_rows(many_parts):
    df, _ = hot(many_parts)
    assert scan(df.where("false"), [], ["t"], lags={"p": "v"}, runs={"s": Run(F.col("v"))}).count() == 0
    got = ordered.numbered(df, [], ["t"])
    assert rows(got, "t", "seq") == [(i, i + 1) for i in range(400)]


def brute_run(values):
    tails = []
    for v in values:
        i = bisect_left(tails, v)
        tails[i:i + 1] = [v]
    return len(tails)


def groups(data):
    out = {}
    for k, t, v, _ in sorted(data, key=lambda r: r[1]):
        out.setdefault(k, []).append(v)
    return out


def test_longest_runs_across_parts_and_bands(many_parts):
    df, data = hot(many_parts)
    got = {r["k"]: r["length"] for r in ranks.longest_runs(df, ["k"], ["t"], "v").collect()}
    assert got == {k: brute_run(v) for k, v in groups(data).items()}
    rising = many_parts.range(300).select(F.lit(1).alias("k"), "id", (F.col("id") * 2 - F.col("id") % 3).alias("v"))
    assert rows(ranks.longest_runs(rising, ["k"], ["id"], "v")) == [(1, brute_run([i * 2 - i % 3 for i in range(300)]))]
    equal = rising.withColumn("v", F.lit(7))
    assert rows(ranks.longest_runs(equal, ["k"], ["id"], "v")) == [(1, 1)]
    found = {r["k"]: (r["total"], r["outliers"]) for r in lis_outliers(df.withColumn("v", F.expr("nullif(v, 3)")), ["k"], "t", "v", "start").collect()}
    assert found == {k: (len(v), len(v) - brute_run([x for x in v if x != 3])) for k, v in groups(data).items()}


def test_inversions_across_parts_and_bands(many_parts):
    df, data = hot(many_parts)
    got = {r["k"]: r["inversion_rate"] for r in inversions(df, ["k"], ["t"], "v").collect()}
    for k, v in groups(data).items():
        pairs = sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v)))
        assert got[k] == pytest.approx(pairs / (len(v) * (len(v) - 1) / 2))
    assert rows(inversions(df.limit(2), [], ["t"], "v")) == [(2, None)]


def test_weighted_inversions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 100):
        p, v, w = rng.integers(0, 20, n), rng.integers(-5, 5, n), rng.integers(1, 4, n)
        assert ranks.weighted_inversions(p, v, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if p[i] < p[j] and v[i] > v[j])
