"""Vector and graph retrieval (RET)."""

from __future__ import annotations

import itertools
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, write_down


_PLANES, _SLACK = 16, 1e-5  # the slack covers scores that are equal after rounding


def vector_blocks(df: DataFrame, key: str, vector: str, label: str, size: int) -> DataFrame:
    """label, block, rows, centre, radius: vectors packed into blocks of about ``size`` rows per label, by direction.

    A cell is a pattern of sides of fixed random planes, as many as the label's rows call for; a cell of many rows is several blocks.  Centre
    and radius are those of the unit vectors (a zero vector stays zero).  The blocks are written down, as the search reads them more than once.
    """
    @F.pandas_udf("long")
    def side(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=np.int64)
        x = np.stack(vectors.to_list()).astype(np.float64)
        planes = np.random.default_rng(7).normal(size=(x.shape[1], _PLANES))
        return pd.Series((x @ planes > 0) @ (1 << np.arange(_PLANES)))

    @F.arrow_udf("struct<centre:array<double>,radius:double>")
    def ball(blocks: pa.Array) -> pa.Array:
        out = []
        for rows in blocks:
            x = _unit(_held(rows)[1])
            out.append({"centre": x.mean(axis=0), "radius": float(np.linalg.norm(x - x.mean(axis=0), axis=1).max())})
        return pa.array(out, pa.struct([("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    bits = F.least(F.lit(_PLANES), F.greatest(F.lit(0), F.floor(F.log2(F.count("*") / size)))).cast("int")
    counts = df.groupBy(label).agg(F.pow(F.lit(2), bits).cast("long").alias("_m"))
    placed = df.select(label, F.struct(F.col(key).alias("k"), F.col(vector).alias("v")).alias("_r"), side(vector).alias("_side")).join(counts, label).withColumn("_cell", F.pmod("_side", "_m"))
    cells = placed.groupBy(label, "_cell").agg(F.ceil(F.count("*") / size).alias("_n"))
    placed = placed.join(cells, [label, "_cell"]).withColumn("block", F.shiftleft("_cell", 40) + F.pmod(F.xxhash64("_r.k"), F.col("_n")))
    packed = placed.groupBy(label, "block").agg(F.collect_list("_r").alias("rows"))
    return write_down(packed.withColumn("_b", ball("rows")).select(label, "block", "rows", "_b.centre", "_b.radius"))


def _held(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a block, taken from the Arrow buffers: no Python object per row, which a batch of blocks would hold all at once."""
    keys, vectors = rows.values.field("k"), rows.values.field("v")
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) != 1 or vectors.null_count:
        raise ValueError("vectors of one label must have one length")
    return keys.to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _scores(qs: pa.ListScalar, bs: pa.ListScalar, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of both blocks and all cosines, rounded; a query does not meet itself."""
    (qk, qv), (bk, bv) = _held(qs), _held(bs)
    norm = np.linalg.norm(qv, axis=1)[:, None] * np.linalg.norm(bv, axis=1)[None, :]
    score = np.round(np.divide(qv @ bv.T, norm, out=np.zeros_like(norm), where=norm > 0), 12)
    return qk, bk, np.where(qk[:, None] == bk[None, :], -np.inf, score) if skip_self else score


def meeting_blocks(queries: DataFrame, base: DataFrame, label: str, k: int, skip_self: bool = False) -> DataFrame:
    """The pairs of blocks that can hold a hit: label, query_rows, base_rows.

    Every query block first meets the base block of the nearest centre.  The farthest k-th neighbour found there is its reach, and a base block whose
    ball lies beyond it, by the triangle inequality, is left out.
    """
    @F.arrow_udf("double")
    def reach(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for qs, bs in zip(left, right):
            score = _scores(qs, bs, skip_self)[2]
            least = np.partition(score, -k, axis=1)[:, -k].min() if score.shape[1] >= k else -np.inf
            out.append(float(np.sqrt(max(0.0, 2 - 2 * least))))
        return pa.array(out, pa.float64())

    gap = F.sqrt(F.aggregate(F.zip_with("_qc", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    asked = queries.select(label, F.col("block").alias("_q"), F.col("centre").alias("_qc"))
    nearest = asked.join(base.select(label, "block", "centre"), label).groupBy(label, "_q").agg(F.min_by("block", F.struct(gap.alias("g"), "block")).alias("block"))
    left = queries.select(label, F.col("block").alias("_q"), F.col("rows").alias("query_rows"), F.col("centre").alias("_qc"), F.col("radius").alias("_qr"))
    first = left.join(nearest, [label, "_q"]).join(base.select(label, "block", "rows"), [label, "block"])
    reached = write_down(first.select(label, "_q", reach("query_rows", "rows").alias("_reach")))
    return (left.join(reached, [label, "_q"]).join(base.withColumnRenamed("rows", "base_rows"), label)
            .where(gap - F.col("_qr") - F.col("radius") <= F.col("_reach") + _SLACK).select(label, "query_rows", "base_rows"))


def topk_cosine(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, k: int, query_block: int = 256,
                base_block: int = 1024, skip_self: bool = False) -> DataFrame:
    """Exact k nearest vectors by cosine among those with the label of the query.

    Both sides are packed into blocks by direction and met by label, unless their balls lie too far apart; a block pair is one matrix product and gives
    at most k hits per query, so pairs of rows are never materialized; the last cut uses a rank limit
    that runs before the shuffle too.  A frequent label is many blocks, hence many tasks.  A table that asks for itself is packed once.
    """
    @F.arrow_udf("array<struct<q:long,k:long,s:double>>")
    def nearest(left: pa.Array, right: pa.Array) -> pa.Array:
        ends, found = [0], {"q": [], "k": [], "s": []}
        for qs, bs in zip(left, right):
            qk, bk, score = _scores(qs, bs, skip_self)
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(qk), -np.inf)
            at, near = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            best = np.lexsort((bk[near], -score[at, near], at))
            at, near = at[best], near[best]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, near = at[kept], near[kept]
            for name, values in (("q", qk[at]), ("k", bk[near]), ("s", score[at, near])):
                found[name].append(values)
            ends.append(ends[-1] + len(at))
        parts = [pa.array(np.concatenate([np.empty(0, kind), *found[name]]), t) for name, kind, t in (("q", np.int64, pa.int64()), ("k", np.int64, pa.int64()), ("s", np.float64, pa.float64()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=list(found)))

    blocks = vector_blocks(base, key, vector, label, base_block)
    asked = blocks if queries is base else vector_blocks(queries, key, vector, label, query_block)
    pairs = meeting_blocks(asked, blocks, label, k, skip_self)
    hits = pairs.select(label, F.explode(nearest("query_rows", "base_rows")).alias("_h")).select(
        label, F.col("_h.q").alias("query_id"), F.col("_h.k").alias("match_id"), F.col("_h.s").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "match_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


# One step up for severities when both recalls agree.
ESCALATE = {"info": "minor", "minor": "major", "major": "critical", "critical": "critical"}


def fuse_candidates(kg: DataFrame, rag: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two recall lists (keys, ref, snippet, severity) merged by reference, the first list's text and severity kept;
    agreement lifts the severity by one step.  Candidates without a reference meet by their text."""
    both = kg.withColumn("_s", F.lit("kg")).withColumn("_o", F.lit(0)).unionByName(rag.withColumn("_s", F.lit("rag")).withColumn("_o", F.lit(1)))
    ident = F.when(F.col("ref") != "", F.concat(F.lit("r:"), F.col("ref"))).otherwise(F.concat(F.lit("t:"), F.col("snippet")))
    merged = both.withColumn("_k", ident).groupBy(*keys, "_k").agg(
        F.min(F.struct("_o", "snippet", "severity", "ref")).alias("_f"), F.array_sort(F.collect_set("_s")).alias("_src"))
    lifted = F.col("_f.severity")
    for low, high in ESCALATE.items():
        lifted = F.when((F.size("_src") == 2) & (F.col("_f.severity") == low), F.lit(high)).otherwise(lifted)
    return merged.select(*keys, F.col("_f.ref").alias("ref"), F.col("_f.snippet").alias("snippet"), lifted.alias("severity"),
                         F.array_join("_src", "+").alias("sources"))


def match_path(requires: DataFrame, clauses: DataFrame, mandatory: Column) -> DataFrame:
    """Discipline–REQUIRES→Standard, with its mandatory clauses where it has any.

    ``requires``: discipline, standard; ``clauses``: standard, clause, ….
    """
    return requires.join(clauses.where(mandatory), "standard", "left")


def tree(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Nodes (id, name, parent_id, status) after operations (id, kind, value, seq), with the version.

    kinds: rename, reparent, confirm, reject, merge; the last of a kind wins, manual changes set the source.
    """
    last = lambda kinds: F.max_by(F.struct("kind", "value"), F.when(F.col("kind").isin(*kinds), F.col("seq")))
    folded = ops.groupBy("id").agg(
        F.count("*").alias("_n"), last(["rename"]).alias("_name"), last(["reparent"]).alias("_parent"),
        last(["confirm", "reject", "merge", "rename"]).alias("_state"))
    state = (F.when(F.col("_state.kind") == "reject", "rejected").when(F.col("_state.kind") == "merge", "merged")
             .when(F.col("_state").isNotNull(), "confirmed").otherwise(F.col("status")))
    return nodes.join(folded, "id", "left").select(
        "id", F.coalesce(F.col("_name.value"), F.col("name")).alias("name"),
        F.when(F.col("_parent").isNotNull(), F.col("_parent.value").try_cast("long")).otherwise(F.col("parent_id")).alias("parent_id"),
        state.alias("status"), F.when(F.col("_n").isNotNull(), "manual").otherwise("automatic").alias("source"),
        (F.coalesce("_n", F.lit(0)) + 1).alias("version"))


def tree_paths(spark, nodes: DataFrame) -> DataFrame:
    """Path from the root of every live node (id, name, parent_id, status) with its depth; level by level, to any depth."""
    live = cut_lineage(nodes.where("status not in ('rejected', 'merged')").select("id", "name", "parent_id"))
    level = cut_lineage(live.where("parent_id is null").select("id", F.col("name").alias("path"), F.lit(1).alias("depth")))
    walked = level
    while True:
        above = level.select(F.col("id").alias("parent_id"), "path", "depth")
        level = cut_lineage(live.join(above, "parent_id").select("id", F.concat("path", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return walked
        walked = walked.unionByName(level)


_LINKS = 1_000_000  # links of a task


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components (node, component = smallest node) by alternating large and small stars.

    Rounds grow with the logarithm of the size, not with the diameter; each is checkpointed and
    touches an edge once, so a node with very many edges is only a group of rows to a min.
    """
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(b)).distinct()
    links = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links.count() // _LINKS))

    def stars(frame: DataFrame, large: bool) -> DataFrame:
        low = frame.groupBy("u").agg(F.min("v").alias("_m"))
        if large:  # an end without a smaller neighbour, as the hub of a finished star, keeps its links
            out = frame.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("_m", "v").alias("v"))
        else:
            out = frame.join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).union(low).where("u <> v")
        # a number that grows with the links, not below the session's, so that a task's memory does not
        return out.repartition(parts, "u", "v").distinct()

    before = None
    while True:
        links = cut_lineage(stars(stars(links, True), False))
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            break
        before = mark
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("_c")), "node", "left").select(
        "node", F.coalesce("_c", "node").alias("component"))


def isolation(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes, isolated ones, their share (0 without nodes), and edges that point at no node.

    Ends are folded before they meet the nodes, so one that very many edges share is a single row there.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct()
    alone = nodes.select(key).join(ends, key, "left_anti")
    dangling = edges.groupBy("dst").agg(F.count("*").alias("_n")).join(nodes.select(F.col(key).alias("dst")), "dst", "left_anti")
    counts = (nodes.select(F.lit(1).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("d"))
              .union(alone.select(F.lit(0), F.lit(1), F.lit(0))).union(dangling.select(F.lit(0), F.lit(0), "_n")))
    total, isolated = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("i"), F.lit(0))
    return counts.agg(total.alias("nodes"), isolated.alias("isolated"),
                      F.coalesce(F.round(F.try_divide(isolated, total), 4), F.lit(0.0)).alias("isolated_ratio"), F.coalesce(F.sum("d"), F.lit(0)).alias("dangling"))


def propagate(anchors: DataFrame, pairs: DataFrame, confirmed: DataFrame, max_residual: float, generations: int | None = None) -> DataFrame:
    """Labels from confirmed anchors to what uniquely matches one of them; the sound ones anchor the next round.

    ``anchors``: id, label; ``pairs``: src, dst, residual; ``confirmed``: id.  Out: id, label, generation, anchor.
    Rounds go on until nothing is new, or for ``generations``, if given.
    """
    front = anchors.select("id", "label")
    known = confirmed.select("id").union(anchors.select("id")).distinct()
    done = None
    for generation in range(generations) if generations is not None else itertools.count():
        reach = pairs.join(front.select(F.col("id").alias("src"), "label"), "src").join(known.select(F.col("id").alias("dst")), "dst", "left_anti")
        hits = reach.groupBy("dst").agg(F.count("*").alias("_n"), F.min("label").alias("label"), F.min("src").alias("anchor"),
                                        F.min("residual").alias("_r")).where("_n = 1")
        fresh = cut_lineage(hits.select(F.col("dst").alias("id"), "label", F.lit(generation).alias("generation"), "anchor", "_r"))
        if fresh.isEmpty():
            break
        done = fresh if done is None else done.unionByName(fresh)
        known = cut_lineage(known.union(fresh.select("id")))
        front = fresh.where(F.col("_r") <= max_residual).select("id", "label")
    if done is None:
        return anchors.select("id", "label", F.lit(0).alias("generation"), F.col("id").alias("anchor")).limit(0)
    return done.drop("_r")


def trace_forward(drawings: DataFrame, facts: DataFrame, key: str, category: str) -> DataFrame:
    """What each drawing yielded, by category."""
    return drawings.select(key).join(facts, key, "left").groupBy(key).agg(
        F.count(category).alias("facts"), F.count_distinct(category).alias("categories"))


def trace_back(entities: DataFrame, observations: DataFrame, drawings: DataFrame, entity: str, key: str) -> DataFrame:
    """The drawings an entity was seen on, one row each with its observations."""
    seen = observations.groupBy(entity, key).agg(F.count("*").alias("observations"))
    return entities.select(entity).join(seen, entity).join(drawings, key, "left")
