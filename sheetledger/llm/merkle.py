"""Merkle manifest of a table: leaves, subroots by group, one root, and a proof for every row, by self-joins of a level.

Nodes carry a tree and an index.  At each level a node meets its siblings by equality of computed indices: the index with its last bit
turned for binary trees, the other slots of its run otherwise.  Rows of slot zero then emit the parents.  On the way back a
node's proof is its siblings followed by its parent's proof, so a level's rows meet the next level's once.  Digests travel
as 32 bytes; they are hashed as lowercase hex.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep


def digest(text: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(col: Column) -> Column:
    return F.lower(F.hex(col))


def field(col: Column) -> Column:
    """A value as `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``: 0, 1, ... within each tree, nulls first; and ``n``, the rows of the tree.

    Rows are sorted over all partitions, not tree by tree, so one tree may hold any share of them; what a partition holds of a tree is
    counted, and these counts, one for each partition and tree, are added up.
    """
    ways = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    names = rows.columns
    many = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = rows.repartitionByRange(int(many), *ways).sortWithinPartitions(*ways)
    place = F.monotonically_increasing_id()
    kept = keep(ranged.withColumn("_part", F.shiftright(place, 33).cast("int")).withColumn("_place", place.bitwiseAND((1 << 33) - 1)), "ranged")
    parts = kept.groupBy(tree, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    return kept.join(starts, kept[tree].eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_p"))).select(
        *names, (F.col("_place") + F.col("_shift")).alias("at"), "n")


def _slot(at: Column, arity: int) -> Column:
    return F.pmod(at, F.lit(arity))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, at, h, n) with ``near``: the digests of the others in each one's run, by slot, null where there is none."""
    out, found = nodes, []
    at = F.col("at")
    for step in range(1, arity):
        there = at.bitwiseXOR(F.lit(1)) if arity == 2 else at - _slot(at, arity) + F.pmod(at + step, F.lit(arity))
        others = nodes.select(F.col("tree").alias(f"_t{step}"), F.col("at").alias(f"_a{step}"), F.struct(_slot(F.col("at"), arity).alias("slot"), "h").alias(f"_s{step}"))
        out = out.withColumn("_there", there).join(others, (F.col("tree") == F.col(f"_t{step}")) & (F.col("_there") == F.col(f"_a{step}")), "left").drop("_there", f"_t{step}", f"_a{step}")
        found.append(f"_s{step}")
    near = F.array_sort(F.filter(F.array(*found), lambda s: s.isNotNull()))
    return out.select("tree", "at", "h", "n", near.alias("near"))


def _parent(arity: int) -> Column:
    """The digest of a run, told by its slot zero: its own, then its siblings'."""
    return digest(F.concat(as_hex(F.col("h")), F.array_join(F.transform("near", lambda s: as_hex(s["h"])), "")))


def proven(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """(tree, root) and (tree, at, path) for trees of nodes (tree, at, h, n), where ``tree`` is not null and n is how many nodes a tree has.

    ``path`` lists a leaf's levels from the leaf up, each as its slot (``s``) and its siblings' digests by slot, joined (``n``).  The number of rounds is the
    logarithm of the largest tree.  A tree of one node is its own root, with an empty path.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, now = [], leaves
    while most > 0:
        met = keep(with_siblings(now, arity), "level")
        levels.append(met)
        now = met.where((F.col("n") > 1) & (_slot(F.col("at"), arity) == 0)).select(
            "tree", F.floor(F.col("at") / arity).cast("long").alias("at"), _parent(arity).alias("h"), F.ceil(F.col("n") / arity).cast("long").alias("n"))
        most = -(-most // arity) if most > 1 else 0
    if not levels:
        levels = [keep(with_siblings(leaves, arity), "level")]
    empty = F.array().cast("array<struct<s: int, n: binary>>")
    path = None
    for met in reversed(levels):
        own = F.struct(_slot(F.col("at"), arity).cast("int").alias("s"), F.unhex(F.array_join(F.transform("near", lambda s: F.hex(s["h"])), "")).alias("n"))
        top = met.where("n = 1").select("tree", "at", empty.alias("path"))
        if path is None:
            path = top
            continue
        above = path.select(F.col("tree").alias("_t"), F.col("at").alias("_a"), F.col("path").alias("_path"))
        below = met.where("n > 1").withColumn("_up", F.floor(F.col("at") / arity).cast("long"))
        below = below.join(above, (F.col("tree") == F.col("_t")) & (F.col("_up") == F.col("_a"))).select("tree", "at", F.concat(F.array(own), "_path").alias("path"))
        path = keep(below.unionByName(top), "paths")
    roots = [met.where("n = 1").select("tree", F.col("h").alias("root")) for met in levels]
    return reduce(DataFrame.unionByName, roots), path


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to; digests of 32 bytes."""

    def step(h: Column, level: Column) -> Column:
        before = F.substring(F.hex(level["n"]), F.lit(1), level["s"] * 64)
        after = F.substring(F.hex(level["n"]), level["s"] * 64 + 1, F.length(F.hex(level["n"])))
        return digest(F.lower(F.concat(before, F.hex(h), after)))

    return F.aggregate(path, leaf, step)


def manifest(docs: DataFrame, fields: list[str], tampered: dict[str, Column], tamper: Column, id_col: str = "doc_id", group_col: str = "lang", arity: int = 2) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    A leaf is the digest of ``fields`` in their order.  Leaves of each ``group_col`` ascend by id (nulls first, equal ids by leaf; equal leaves are alike) and
    are hashed up in runs of ``arity``, the last one possibly shorter, until one node is left, the subroot; subroots, by group (null first, by
    bytes), give the root in the same way.  ``proof_sha256`` is the digest of the siblings of all levels from leaf to root.  Rows for which
    ``tamper`` is true (null: not) get their leaf from ``tampered`` columns instead before it is folded with the original siblings;
    ``verified`` says whether that gives the root.  Empty texts count as values of no bytes, nulls as `-`; other columns are ignored; an empty table
    gives an empty result.
    """
    plain = F.concat(*[field(F.col(c)) for c in fields])
    other = F.concat(*[field(tampered.get(c, F.col(c))) for c in fields])
    touched = F.coalesce(tamper, F.lit(False))
    leaves = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("grp"), digest(plain).alias("h"),
                              F.when(touched, digest(other)).alias("other")), "leaves")
    # groups go by number, so that null is one like the others
    groups = numbered(leaves.groupBy("grp").agg(F.lit(0).alias("one")), "one", ["grp"])
    groups = keep(groups.select(F.col("grp").alias("_grp"), F.col("at").alias("tree"), "n"), "groups")
    placed = numbered(leaves, "grp", ["doc_id", "h"])
    placed = keep(placed.join(groups.drop("n"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp", "grp"), "placed")
    subroots, path = proven(placed.select("tree", "at", "h", "n"), arity)
    subroots = keep(subroots, "subroots")
    tops = subroots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("root").alias("h"), "n")
    roots, above = proven(tops, arity)
    tops = above.select(F.col("at").alias("_group"), F.col("path").alias("_above")).crossJoin(roots.select(F.col("root").alias("top")).limit(1))  # one root
    tops = keep(subroots.join(tops, F.col("tree") == F.col("_group")).select(F.col("tree").alias("_group"), F.col("root").alias("sub"), "_above", "top"), "tops")
    full = placed.join(path, ["tree", "at"]).join(tops, F.col("tree") == F.col("_group")).withColumn("path", F.concat("path", "_above"))
    proof = F.array_join(F.transform("path", lambda s: F.hex(s["n"])), "")
    found = full.select("doc_id", as_hex(F.col("h")).alias("leaf"), as_hex(F.col("sub")).alias("subroot"), as_hex(F.col("top")).alias("root"),
                        F.sha2(F.lower(proof).cast("binary"), 256).alias("proof_sha256"), as_hex(folded(F.coalesce("other", "h"), F.col("path"))).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
