"""Merkle manifest of a table: digests of rows, trees over them by group, a proof for every row.

A leaf is the SHA-256 of a row's columns. The leaves of a group stand in order; every `arity`
consecutive nodes become the digest of their digests, until one is left, the group's subroot; the
subroots, ordered by group, become the root in the same way. Whoever holds the root can verify a row
from its proof: the digests beside its path.

Every level is one self-join. A node asks for its siblings by index: XOR with 1 for a binary tree,
otherwise the other slots of its block of `arity`. The row of slot zero then holds its whole block
and emits the parent. So a task joins digests by equal keys, no block or group meets in one
place, and a level has a fraction 1 / arity of the rows below. Paths are handed down again level by
level, each node appending its siblings to what its parent received.

Positions come from a range partitioning by group, order and digest: a row's rank in its part plus
the rows of its group in parts before. Parts are about RANGE_ROWS rows whatever a group's share (beyond
MOST_PARTS parts, rows / MOST_PARTS), and equal rows spread over parts.

NULL groups and order values are values like others, before the rest. Ties of the order value go by
digest, equal rows are leaves of their own (interchangeable). An empty table gives no rows. Texts of
any length are digested whole in the row that holds them. Further columns come through,
whatever their names, but for those added, which replace input columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.frames import null_safe_join
from hindcast.session import cut_lineage

ARITY = 8
RANGE_ROWS = 20_000
MOST_PARTS = 20_000


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*columns: Column | str) -> Column:
    """Digest of the columns, each as byte count, colon, value; '-' for NULL. 64 hex digits."""

    def encoded(column: Column | str) -> Column:
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest_of(F.concat(*[encoded(column) for column in columns]))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def positions(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """`rows` (with column `tree`) with `idx`, its 0-based place in its tree by `order`, and the tree's `n`.

    `rows` should be a stored table: it is sampled for the range bounds, then read once more.
    """
    parts = min(MOST_PARTS, max(1, math.ceil(rows.count() / range_rows)))
    ranged = rows
    if parts > 1:
        # The last key lets rows that are equal in all others fall into different parts.
        ranged = (
            rows.withColumn("_salt", F.monotonically_increasing_id())
            .repartitionByRange(parts, "tree", *order, "_salt")
            .drop("_salt")
        )
    else:
        ranged = rows.coalesce(1)
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("n"),
    )
    inside = Window.partitionBy("tree", "_part").orderBy(*order)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside))
    return (
        null_safe_join(ranked, counts, ["tree", "_part"])
        .withColumn("idx", (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .drop("_part", "_before", "_rank")
    )


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, n, left, right): the digests of a node's block before and after its own, joined."""
    idx = F.col("idx")
    if arity == 2:
        wanted = F.array(idx, idx.bitwiseXOR(1))
    else:
        first = idx - idx % arity
        wanted = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda slot: first + slot)
    asking = nodes.select(
        "tree", "n", idx.alias("node"), F.explode(F.filter(wanted, lambda i: i < F.col("n"))).alias("idx")
    )
    met = null_safe_join(asking, nodes.select("tree", "idx", "digest"), ["tree", "idx"])
    block = F.sort_array(F.collect_list(F.struct("idx", "digest")))
    together = met.groupBy("tree", F.col("node").alias("idx"), "n").agg(block.alias("block"))

    def side(keep) -> Column:
        return F.aggregate(
            F.filter("block", keep), F.lit(b""), lambda joined, sibling: F.concat(joined, sibling["digest"])
        )

    return together.select(
        "tree", "idx", "n", side(lambda s: s["idx"] < F.col("idx")).alias("left"),
        side(lambda s: s["idx"] > F.col("idx")).alias("right"),
        F.filter("block", lambda s: s["idx"] == F.col("idx"))[0]["digest"].alias("digest"),
    )


def _levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per level its nodes that have a parent, with their siblings, and the trees that end there."""
    levels, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        level = cut_lineage(_siblings(nodes.where("n > 1"), arity))
        levels.append(level)
        nodes = level.where(F.col("idx") % arity == 0).select(
            "tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
            F.unhex(digest_of(_hex(F.concat("digest", "right")))).alias("digest"),
        )
        most = -(-most // arity)
    return levels, [*tops, nodes.select("tree", "digest")]


def _with_proofs(
    rows: DataFrame, levels: list[DataFrame], tops: list[DataFrame], above: DataFrame, arity: int
) -> DataFrame:
    """`rows` (tree, idx, ...) with proof and the further columns of `above`.

    `above` has the proof of every tree's top. proof: array of (left, right) from the leaf up, digests as
    bytes. The widest join, that of the leaves with their parents' paths, comes last.
    """
    given = [c for c in above.columns if c not in ("tree", "proof")]
    own = F.array(F.struct("left", "right"))

    def top_paths(k: int) -> DataFrame:
        return null_safe_join(tops[k].select("tree"), above, ["tree"]).select(
            "tree", F.lit(0).cast("long").alias("_up"), "proof", *given
        )

    paths = top_paths(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        level = levels[k].withColumn("_up", F.floor(F.col("idx") / arity))
        paths = null_safe_join(level, paths, ["tree", "_up"]).select(
            "tree", F.col("idx").alias("_up"), F.concat(own, "proof").alias("proof"), *given
        ).union(top_paths(k))
    if levels:
        paths = cut_lineage(paths.union(top_paths(0)))
        beside = levels[0].select("tree", "idx", own.alias("_own"))
    else:
        beside = rows.select("tree", "idx", F.array().cast("array<struct<left:binary,right:binary>>").alias("_own")).limit(0)
    met = null_safe_join(rows, beside, ["tree", "idx"], "left").withColumn("_up", F.floor(F.col("idx") / arity))
    return (
        null_safe_join(met, paths, ["tree", "_up"])
        .withColumn("proof", F.concat(F.coalesce("_own", F.array()), "proof"))
        .drop("_own", "_up")
    )


def manifest(
    leaves: DataFrame, group: str, order: str, leaf: str = "leaf", arity: int = ARITY
) -> DataFrame:
    """`leaves` with subroot, root (hex) and proof (array of (left, right), bytes of digests, leaf upwards)."""
    names = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    packed = cut_lineage(
        leaves.select(
            F.col(group).alias("tree"), F.col(order).alias("by"), F.unhex(F.col(leaf)).alias("digest"),
            F.struct(*names).alias("row"),
        )
    )
    rows = cut_lineage(positions(packed, ["by", "digest"]))
    levels, tops = _levels(rows.select("tree", "idx", "n", "digest"), arity)

    subroots = tops[0]
    for part in tops[1:]:
        subroots = subroots.union(part)
    subroots = cut_lineage(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("by"), "digest"))
    subroots = cut_lineage(positions(subroots, ["by"]))
    upper, roots = _levels(subroots.select("tree", "idx", "n", "digest"), arity)
    root = roots[-1].first()
    root = None if root is None else root["digest"].hex()
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    start = roots[-1].select("tree", nothing.alias("proof"))
    above = _with_proofs(subroots, upper, roots, start, arity).select(
        F.col("by").alias("tree"), "proof", _hex(F.col("digest")).alias("subroot")
    )
    proven = _with_proofs(rows, levels, tops, cut_lineage(above), arity)
    return proven.select("row.*", "subroot", F.lit(root).cast("string").alias("root"), "proof")


def proof_digest(proof: str) -> Column:
    """Digest of all siblings in a proof, level by level, left to right."""
    return digest_of(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""))


def folded(leaf: str, proof: str) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(
        proof, F.col(leaf), lambda own, s: digest_of(F.concat(_hex(s["left"]), own, _hex(s["right"])))
    )
