"""Feed freshness against SLAs, and what is downstream of a failing feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.calendar import staleness_days
from hindcast.operators.frames import broadcast_if_small
from hindcast.session import cut_lineage

AT_RISK_STATUSES = ["stale", "breach"]


def feed_status(payload: DataFrame, sla: DataFrame, as_of: Column) -> DataFrame:
    """Status per feed of `sla(source, expected_refresh_days, max_staleness_days)`.

    A feed that never delivered is `no_data`, which is not the same as one that stopped.
    """
    newest = payload.groupBy("source").agg(F.max("fetched_at").alias("last_fetched_at"))
    late = staleness_days(as_of, F.col("last_fetched_at"))
    return (
        sla.join(newest, "source", "left")
        .withColumn("staleness_days", late)
        .withColumn(
            "status",
            F.when(F.col("last_fetched_at").isNull(), "no_data")
            .when(F.col("staleness_days") > F.col("max_staleness_days"), "breach")
            .when(F.col("staleness_days") > F.col("expected_refresh_days"), "stale")
            .otherwise("ok"),
        )
        .select("source", "last_fetched_at", "staleness_days", "status")
    )


# Levels of edges followed between two stored tables.
LEVELS = 2
_ROOTS_A_GROUP = 100_000
# Words of up to 64 names each: some tens of megabytes.
_BROADCAST_WORDS = 5_000


def _numbered(roots: DataFrame) -> DataFrame:
    """(root, word, bit): a bit of its own for every root, 64 to a word.

    Roots are ranked inside groups by hash, so that no task ranks them all.
    """
    distinct = cut_lineage(roots.select("root").where("root is not null").distinct())
    groups = max(1, -(-distinct.count() // _ROOTS_A_GROUP))
    group = F.pmod(F.xxhash64("root"), F.lit(groups))
    placed = distinct.withColumn("__group", group).withColumn(
        "__n", F.row_number().over(Window.partitionBy("__group").orderBy("root")) - 1
    )
    return cut_lineage(
        placed.select(
            "root",
            (F.shiftleft("__group", 32) + F.expr("__n div 64")).alias("word"),
            F.expr("shiftleft(1L, cast(__n % 64 as int))").alias("bit"),
        )
    )


def _followed(bits: DataFrame, graph: DataFrame) -> DataFrame:
    """Bits of nodes, given to what lies one edge further."""
    step = bits.join(graph, F.col("node") == F.col("src"))
    return step.groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))


def _reached(edges: DataFrame, numbered: DataFrame) -> DataFrame:
    """(node, word, bits): the roots that reach a node, as bits of words.

    A node has one row for up to 64 roots, and sets of roots that meet in a node are joined by OR, before
    the shuffle where they can. After every `LEVELS` levels the sets are stored once, with the bits that
    are new; without new bits the sets are complete, so cycles end.
    """
    graph = cut_lineage(edges.select("src", "dst").distinct())
    frontier = numbered.select(F.col("root").alias("node"), "word", F.col("bit").alias("bits"))
    state = None
    while True:
        grown = _followed(frontier, graph)
        for _ in range(LEVELS - 1):
            both = grown.unionByName(_followed(grown, graph))
            grown = both.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        new = grown.select("node", "word", F.lit(0).cast("bigint").alias("old"), F.col("bits").alias("new"))
        if state is not None:
            new = new.unionByName(
                state.select("node", "word", F.col("bits").alias("old"), F.lit(0).cast("bigint").alias("new"))
            )
        sets = new.groupBy("node", "word").agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new"))
        old, found = F.col("old"), F.col("new")
        state = cut_lineage(
            sets.select(
                "node", "word", old.bitwiseOR(found).alias("bits"),
                found.bitwiseAND(F.bitwise_not(old)).alias("fresh"),
            )
        )
        frontier = state.where("fresh <> 0").select("node", "word", F.col("fresh").alias("bits"))
        if frontier.isEmpty():
            return state.drop("fresh")


def downstream(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): every node reachable over `edges(src, dst)` from each of `roots(root)`.

    A root is among its own nodes only if it lies on a cycle. NULL roots, sources and targets lead
    nowhere. There are half as many stored tables as levels; see `_reached`.
    """
    numbered = _numbered(roots)
    sets = _reached(edges.where("dst is not null"), numbered)
    # At most 64 roots a word. Words that are too many to broadcast are too many for one to be hot.
    words = cut_lineage(numbered.groupBy("word").agg(F.collect_list(F.struct("root", "bit")).alias("members")))
    found = sets.join(broadcast_if_small(words, words.count(), _BROADCAST_WORDS), "word").select(
        "node",
        F.explode(
            F.filter("members", lambda m: m["bit"].bitwiseAND(F.col("bits")) != 0)
        ).alias("m"),
    )
    return found.select("m.root", "node")


def at_risk(status: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_feeds): nodes downstream of feeds that are stale or in breach.

    Feeds are counted as bits; pairs of feed and node are not written out.
    """
    failing = status.where(F.col("status").isin(AT_RISK_STATUSES)).select(
        F.col("source").alias("root")
    )
    sets = _reached(edges.where("dst is not null"), _numbered(failing))
    return sets.groupBy("node").agg(F.sum(F.bit_count("bits")).alias("n_feeds"))
