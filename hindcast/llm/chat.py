"""Reply trees formatted as conversations.

`replies` says which message answers which: rows of (tree, node, parent, score). A path goes from a
root (no parent, or one that isn't there) to a leaf. Paths come from iterative self-joins that double
their reach: joined with itself on the ancestor, a table of ancestors at distance 2^k gives that at
2^(k+1), with the length and score of the stretch passed. A tree takes part while it has more than 2^k nodes,
so the number of joins is the logarithm of the depth, and most trees leave early.

The branches of a tree are ranked by the mean score of their nodes, then length, then leaf id. A tree
whose deepest path holds all its nodes has one branch; the others' chosen branches are walked back
from the leaf over the same tables, largest distances first. Message texts move once, to their tree.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Inside roles and texts a backslash is
doubled and `<|` becomes `<\\|`, so no control string occurs in them and every text can be read back;
a line feed in a role gets a backslash before it. The loss mask is a list of spans of code points:
the texts of assistant turns, without marks.

NULL roles and texts are empty. A NULL tree is a tree of its own, a NULL node a node that nobody answers. Several messages of one node are formatted one after the other by role, then text. Of repeated
replies to one node the smallest parent and the largest score count; a NULL score is 0. Nodes on a
cycle have no root and are left out with all that answers them. Empty tables give no rows. Texts of any
length are whole; a formatted conversation is one string, so it must fit in one (2 GB). Further columns
of the inputs are not used, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.frames import null_safe_join
from hindcast.session import cut_lineage

START, STOP = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
# Messages of branched trees with more nodes are cut to the chosen paths before they meet in a task.
LARGE_TREE = 100_000


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


_TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(STOP), re.DOTALL)


def _rooted(replies: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node below a root, and the tables of ancestors.

    (tree, node, n, length, total): nodes of the tree, nodes from the root to this one, their scores.
    And per k (tree, node, up), where `up` is the ancestor 2^k above.
    """
    nodes = replies.groupBy("tree", "node").agg(
        F.min("parent").alias("up"), F.coalesce(F.max("score").cast("double"), F.lit(0.0)).alias("total")
    )
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    state = cut_lineage(null_safe_join(nodes, sizes, ["tree"]).withColumn("length", F.lit(1)))
    most = state.agg(F.max("n")).first()[0] or 0
    own_parent = F.coalesce(F.col("up") == F.col("node"), F.lit(False))
    finished = [state.where((F.col("n") == 1) & ~own_parent)]
    ancestors, reach = [], 1
    while reach < most:
        going = state.where(F.col("n") > reach)
        above = going.select(*[F.col(c).alias(f"_{c}") for c in ("tree", "node", "up", "length", "total")])
        met = F.col("_length").isNotNull()
        joined = cut_lineage(
            going.join(
                above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_node")), "left"
            ).select(
                "tree", "node", "n", F.when(met, F.col("up")).alias("up"), F.col("_up").alias("next"),
                F.when(met, F.col("length") + F.col("_length")).otherwise(F.col("length")).alias("length"),
                F.when(met, F.col("total") + F.col("_total")).otherwise(F.col("total")).alias("total"),
            )
        )
        ancestors.append(joined.where("up is not null").select("tree", "node", "up"))
        state = joined.drop("up").withColumnRenamed("next", "up")
        reach *= 2
        settled = state.where(F.col("n") <= reach)
        finished.append(settled.where("up is null"))
        open_ = settled.where("up is not null")
        if open_.first() is not None:
            # What is above is missing (then the stretch began at a root), on a cycle or below one.
            known = settled.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
            same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_node"))
            finished.append(open_.join(known, same, "left_anti"))
    columns = ["tree", "node", "n", "length", "total"]
    whole = finished[0].select(*columns)
    for part in finished[1:]:
        whole = whole.union(part.select(*columns))
    return whole, ancestors


def ranked_paths(replies: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, node, position) of the `keep` best branches of every tree.

    position counts from 0 at the root. A node is on at most `keep` of these paths.
    """
    nodes, ancestors = _rooted(replies)
    shape = nodes.groupBy("tree").agg(
        F.max("length").alias("deepest"), F.max("n").alias("n"),
        F.max_by(F.struct(F.col("node").alias("leaf"), "total"), "length").alias("last"),
    )
    shape = cut_lineage(shape)
    plain = shape.where("deepest = n").select(
        "tree", F.col("last.leaf").alias("leaf"), F.lit(1).alias("rank"),
        (F.col("last.total") / F.col("n")).alias("score"),
    )
    straight = null_safe_join(nodes, plain, ["tree"]).select(
        "tree", "leaf", "rank", "score", "node", (F.col("length") - 1).alias("position")
    )
    branched = shape.where("deepest < n").select("tree")
    if branched.first() is None:
        return straight
    nodes = cut_lineage(null_safe_join(nodes, branched, ["tree"], "left_semi"))
    answered = ancestors[0].select("tree", F.col("up").alias("node"))
    leaves = null_safe_join(nodes, answered, ["tree", "node"], "left_anti")
    score = F.col("total") / F.col("length")
    best = Window.partitionBy("tree").orderBy(score.desc(), F.col("length").desc(), "node")
    pairs = (
        leaves.withColumns({"score": score, "rank": F.row_number().over(best)})
        .where(F.col("rank") <= keep)
        .select("tree", F.col("node").alias("leaf"), "rank", "score", "node", (F.col("length") - 1).alias("position"))
    )
    for k in range(len(ancestors) - 1, -1, -1):
        pairs = cut_lineage(pairs)
        up = ancestors[k]
        further = null_safe_join(pairs, up, ["tree", "node"]).select(
            "tree", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position")
        )
        pairs = pairs.union(further)
    return straight.union(pairs)


def formatted(messages: DataFrame, replies: DataFrame | None = None, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_spans) of the `keep` best branches of every tree.

    `messages` has tree, node, role and text; `replies` tree, node, parent and score, by default of the
    same rows. loss_spans: array of (begin, end), end exclusive, in code points. Texts are shuffled
    once, to the tree they belong to; those of large branched trees first to their node, where messages
    off the chosen paths are dropped.
    """
    replies = messages if replies is None else replies
    replies = replies.select("tree", "node", "parent", "score")
    place = F.struct("rank", "leaf", "score", "position")
    paths = ranked_paths(replies, keep).select("tree", "node", place.alias("place"))
    own = messages.select("tree", "node", "role", "text")
    large = replies.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_TREE).select("tree")
    if large.first() is not None:
        paths = cut_lineage(paths)
        chosen = null_safe_join(paths.select("tree", "node").distinct(), large, ["tree"], "left_semi")
        own = null_safe_join(own, large, ["tree"], "left_anti").union(
            null_safe_join(null_safe_join(own, large, ["tree"], "left_semi"), chosen, ["tree", "node"], "left_semi")
        )
    nowhere = F.lit(None).cast(paths.schema["place"].dataType)
    marks = paths.select("tree", "node", "place", F.lit(None).alias("role"), F.lit(None).alias("text"))
    here = Window.partitionBy("tree", "node")
    inside = Window.partitionBy("tree", "rank").orderBy("position", "role", "text")
    head = F.concat(
        F.lit(START), F.replace(_escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n")
    )
    size = F.length("head") + F.length("body") + len(STOP)
    turns = (
        own.select("tree", "node", nowhere.alias("place"), "role", "text")
        .union(marks)
        .repartition("tree")
        .withColumn("places", F.collect_list("place").over(here))
        .where("place is null")
        .select("tree", F.explode("places").alias("p"), F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"))
        .select("tree", "p.*", "role", "text")
        .withColumn("i", F.row_number().over(inside))
        .select("tree", "rank", "leaf", "score", "i", "role", head.alias("head"), _escaped(F.col("text")).alias("body"))
        .withColumn("end", F.sum(size).over(Window.partitionBy("tree", "rank").orderBy("i")) - len(STOP))
    )
    span = F.struct((F.col("end") - F.length("body")).alias("begin"), "end")
    whole = turns.groupBy("tree", "rank").agg(
        F.first("leaf").alias("leaf"),
        F.first("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("i", F.concat("head", "body", F.lit(STOP)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role") == LEARNED_ROLE, span))).alias("loss_spans"),
    )
    return whole.select(
        "tree", "leaf", "rank", "score", F.array_join("turns.turn", "").alias("formatted"), "loss_spans"
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """`conversations` with roles, texts and learned (unescaped texts under the mask), from `formatted`."""

    @F.pandas_udf("roles array<string>, texts array<string>, learned array<string>")
    def parsed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for wholes, masks in batches:
            rows = []
            for whole, mask in zip(wholes, masks):
                turns = _TURN.findall(whole)
                rows.append((
                    [_unescaped(role) for role, _ in turns],
                    [_unescaped(text) for _, text in turns],
                    [_unescaped(whole[span["begin"] : span["end"]]) for span in mask],
                ))
            yield pd.DataFrame(rows, columns=["roles", "texts", "learned"])

    return conversations.withColumn("read", parsed("formatted", "loss_spans")).select(
        *conversations.columns, "read.*"
    )


def turn_number(turn: str = "turn") -> Column:
    """The node of a turn of a conversation without branches; a NULL turn comes before all others."""
    return F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63)))


def linear(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Replies (tree, node, parent, score) of conversations without branches: each turn answers the last.

    Nodes are those of `turn_number`. Only the two columns are shuffled.
    """
    number = turn_number(turn)
    earlier = Window.partitionBy("tree").orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
    return conversations.select(F.col(conv).alias("tree"), number.alias("node")).select(
        "tree", "node", F.max("node").over(earlier).alias("parent"), F.lit(0.0).alias("score")
    )
