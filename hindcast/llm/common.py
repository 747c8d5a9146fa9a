"""What several operators share: words, row numbers without a global sort, connected components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.session import cut_lineage

# White space that separates words in every contract: blank and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"

ROWS_PER_BUCKET = 2_048
BUCKET_BITS = 16


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this library from where the driver has it.

    On a cluster that doesn't have it there, ship it with spark.submit.pyFiles.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def numbered(df: DataFrame, name: str, key: Column, ties: list[str], within: Column | None = None):
    """`df` with `name`: the 0-based position of a row within its group, in the order of md5(key).

    One exchange of `df`. The md5 order is cut into buckets of about ROWS_PER_BUCKET rows (at most
    2^BUCKET_BITS of them), so that a group of any size is spread over many tasks: the rows before a
    bucket come from a small table of counts, the rank inside it from a window. The order depends on
    the rows alone, not on files or partitions. `ties` order rows of equal key; rows equal in those
    too are interchangeable. `df` is counted here, so give it as a scan or a stored table.
    """
    rows = df.count()
    bits = min(BUCKET_BITS, max(0, (rows // ROWS_PER_BUCKET).bit_length()))
    group = F.lit("") if within is None else F.coalesce(F.concat(F.lit("="), within), F.lit(""))
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))

    def placed(frame: DataFrame) -> DataFrame:
        high = F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
        return frame.withColumns({"_digest": digest, "_group": group}).withColumn(
            "_bucket", F.shiftright(high, 16 - bits)
        )

    counts = placed(df).groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_group", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_group", "_bucket").orderBy("_digest", *ties)
    ranked = placed(df).withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(offsets, ["_group", "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
        .drop("_digest", "_group", "_bucket", "_offset", "_rank")
    )


def in_stored_order(docs: DataFrame) -> DataFrame:
    """(row, n): the rows of `docs` as structs, numbered from 0 by the files they are stored in, then place.

    Dense and unique, from what the Parquet reader knows: rows don't move, and nothing is hashed. A
    table that was written sorted is numbered in that order. What isn't a scan of files is stored first.
    The rows before a file come from a table with one row per file, stored so that its size is known when
    the join is planned: rows are shuffled only if it is too large to broadcast.
    """
    places = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        placed = docs.select(F.struct("*").alias("row"), *places)
    except AnalysisException:
        placed = cut_lineage(docs).select(F.struct("*").alias("row"), *places)
    sizes = placed.groupBy("file").agg((F.max("at") + 1).alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")))
    return placed.join(sizes, "file").select("row", (F.col("before") + F.col("at")).cast("long").alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of `edges` (a, b) with the smallest node it is connected to.

    Alternating large and small stars. A round writes its edges to the shared folder, and the loop
    ends when a round changes nothing. Only counts and one checksum reach the driver.
    """

    def state(frame: DataFrame) -> tuple:
        checksum = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(frame.agg(F.count(F.lit(1)), checksum).first())

    current = cut_lineage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    seen = state(current)
    while seen[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = cut_lineage(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = state(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
