"""A corpus from documents to shards: five stages, each the operator of one module of the library.

Stages read and write whole tables. Input rows travel as one struct beside the few columns an
operator looks at, so further columns of any name pass through untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import decontam, mixing, quality, sharding, simhash
from hindcast.llm.common import importable, in_stored_order
from hindcast.session import ensure_checkpoint_dir

# Near-duplicate groups and leak templates have no SQL form; tests compare with brute force.
ORACLE_SQL = None

# A character of a word.
WORD = r"[^\x20\x09-\x0D]"


def _packed(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), *columns)


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """The row as a struct, and `k`, its place in the stored table: unique, so no row stands for another."""
    return in_stored_order(docs).select(
        "row", F.col("n").alias("k"), *[F.col(f"row.{c}").alias(c) for c in columns]
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every threshold."""
    return quality.judged(_packed(docs, "text")).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id.

    Rows equal in id and text stay once. Documents with NULL ids form groups like any other and are
    kept before others of their group; documents without words are no duplicates of each other
    unless they are equal.
    """
    importable(spark)
    numbered = _numbered(docs, "doc_id", "text").fillna("", ["text"])
    groups = simhash.similar_groups(numbered.select("k", "text"), "k")
    # Texts without words have no shingles to compare: equal rows of them are one.
    wordless = numbered.where(~F.col("text").rlike(WORD)).select("k", "doc_id", "text")
    first_of = wordless.groupBy("doc_id", "text").agg(F.min("k").alias("first"))
    same = F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.text") == F.col("f.text"))
    again = wordless.alias("w").join(first_of.alias("f"), same).where("k <> first").select("k")
    first = simhash.first_of_groups(numbered.select("k", "doc_id"), groups)
    return numbered.join(first, "k", "left_semi").join(again, "k", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _numbered(docs, "text")
    leaked = decontam.leaks(keyed.select("k", "text"), items, key="k").select(F.col("doc_id").alias("k"))
    return keyed.select("row", "k").join(leaked.distinct(), "k", "left_anti").select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mix, which sharding keeps.

    A source that has run out leaves its slots, and the others move up: they go on with their weights
    relative to each other until every row is placed.
    """
    packed = _packed(docs, "doc_id", "source", F.xxhash64("text").alias("h"))
    mixed = mixing.mixed(packed, ties=["doc_id", "h"])
    return mixed.orderBy("position", "doc_id", "h").select("row.*")


def sharding_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard and slot; replaces columns of these names.

    Rows are taken in the order they are stored in and shuffled inside windows, so the first slots of
    all shards together hold the first rows of the mix, in its weights.
    """
    importable(spark)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = sharding.sharded_in_order(_numbered(docs), "k")
    return placed.select(*[F.col(f"row.`{c}`") for c in own], "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("sharding", sharding_rows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over documents. Every other stage is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
