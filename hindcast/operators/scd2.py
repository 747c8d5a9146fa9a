"""Bitemporal entity-to-ticker mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions.scalar import stable_id


def one_per_cik(seen: DataFrame) -> DataFrame:
    """`seen(cik, name, ticker, ordinal)` with one row per cik: that of the greatest ordinal.

    A company may have several tickers in a universe; its last one in universe order names it.
    """
    last = F.max_by(F.struct("name", "ticker"), F.struct("ordinal", "ticker"))
    return seen.groupBy("cik").agg(last.alias("__s")).select("cik", "__s.*")


def merge_entities(entity: DataFrame, seen: DataFrame) -> DataFrame:
    """Entities after a parse that saw `seen(cik, name)`, unique by cik: new ones added, names
    refreshed."""
    fresh = seen.select("cik", F.col("name").alias("new_name"))
    return entity.join(fresh, "cik", "full_outer").select(
        F.coalesce("entity_id", stable_id("cik")).alias("entity_id"),
        "cik",
        F.coalesce("new_name", "name").alias("name"),
    )


def merge_ticker_mapping(
    mapping: DataFrame, current: DataFrame, detected_at: Column
) -> DataFrame:
    """Mapping after seeing `current(entity_id, ticker)` at `detected_at`.

    An unchanged ticker is left alone. A changed one is closed at `detected_at`, and the new one
    opens there, since that is when the change was learnt. An entity mapped for the first time
    opens at the first-mapping instant, unless another entity held that ticker before: then its
    history belongs to the other one and the mapping opens at `detected_at`.
    """
    is_open = F.col("knowledge_to") == schemas.open_end()
    opened = mapping.where(is_open)
    closed = mapping.where(~is_open)

    now = current.select("entity_id", F.col("ticker").alias("now_ticker"))
    merged = opened.join(now, "entity_id", "full_outer")
    reassigned = F.col("ticker").isNotNull() & (F.col("now_ticker") != F.col("ticker"))

    kept = merged.where(F.col("ticker").isNotNull()).select(
        "entity_id",
        "ticker",
        "knowledge_from",
        F.when(F.coalesce(reassigned, F.lit(False)), detected_at)
        .otherwise(F.col("knowledge_to"))
        .alias("knowledge_to"),
    )
    starting = merged.where(F.col("ticker").isNull() | reassigned).select(
        "entity_id",
        F.col("now_ticker").alias("ticker"),
        F.col("ticker").isNotNull().alias("reassigned"),
    )
    held_before = mapping.select("ticker").distinct().withColumn("held", F.lit(True))
    opening = starting.join(held_before, "ticker", "left").select(
        "entity_id",
        "ticker",
        F.when(F.col("reassigned") | F.col("held").isNotNull(), detected_at)
        .otherwise(schemas.first_mapping_start())
        .alias("knowledge_from"),
        schemas.open_end().alias("knowledge_to"),
    )
    return closed.unionByName(kept).unionByName(opening)
