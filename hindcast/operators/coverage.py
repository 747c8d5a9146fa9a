"""Which expected metrics each (cik, fiscal year, fiscal period) has and lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_presence(facts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(cik, fiscal_year, fiscal_period, missing): the expected metrics without any fact.

    Only expected metrics are collected, so a group's set is no larger than that list. Facts
    outside the fiscal calendar are left out.
    """
    present = F.collect_set(
        F.when(F.col("metric_code").isin(list(expected)), F.col("metric_code"))
    )
    return (
        facts.where(F.col("fiscal_year").isNotNull() & F.col("fiscal_period").isNotNull())
        .groupBy("cik", "fiscal_year", "fiscal_period")
        .agg(present.alias("present"))
        .select(
            "cik",
            "fiscal_year",
            "fiscal_period",
            F.array_except(F.lit(sorted(expected)), "present").alias("missing"),
        )
    )


def coverage_gaps(facts: DataFrame, tickers: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Entity-quarters lacking metrics, with `?` for a cik without ticker in `tickers`."""
    gaps = metric_presence(facts, expected).where(F.size("missing") > 0)
    return gaps.join(tickers.select("cik", "ticker"), "cik", "left").select(
        "cik",
        F.coalesce("ticker", F.lit("?")).alias("ticker"),
        "fiscal_year",
        "fiscal_period",
        F.col("missing").alias("missing_metrics"),
    )


def coverage_summary(facts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row: entity-quarters, fully covered ones and the percentage (0.0 without any)."""
    return (
        metric_presence(facts, expected)
        .agg(
            F.count(F.lit(1)).alias("total_entity_quarters"),
            F.count_if(F.size("missing") == 0).alias("fully_covered"),
        )
        .withColumn(
            "coverage_pct",
            F.coalesce(
                F.try_divide(F.col("fully_covered") * 100.0, F.col("total_entity_quarters")),
                F.lit(0.0),
            ),
        )
    )


def ordered_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy("ticker", "fiscal_year", "fiscal_period")
