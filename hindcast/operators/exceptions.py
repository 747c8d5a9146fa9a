"""Lifecycle of data-quality exceptions: open, triage, closed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions.scalar import stable_id
from hindcast.operators.checks import severity_rank

ACTIVE = ["open", "triage"]
AUTO_RESOLVED = "auto-resolved: check passed again"

_KEY = ["check_name", "dimension_key"]


def verdicts(results: DataFrame) -> DataFrame:
    """The result that decides per (check, dimension key) in one run.

    Usually there is one. Of several the last by `ordinal` decides, and a failure at equal ordinal.
    """
    order = F.struct("ordinal", (F.col("status") == "fail").alias("failing"))
    decisive = F.max_by(F.struct("status", "severity", "entity_id"), order)
    return results.groupBy(*_KEY).agg(decisive.alias("__v")).select(*_KEY, "__v.*")


def advance(exceptions: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Exceptions after a run.

    A failure opens one unless one is active for its key; a pass closes the active one. Everything
    else stays, including exceptions whose key was not evaluated. Severity stays as it was when
    opened; `last_severity` follows the latest failure. Only active exceptions take part in the
    join, closed ones pass through.
    """
    is_active = F.col("status").isin(ACTIVE)
    active = exceptions.where(is_active)
    history = exceptions.where(~is_active)

    seen = verdicts(results).select(
        *_KEY,
        F.col("status").alias("verdict"),
        F.col("severity").alias("new_severity"),
        F.col("entity_id").alias("new_entity_id"),
    )
    merged = active.join(seen, _KEY, "full_outer").where(
        F.col("exception_id").isNotNull() | (F.col("verdict") == "fail")
    )
    is_new = F.col("exception_id").isNull()
    closes = ~is_new & (F.coalesce("verdict", F.lit("")) == "pass")
    return history.unionByName(
        merged.select(
            F.coalesce("exception_id", stable_id(*_KEY, now)).alias("exception_id"),
            "check_name",
            F.when(is_new, F.col("new_entity_id")).otherwise(F.col("entity_id")).alias("entity_id"),
            "dimension_key",
            F.coalesce("severity", "new_severity").alias("severity"),
            F.when(F.col("verdict") == "fail", F.col("new_severity"))
            .otherwise(F.col("last_severity"))
            .alias("last_severity"),
            F.when(is_new, "open")
            .when(closes, "closed")
            .otherwise(F.col("status"))
            .alias("status"),
            F.when(is_new, now).otherwise(F.col("opened_at")).alias("opened_at"),
            F.when(closes, now).otherwise(F.col("closed_at")).alias("closed_at"),
            F.when(closes, AUTO_RESOLVED)
            .otherwise(F.col("resolution_note"))
            .alias("resolution_note"),
        )
    )


def _checked(exceptions: DataFrame, ids: Sequence[int], allowed: Sequence[str]) -> Column:
    chosen = F.col("exception_id").isin(list(ids)) & F.col("status").isin(list(allowed))
    found = {row[0] for row in exceptions.where(chosen).select("exception_id").distinct().collect()}
    unknown = sorted(set(ids) - found)
    if unknown:
        raise ValueError(f"no {'/'.join(allowed)} exception with id {unknown}")
    return chosen


def triage(exceptions: DataFrame, ids: Sequence[int], note: str) -> DataFrame:
    """Acknowledge open exceptions. The ids are few and named by hand; unknown ones raise."""
    chosen = _checked(exceptions, ids, ["open"])
    return exceptions.withColumns(
        {
            "resolution_note": F.when(chosen, note).otherwise(F.col("resolution_note")),
            "status": F.when(chosen, "triage").otherwise(F.col("status")),
        }
    )


def resolve(exceptions: DataFrame, ids: Sequence[int], note: str, now: Column) -> DataFrame:
    """Close open or acknowledged exceptions by hand."""
    chosen = _checked(exceptions, ids, ACTIVE)
    return exceptions.withColumns(
        {
            "resolution_note": F.when(chosen, note).otherwise(F.col("resolution_note")),
            "closed_at": F.when(chosen, now).otherwise(F.col("closed_at")),
            "status": F.when(chosen, "closed").otherwise(F.col("status")),
        }
    )


def open_exceptions(exceptions: DataFrame) -> DataFrame:
    """Active exceptions, most severe first, then oldest first."""
    return exceptions.where(F.col("status").isin(ACTIVE)).orderBy(
        severity_rank(F.col("severity")), "opened_at", *_KEY
    )


def empty_exceptions(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.EXCEPTION)
