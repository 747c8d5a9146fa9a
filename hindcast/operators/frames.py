"""Helpers shared by the operators: null-safe joins, bounded broadcasts, literal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table whose row count is known on the driver is broadcast up to this size. Beyond it the join
# is left to the optimizer, which shuffles both sides.
BROADCAST_ROWS = 100_000


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the key columns of `left` only."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    condition = [F.col(key).eqNullSafe(F.col(f"__r_{key}")) for key in keys]
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def broadcast_if_small(
    df: DataFrame, known_rows: int, limit: int = BROADCAST_ROWS
) -> DataFrame:
    return F.broadcast(df) if known_rows <= limit else df


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of driver-side configuration, broadcast when it is small."""
    return broadcast_if_small(spark.createDataFrame(list(rows), schema), len(rows))


def typed(df: DataFrame, schema) -> DataFrame:
    """Exactly the columns of `schema`, in order and cast; columns `df` lacks become NULL."""
    columns = set(df.columns)
    return df.select(
        *[
            (F.col(field.name) if field.name in columns else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema.fields
        ]
    )

