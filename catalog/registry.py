"""Name -> (Spark query, DuckDB SQL), and the common presentation of result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shown(df: DataFrame) -> DataFrame:
    """Columns in types that both engines print alike: text, bigint, rounded double."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        match field.dataType:
            case T.DateType():
                column = column.cast("string")
            case T.TimestampType() | T.TimestampNTZType():
                column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
            case T.DecimalType() | T.DoubleType() | T.FloatType():
                # Adding zero turns a rounded -0.0 into 0.0.
                column = F.round(column.cast("double"), 6) + F.lit(0.0)
            case T.IntegerType() | T.ShortType() | T.ByteType() | T.BooleanType():
                column = column.cast("bigint")
            case T.ArrayType():
                column = F.array_join(column, ",")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(sql: str | None = None, name: str | None = None):
    """Registers `fn(tables)` as a query, with the SQL that must give the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, directory: shown(fn(Tables(spark, directory)))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
