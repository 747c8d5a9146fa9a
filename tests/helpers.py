"""Short ways to build input tables and to read results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from hindcast import schemas


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def table(spark: SparkSession, schema, rows: list[dict]) -> DataFrame:
    """Rows given as dicts; absent columns are NULL."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def stg(spark: SparkSession, rows: list[dict]) -> DataFrame:
    from decimal import Decimal

    defaults = {
        "cik": "0000000001", "metric_code": "revenue", "period_start": d("2020-10-01"),
        "period_end": d("2020-12-31"), "unit": "USD", "payload_id": 1,
    }
    full = [{**defaults, **row} for row in rows]
    for row in full:
        row["value"] = Decimal(str(row["value"]))
    return table(spark, schemas.STG_FACT, full)


def entities(spark: SparkSession, *ids: int) -> DataFrame:
    return table(
        spark,
        schemas.ENTITY,
        [{"entity_id": i, "cik": f"{i:010d}", "name": f"Company {i}"} for i in ids],
    )


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=repr)
