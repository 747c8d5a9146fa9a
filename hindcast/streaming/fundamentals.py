"""Keeping the fundamental fact table current from a growing log of observations or documents.

Every micro-batch is one load of `plans.increment`: it touches the keys it names, splices late filings
into their chains and is published in one step, together with the batch's number. A batch that Spark
repeats after a failure is recognized by that number and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hindcast import schemas
from hindcast.config import MetricMap
from hindcast.plans import increment
from hindcast.plans.load import FUNDAMENTAL_SOURCE
from hindcast.sources import vendor
from hindcast.sources.lake import Lake


def start_fundamental_refresh(
    lake: Lake,
    source_path: str,
    *,
    lag_days: int,
    metrics: MetricMap | None = None,
    buckets: int = increment.BUCKETS,
    lineage_checked: bool = True,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process what lies at `source_path`, then stop; a later start goes on from there.

    The folder holds staged facts, or with `metrics` the payload log, whose company-facts documents are
    parsed. Progress is kept beside the table; both belong together.
    """
    spark = lake.spark
    schema = schemas.STG_FACT if metrics is None else schemas.PAYLOAD

    def staged(batch: DataFrame) -> DataFrame:
        if metrics is None:
            return batch
        documents = batch.where(
            (F.col("source") == FUNDAMENTAL_SOURCE) & (F.col("endpoint") == "companyfacts") & (F.col("http_status") == 200)
        )
        return vendor.parse_companyfacts(documents, metrics)

    def refresh(batch: DataFrame, number: int) -> None:
        increment.load_observations(
            lake, staged(batch), lag_days, buckets=buckets, batch=number, lineage_checked=lineage_checked
        )

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(source_path)
        .writeStream.foreachBatch(refresh)
        .option("checkpointLocation", f"{lake.path(increment.FACTS)}/progress")
        .trigger(availableNow=True)
        .start()
    )
