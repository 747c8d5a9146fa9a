"""Keeping a price fact table current from the growing payload log.

New payloads are parsed once and appended to a staging table; then the chains of the buckets they
touch are recomputed from staging and written to a folder of their own, and a small table that says
where each bucket lies is replaced as a whole: readers see all of a refresh or nothing of it. Buckets
whose ticker mapping has changed are recomputed too, when a refresh starts. Chains come from the same operator as
in a batch load, so late and repeated deliveries end in the same table as loading everything at
once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from hindcast import schemas
from hindcast.operators import chain
from hindcast.sources import payloads, vendor
from hindcast.sources.lake import CODEC, Lake

BUCKETS = 256
# So many buckets are written from where their chains were made.
FEW_BUCKETS = 16
CONTENT = "price_content"
# Where the facts of a bucket lie (NULL: it has none), and a digest of the mapping they were made with.
_CONTENT = schemas.table("bucket int, folder string, mapping bigint")


def bucket_of(ticker: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def start_price_refresh(
    spark: SparkSession,
    payload_path: str,
    source: str,
    mapping: DataFrame,
    *,
    lag_days: int,
    state_path: str,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Process what the log at `payload_path` holds, then stop; a later start continues there.

    `state_path` holds the stream's progress, the staging table and the fact table. A batch that is
    repeated after a failure stages its rows again: exact repeats are no new versions.
    """
    staging = f"{state_path}/price_row"
    lake = Lake(spark, state_path)
    staged_schema = T.StructType(
        [*schemas.PRICE_ROW.fields, T.StructField("bucket", T.IntegerType())]
    )
    digests = _mapping_digests(mapping, buckets)

    def rebuild(touched: set[int]) -> None:
        """Recompute the touched buckets, and those whose mapping isn't the one they were made with."""
        before = {row.bucket: row for row in lake.read(CONTENT, _CONTENT).collect()}
        stale = touched | {b for b, row in before.items() if row.mapping != digests.get(b)}
        if not stale:
            return
        # At most `buckets` numbers; as literals they prune the staging partitions.
        rows = spark.read.schema(staged_schema).parquet(staging).where(F.col("bucket").isin(sorted(stale)))
        folder = f"{state_path}/price_fact/load={uuid.uuid4().hex}"
        facts = chain.price_facts(rows, mapping, lag_days=lag_days, keep=["bucket"])
        # Each task of the chain adds a file to each bucket. Where that would be many, rows move once more.
        if len(stale) > FEW_BUCKETS:
            facts = facts.hint("rebalance", "bucket")
        facts.write.partitionBy("bucket").parquet(folder, compression=CODEC)
        written = spark.read.schema(staged_schema).parquet(folder)
        filled = {row[0] for row in written.select("bucket").distinct().collect()}
        # A bucket without facts keeps its row, which says for which mapping it has none.
        fresh = [(b, f"{folder}/bucket={b}" if b in filled else None, digests.get(b)) for b in sorted(stale)]
        kept = [tuple(row) for b, row in before.items() if b not in stale]
        lake.replace(CONTENT, spark.createDataFrame([*kept, *fresh], _CONTENT).coalesce(1))

    def refresh(batch: DataFrame, _: int) -> None:
        parsed = vendor.parse_prices(payloads.price_payloads(batch, source), source).withColumn(
            "bucket", bucket_of(F.col("ticker"), buckets)
        )
        parsed.write.mode("append").partitionBy("bucket").parquet(staging, compression=CODEC)
        named = payloads.price_payloads(batch, source).select(bucket_of(payloads.ticker_of(), buckets))
        rebuild({row[0] for row in named.distinct().collect()})

    rebuild(set())
    log = spark.readStream.schema(schemas.PAYLOAD).parquet(payload_path)
    return (
        log.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", f"{state_path}/progress")
        .trigger(availableNow=True)
        .start()
    )


def _mapping_digests(mapping: DataFrame, buckets: int) -> dict[int, int]:
    """A digest of the mapping rows of every bucket that has some."""
    row = F.xxhash64(*sorted(mapping.columns))
    digest = F.xxhash64(F.bit_xor(row), F.count(F.lit(1)))
    grouped = mapping.groupBy(bucket_of(F.col("ticker"), buckets).alias("bucket")).agg(digest.alias("digest"))
    return {r.bucket: r.digest for r in grouped.collect()}


def read_price_facts(spark: SparkSession, state_path: str) -> DataFrame:
    """All buckets as the last refresh published them."""
    content = Lake(spark, state_path).read(CONTENT, _CONTENT).where("folder is not null")
    folders = [row.folder for row in content.collect()]
    if not folders:
        return spark.createDataFrame([], schemas.PRICE_FACT)
    return spark.read.schema(schemas.PRICE_FACT).parquet(*folders)
