"""Queries over landings that read only what a batch concerns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import Tables
from hindcast.plans.landing import Landings
from hindcast.session import ensure_checkpoint_dir
from hindcast.sources.lake import Lake


def _landed(t: Tables) -> Landings:
    """Documents land in three batches, the last of which was fetched before the second; one is retried."""
    lake = Lake(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/lake-{uuid.uuid4().hex}")
    landings = Landings(lake, prefix_digits=1, buckets=8)

    def batch(rows: DataFrame, day: str) -> DataFrame:
        fetched = F.unix_seconds(F.lit(day).cast("timestamp")) + F.col("doc_id")
        params = F.map_from_entries(
            F.filter(
                F.array(
                    F.struct(F.lit("ticker").alias("key"), F.col("lang").alias("value")),
                    F.struct(F.lit("cik").alias("key"), (F.col("doc_id") % 40).cast("string").alias("value")),
                    F.struct(F.lit("doc").alias("key"), F.col("doc_id").cast("string").alias("value")),
                ),
                lambda entry: entry["value"].isNotNull(),
            )
        )
        return rows.select(
            F.coalesce("source", F.lit("none")).alias("endpoint"), params.alias("request_params"),
            F.timestamp_seconds(fetched).alias("fetched_at"),
            F.when(F.col("doc_id") % 7 == 0, 500).otherwise(200).alias("http_status"),
            F.coalesce("text", F.lit("")).cast("binary").alias("body"),
        )

    even = batch(t.documents.where("doc_id % 2 = 0"), "2024-01-01 00:00:00")
    landings.land(even, "feed", "first")
    landings.land(batch(t.documents.where("doc_id % 50 < 40"), "2024-06-01 00:00:00"), "feed", "second")
    landings.land(even, "feed", "first")
    landings.land(batch(t.documents, "2024-03-01 00:00:00"), "feed", "third")
    return landings


_BATCHES = """
  t as (select doc_id, coalesce(source, 'none') as endpoint, lang as ticker, cast(doc_id % 40 as varchar) as cik,
               doc_id % 7 = 0 as failed, coalesce(text, '') as text from documents),
  batches as (
    select 1 as batch, date '2024-01-01' as day, * from t where doc_id % 2 = 0
    union all select 2, date '2024-06-01', * from t where doc_id % 50 < 40
    union all select 3, date '2024-03-01', * from t)"""


def _doc() -> Column:
    return F.col("request_params")["doc"].cast("bigint").alias("doc_id")


@query(
    f"""with {_BATCHES}
        select doc_id, batch, cast(row_number() over (partition by text order by batch, doc_id) > 1 as bigint) as unchanged
        from batches"""
)
def land_increment(t: Tables) -> DataFrame:
    landings = _landed(t)
    month = F.month("fetched_at")
    log = landings.payloads().select("payload_id", "request_params", "fetched_at")
    return landings.flags().join(log, "payload_id").select(
        _doc(),
        F.when(month < 3, 1).when(month >= 6, 2).otherwise(3).alias("batch"),
        F.col("content_unchanged").alias("unchanged"),
    )


@query(
    f"""with {_BATCHES}
        select endpoint, ticker, strftime(max(day + to_seconds(doc_id)), '%Y-%m-%d %H:%M:%S') as newest,
               strftime(max(day + to_seconds(doc_id)) filter (not failed), '%Y-%m-%d %H:%M:%S') as newest_ok
        from batches group by all"""
)
def latest_state(t: Tables) -> DataFrame:
    """The newest response per endpoint and ticker, out of the maintained table, whatever the order of arrival."""
    landings = _landed(t)
    by = ["endpoint", "ticker"]
    anyhow = landings.latest_ids(by, ok_only=False)
    good = landings.latest_ids(by).select(*[F.col(name).alias(f"g_{name}") for name in by], F.col("fetched_at").alias("newest_ok"))
    same = [F.col(name).eqNullSafe(F.col(f"g_{name}")) for name in by]
    return anyhow.join(good, same, "left").select(*by, F.col("fetched_at").alias("newest"), "newest_ok")


@query(
    f"""with {_BATCHES}
        select cik, doc_id, sha256(text) as body_sha256 from batches where not failed
        qualify row_number() over (partition by cik order by day + to_seconds(doc_id) desc) = 1"""
)
def latest_ok_bodies(t: Tables) -> DataFrame:
    """The newest good body per company; only landings that hold one are opened."""
    newest = _landed(t).latest(["cik"])
    return newest.select(F.col("request_params")["cik"].alias("cik"), _doc(), F.sha2("body", 256).alias("body_sha256"))
