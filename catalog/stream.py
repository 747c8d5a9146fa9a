"""The streaming refresh, checked against the batch meaning of the same payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.oracle import OPEN, day, knowledge, ts
from catalog.registry import query
from catalog.vendor import csv_payloads
from catalog.views import Tables
from hindcast import schemas
from hindcast.plans import load
from hindcast.session import ensure_checkpoint_dir
from hindcast.sources.lake import CODEC, Lake
from hindcast.streaming.prices import read_price_facts, start_price_refresh

_W = (
    "partition by entity_id, trade_date order by fetched_at, payload_id, i, close, adj_close"
)
_SQL = f"""
with rows_ as (
  select l_partkey as entity_id, cast(l_shipdate as date) + i as trade_date,
         case when i = 0 then l_extendedprice end as close,
         case when i = 0 then l_extendedprice * (1 - l_discount) end as adj_close,
         cast(cast(l_shipdate as date) + cast(3 + l_orderkey % 30 as int) as timestamp) as fetched_at,
         l_orderkey * 10 + l_linenumber as payload_id, i
  from lineitem, (select unnest([0, 1]) as i)
  where l_partkey % 5 <> 0),
compared as (
  select *, lag(close) over ({_W}) as pc, lag(adj_close) over ({_W}) as pa, row_number() over ({_W}) as rn
  from rows_),
kept as (
  select *, case when rn = 1 then {knowledge('trade_date')} else fetched_at end as knowledge_from
  from compared where rn = 1 or close is distinct from pc or adj_close is distinct from pa)
select entity_id, {day('trade_date')} as trade_date, round(close, 6) as close,
       round(adj_close, 6) as adj_close, payload_id, {ts('knowledge_from')} as knowledge_from,
       {ts(f'coalesce(lead(knowledge_from) over ({_W}), {OPEN})')} as knowledge_to
from kept"""


def part_mapping(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_partkey") % 5 != 0).select(
        F.col("p_partkey").alias("entity_id"),
        F.concat(F.lit("P"), F.col("p_partkey")).alias("ticker"),
        schemas.first_mapping_start().alias("knowledge_from"),
        schemas.open_end().alias("knowledge_to"),
    )


_FACTS = [
    "entity_id", "trade_date", "close", "adj_close", "payload_id", "knowledge_from", "knowledge_to",
]
_LATER = "cast(l_shipdate as date) + cast(3 + l_orderkey % 30 as int) as timestamp)"


@query(
    _SQL.replace(
        _LATER, f"{_LATER} + interval 10 day + to_seconds((l_orderkey * 10 + l_linenumber) % 86400)"
    )
)
def load_prices_twice(t: Tables) -> DataFrame:
    """A table loaded from half of the payloads, then reloaded from all: every invariant holds.

    Fetches come later than in the stream, so that no price is revised before it counts as known.
    """
    lake = Lake(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/lake-{uuid.uuid4().hex}")
    names = part_mapping(t)
    lake.replace(load.TICKER, names)
    lake.replace(
        load.ENTITY, names.select("entity_id", F.col("ticker").alias("cik"), F.col("ticker").alias("name"))
    )
    seconds = F.make_dt_interval(F.lit(10), F.lit(0), F.lit(0), F.col("payload_id") % 86_400)
    log = csv_payloads(t).withColumns(
        {"run_id": F.lit("run"), "fetched_at": F.col("fetched_at") + seconds}
    ).select(*schemas.PAYLOAD.fieldNames())
    for half in (0, 1):
        lake.append(load.PAYLOAD, log.where(F.col("payload_id") % 2 == half), ("source",))
        load.load_prices(lake, "yfinance", 1)
    return load.read_prices(lake, ["yfinance"]).select(*_FACTS)


@query(_SQL)
def stream_price_chain(t: Tables) -> DataFrame:
    """Half of the payloads arrive, then the rest; every fifth part has no mapping."""
    folder = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    mapping = part_mapping(t)
    log = csv_payloads(t).withColumn("run_id", F.lit("run")).select(*schemas.PAYLOAD.fieldNames())
    for half in (0, 1):
        log.where(F.col("payload_id") % 2 == half).write.mode("append").parquet(f"{folder}/log", compression=CODEC)
        stream = start_price_refresh(
            t.spark,
            f"{folder}/log",
            "yfinance",
            mapping,
            lag_days=1,
            state_path=f"{folder}/state",
            buckets=8,
        )
        stream.awaitTermination()
    return read_price_facts(t.spark, f"{folder}/state").select(*_FACTS)
