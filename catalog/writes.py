"""Queries over what the write path leaves behind: landing, dimensions, run counters, exceptions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views
from catalog.oracle import OPEN, ts, with_parts
from catalog.quality import _EXC, _run_results
from catalog.registry import query
from catalog.views import Tables, padded
from hindcast import schemas
from hindcast.operators import exceptions, scd2
from hindcast.plans import lineage, load
from hindcast.session import cut_lineage, ensure_checkpoint_dir
from hindcast.sources.lake import Lake

# ---- Landing ----


def _landed(t: Tables) -> Lake:
    """Documents landed twice: the even ones first, all of them a day later."""
    lake = Lake(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/lake-{uuid.uuid4().hex}")

    def batch(rows: DataFrame, day: str) -> DataFrame:
        fetched = F.unix_seconds(F.lit(day).cast("timestamp")) + F.col("doc_id")
        return rows.select(
            F.lit("history").alias("endpoint"),
            F.create_map(F.lit("doc"), F.col("doc_id").cast("string")).alias("request_params"),
            F.timestamp_seconds(fetched).alias("fetched_at"),
            F.lit(200).alias("http_status"),
            F.coalesce("text", F.lit("")).cast("binary").alias("body"),
        )

    load.land(lake, batch(t.documents.where("doc_id % 2 = 0"), "2024-01-01 00:00:00"), "feed")
    load.land(lake, batch(t.documents, "2024-06-01 00:00:00"), "feed")
    return lake


@query(
    """with t as (select doc_id, coalesce(text, '') as text from documents),
            batches as (select 1 as batch, * from t where doc_id % 2 = 0 union all select 2, * from t)
       select doc_id, batch,
              cast(row_number() over (partition by text order by batch, doc_id) > 1 as bigint) as unchanged
       from batches"""
)
def land_log(t: Tables) -> DataFrame:
    lake = _landed(t)
    log = load.read_payloads(lake).select("payload_id", "request_params", "fetched_at")
    return load.read_landings(lake).join(log, "payload_id").select(
        F.col("request_params")["doc"].cast("bigint").alias("doc_id"),
        F.when(F.col("fetched_at") < "2024-06-01", 1).otherwise(2).alias("batch"),
        F.col("content_unchanged").alias("unchanged"),
    )


@query(
    """select 'ingest:feed' as pipeline, 'success' as status, n as rows_in, n as rows_out
       from (select count(*) as n from documents where doc_id % 2 = 0
             union all select count(*) from documents)"""
)
def run_counters(t: Tables) -> DataFrame:
    return lineage.runs(_landed(t)).select("pipeline", "status", "rows_in", "rows_out")


# ---- Dimensions ----


@query(
    f"""with seen as (
          select lpad(cast(s_suppkey // 3 as varchar), 10, '0') as cik,
                 arg_max(s_name, s_suppkey) as name, 'T' || max(s_suppkey) as ticker
          from supplier group by all),
        known as (select lpad(cast(s_suppkey as varchar), 10, '0') as cik, 'T' || (s_suppkey * 3) as ticker
                  from supplier where s_suppkey % 2 = 0)
        select coalesce(s.cik, k.cik) as cik, case when s.cik is null then 'known' else s.name end as name,
               x.ticker, x.knowledge_from, x.knowledge_to
        from seen s full join known k using (cik), lateral (
          select k.ticker as ticker, '2000-01-01 00:00:00' as knowledge_from,
                 case when s.ticker <> k.ticker then '2024-01-01 00:00:00' else {ts(OPEN)} end as knowledge_to
          where k.cik is not null
          union all
          select s.ticker,
                 case when k.cik is not null or s.ticker in (select ticker from known)
                      then '2024-01-01 00:00:00' else '2000-01-01 00:00:00' end, {ts(OPEN)}
          where s.cik is not null and (k.cik is null or s.ticker <> k.ticker)) x"""
)
def parse_dimensions(t: Tables) -> DataFrame:
    """Up to three tickers per company, of which the last names it, over half-known companies."""
    seen = t.supplier.select(
        F.lpad(F.floor(F.col("s_suppkey") / 3).cast("string"), 10, "0").alias("cik"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("T"), F.col("s_suppkey")).alias("ticker"),
        F.col("s_suppkey").alias("ordinal"),
    )
    known = t.supplier.where("s_suppkey % 2 = 0")
    entity = known.select(
        F.col("s_suppkey").alias("entity_id"), padded("s_suppkey").alias("cik"), F.lit("known").alias("name")
    )
    mapping = known.select(
        F.col("s_suppkey").alias("entity_id"),
        F.concat(F.lit("T"), F.col("s_suppkey") * 3).alias("ticker"),
        schemas.first_mapping_start().alias("knowledge_from"),
        schemas.open_end().alias("knowledge_to"),
    )
    once = cut_lineage(scd2.one_per_cik(seen))
    entities = cut_lineage(scd2.merge_entities(entity, once))
    current = once.join(entities.select("cik", "entity_id"), "cik").select("entity_id", "ticker")
    merged = scd2.merge_ticker_mapping(mapping, current, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return merged.join(entities, "entity_id").select("cik", "name", "ticker", "knowledge_from", "knowledge_to")


# ---- Exceptions handled by hand ----


@query(
    with_parts(
        [],
        """select cast(o_custkey as varchar) as dimension_key,
                  case when n <= 5 then 'triage' when n <= 10 then 'closed' else 'open' end as status,
                  case when n <= 5 then 'looking' when n <= 10 then 'fixed' end as resolution_note,
                  case when n > 5 and n <= 10 then '2024-01-03 00:00:00' end as closed_at
           from (select o_custkey, row_number() over (order by cast(o_custkey as varchar)) as n
                 from r1 where failed)""",
        _EXC,
    )
)
def triage_resolve(t: Tables) -> DataFrame:
    """Of the exceptions a run opened, five are acknowledged and five closed by hand."""
    opened_at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    none = exceptions.empty_exceptions(t.spark)
    state = cut_lineage(exceptions.advance(none, _run_results(t, 0), opened_at))
    ids = [row[0] for row in state.orderBy("dimension_key").select("exception_id").take(10)]
    state = exceptions.triage(state, ids[:5], "looking")
    state = exceptions.resolve(state, ids[5:], "fixed", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    return state.select("dimension_key", "status", "resolution_note", "closed_at")
