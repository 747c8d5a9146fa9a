"""The given tables seen as the library's inputs: staged facts, payloads, prices, entities."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions.calendar import quarter_start_dates
from hindcast.operators import chain

METRIC_OF_EVENT = {
    "purchase": "revenue",
    "view": "net_income",
    "error": "shares_outstanding_diluted",
    "click": "total_assets",
    "signup": "total_equity",
}
INSTANT_METRICS = ["total_assets", "total_equity"]
NOW = "2024-06-01 00:00:00"


class Tables:
    """Lazily opened tables of one data directory."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        setattr(self, name, table)
        return table


def rebalance_dates(t: Tables) -> list[dt.date]:
    """Quarter starts within the days that `lineitem` covers."""
    first, last = t.lineitem.agg(
        F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")
    ).first()
    return [] if first is None else quarter_start_dates(first, last)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def padded(column: str) -> Column:
    return F.lpad(F.col(column).cast("string"), 10, "0")


def stg_facts(t: Tables) -> DataFrame:
    """Staged facts from `events`: a user is a company, an event one reported value."""
    metric = F.lit(None).cast("string")
    for event, code in METRIC_OF_EVENT.items():
        metric = F.when(F.col("event_type") == event, code).otherwise(metric)
    quarter = (F.col("event_id") % 3) * (1 + F.col("user_id") % 3)
    end = F.date_sub(
        F.add_months(F.lit(dt.date(2022, 1, 1)), (3 * (quarter + 1)).cast("int")), 1
    )
    filed = F.col("ts").cast("date")
    in_calendar = F.col("event_id") % 50 != 0
    return t.events.select(
        padded("user_id").alias("cik"),
        F.concat(F.lit("Company "), F.col("user_id")).alias("entity_name"),
        metric.alias("metric_code"),
        end.alias("period_end"),
        filed.alias("filed_date"),
        F.col("value"),
        F.col("event_id"),
        in_calendar.alias("in_calendar"),
    ).select(
        "cik",
        "entity_name",
        "metric_code",
        F.when(
            ~F.col("metric_code").isin(INSTANT_METRICS),
            F.date_sub("period_end", F.when(F.col("event_id") % 5 == 0, 270).otherwise(90)),
        ).alias("period_start"),
        "period_end",
        F.when(F.col("in_calendar"), F.year("period_end")).alias("fiscal_year"),
        F.when(
            F.col("in_calendar"), F.concat(F.lit("Q"), F.quarter("period_end"))
        ).alias("fiscal_period"),
        F.floor(F.col("value") / 25).cast(schemas.VALUE_TYPE).alias("value"),
        F.lit("USD").alias("unit"),
        F.concat(F.lit("tag"), F.col("event_id") % 3).alias("vendor_native_tag"),
        F.when(F.col("event_id") % 7 == 0, "10-K").otherwise("10-Q").alias("form_type"),
        F.concat_ws(
            "-", "cik", F.lpad(F.floor(F.dayofyear("filed_date") / 2).cast("string"), 3, "0")
        ).alias("accession_no"),
        "filed_date",
        F.col("event_id").alias("payload_id"),
    )


def entity(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("entity_id"), padded("s_suppkey").alias("cik"), F.col("s_name").alias("name")
    )


def entity_ticker(t: Tables) -> DataFrame:
    """Ticker history from `supplier`: two fifths of the companies were renamed once."""
    supplier = t.supplier.select(F.col("s_suppkey").alias("entity_id"))
    renamed_at = (
        F.when(F.col("entity_id") % 5 == 2, F.lit("1998-06-15 00:00:00"))
        .when(F.col("entity_id") % 5 == 3, F.lit("2024-01-15 00:00:00"))
        .cast("timestamp")
    )
    ticker = F.concat(F.lit("T"), F.col("entity_id"))
    first = schemas.first_mapping_start()
    before = F.lit("1990-01-01 00:00:00").cast("timestamp")
    start = F.when(F.col("entity_id") % 5 == 2, before).otherwise(
        F.when(F.col("entity_id") % 5 == 3, first).otherwise(before)
    )
    windows = F.when(
        renamed_at.isNotNull(),
        F.array(
            F.struct(
                F.concat(ticker, F.lit("_OLD")).alias("ticker"),
                start.alias("knowledge_from"),
                renamed_at.alias("knowledge_to"),
            ),
            F.struct(
                ticker.alias("ticker"),
                renamed_at.alias("knowledge_from"),
                schemas.open_end().alias("knowledge_to"),
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(
                ticker.alias("ticker"),
                start.alias("knowledge_from"),
                schemas.open_end().alias("knowledge_to"),
            )
        )
    )
    return supplier.select("entity_id", F.inline(windows))


def universe(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("T"), F.col("s_suppkey")).alias("ticker")
    )


def fundamental_facts(t: Tables) -> DataFrame:
    return chain.fundamental_facts(stg_facts(t), entity(t), source="edgar", lag_days=1)


def payload(t: Tables) -> DataFrame:
    """Payload log from `documents`: 20 feeds, four tickers, the text as body."""
    fetched = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(
        F.lit(0), (F.col("doc_id") % 4000).cast("int")
    )
    return t.documents.select(
        F.col("doc_id").alias("payload_id"),
        "source",
        F.lit("history").alias("endpoint"),
        F.create_map(F.lit("ticker"), F.col("lang")).alias("request_params"),
        fetched.alias("fetched_at"),
        F.when(F.col("doc_id") % 17 == 0, 404).otherwise(200).alias("http_status"),
        F.sha2(F.col("text"), 256).alias("content_sha256"),
        F.col("text").cast("binary").alias("body"),
    )


PRICE_ORDER = [
    "fetched_at", "payload_id", "row_pos", "l_partkey", "l_extendedprice", "l_discount", "volume",
]


def price_observations(t: Tables) -> DataFrame:
    """Weekly prices of two vendors from `lineitem`, many weeks observed more than once."""
    close = F.floor(F.col("l_extendedprice") / 10000).cast("double") + 1
    return t.lineitem.select(
        F.col("l_suppkey").alias("entity_id"),
        F.when(F.col("l_linestatus") == "F", "yfinance").otherwise("tiingo").alias("source"),
        F.trunc(F.col("l_shipdate").cast("date"), "week").alias("trade_date"),
        close.alias("close"),
        F.when(F.col("l_discount") > 0.05, close * 0.9).otherwise(close).alias("adj_close"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        (
            F.date_add(F.col("l_shipdate").cast("date"), (3 + F.col("l_orderkey") % 30).cast("int"))
        ).cast("timestamp").alias("fetched_at"),
        F.col("l_orderkey").alias("payload_id"),
        F.col("l_linenumber").alias("row_pos"),
        "l_partkey",
        "l_extendedprice",
        "l_discount",
    )


def price_facts(t: Tables, **options) -> DataFrame:
    rows = chain.price_chain(price_observations(t), lag_days=1, order=PRICE_ORDER, **options)
    return rows.withColumns(
        {name: F.lit(None).cast("double") for name in ("open", "high", "low")}
        | {"fact_id": F.xxhash64("entity_id", "source", "trade_date", "knowledge_from")}
    ).select(*schemas.PRICE_FACT.fieldNames())


def quarterly_stg(t: Tables) -> DataFrame:
    """Quarterly income, restated once, and share counts per supplier, from `lineitem`."""
    quarter = F.trunc(F.col("l_shipdate").cast("date"), "quarter")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    per_quarter = t.lineitem.groupBy(
        F.col("l_suppkey").alias("entity_id"), quarter.alias("period_start")
    ).agg(
        F.sum(F.when(F.col("l_returnflag") != "R", cents).otherwise(0)).alias("original"),
        F.sum(cents).alias("restated"),
        (F.count(F.lit(1)) + 1000).alias("shares"),
    )
    reports = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric_code"),
                F.lit(version).alias("version"),
                (F.col(value).cast("decimal(20,0)") / scale).cast(schemas.VALUE_TYPE).alias("value"),
                F.lit(unit).alias("unit"),
                F.lit(delay).alias("delay"),
            )
            for metric, version, value, scale, unit, delay in [
                ("net_income", "1", "original", 100, "USD", 30),
                ("net_income", "2", "restated", 100, "USD", 200),
                ("shares_outstanding_diluted", "1", "shares", 1, "shares", 30),
            ]
        ]
    )
    end = F.date_sub(F.add_months("period_start", 3), 1)
    return per_quarter.select(
        "entity_id", "period_start", end.alias("period_end"), F.inline(reports)
    ).select(
        padded("entity_id").alias("cik"),
        F.lit(None).cast("string").alias("entity_name"),
        "metric_code",
        "period_start",
        "period_end",
        F.year("period_end").alias("fiscal_year"),
        F.concat(F.lit("Q"), F.quarter("period_end")).alias("fiscal_period"),
        "value",
        "unit",
        F.lit("tag").alias("vendor_native_tag"),
        F.lit("10-Q").alias("form_type"),
        F.concat_ws(
            "-", F.col("entity_id").cast("string"), F.col("period_end").cast("string"), "version"
        ).alias("accession_no"),
        F.date_add("period_end", F.col("delay")).alias("filed_date"),
        F.col("entity_id").alias("payload_id"),
    )


def quarterly_facts(t: Tables) -> DataFrame:
    """Two reports at most per key, so there are no hot keys to look for."""
    return chain.fundamental_facts(
        quarterly_stg(t), entity(t), source="edgar", lag_days=1, hot_key_rows=None
    )
