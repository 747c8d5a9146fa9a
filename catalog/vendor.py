"""Queries that parse vendor documents. Each given row becomes one small document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.oracle import day
from catalog.registry import query
from catalog.views import Tables, padded
from hindcast import config
from hindcast.sources import payloads, vendor

_BEST_TAG = "RevenueFromContractWithCustomerExcludingAssessedTax"


def _log(t: Tables, rows: DataFrame, body: Column, source: str = "edgar", spread: bool = True) -> DataFrame:
    """Documents like those of a landed log.

    A given table is one file, of which a single task reads a row group, so the narrow rows are spread
    before documents are made of them, unless enough tasks have some (`spread` is False).
    """
    if spread:
        rows = rows.repartition(t.spark.sparkContext.defaultParallelism)
    return rows.select(
        "payload_id",
        F.lit(source).alias("source"),
        F.lit("companyfacts" if source == "edgar" else "history").alias("endpoint"),
        F.create_map(F.lit("ticker"), F.col("ticker")).alias("request_params"),
        (F.col("fetched_at") if "fetched_at" in rows.columns else F.lit("2024-02-01 00:00:00"))
        .cast("timestamp")
        .alias("fetched_at"),
        F.lit(200).alias("http_status"),
        F.sha2(body, 256).alias("content_sha256"),
        body.cast("binary").alias("body"),
    )


def _point(**fields: Column) -> Column:
    """A data point without its NULL fields, as vendors leave them out."""
    return F.to_json(F.struct(*[column.alias(name) for name, column in fields.items()]))


def companyfacts_payloads(t: Tables) -> DataFrame:
    """One document per event: two revenue tags that contest a period, and a balance sheet."""
    events = t.events.withColumns(
        {
            "payload_id": F.col("event_id"),
            "ticker": F.concat(F.lit("T"), F.col("user_id")),
            "day": F.col("ts").cast("date"),
        }
    )
    filed = F.date_add("day", 20).cast("string")
    accession = F.concat(F.lit("a"), F.col("event_id"))
    value = F.floor(F.col("value") * 100)

    def point(start: Column | None, val: Column, **more: Column) -> Column:
        fields = {} if start is None else {"start": start.cast("string")}
        return _point(
            **fields,
            end=F.col("day").cast("string"),
            val=val,
            accn=accession,
            **more,
            form=F.lit("10-Q"),
            filed=filed,
        )

    calendar = {"fy": F.year("day"), "fp": F.lit("Q1")}
    quarter, half = F.date_sub("day", 90), F.date_sub("day", 180)
    best = F.when(
        F.col("event_id") % 4 != 0,
        F.concat(
            F.lit(f'"{_BEST_TAG}":{{"units":{{"USD":['),
            point(quarter, value, **calendar),
            F.lit("]}},"),
        ),
    ).otherwise("")
    fallback = F.concat(
        F.lit('"SalesRevenueNet":{"units":{"USD":['),
        point(quarter, value + 7, **calendar),
        F.lit(","),
        point(half, value * 2),
        F.lit(']}},"Unmapped":{"units":{"USD":[]}},'),
    )
    balance = F.concat(
        F.lit('"Assets":{"units":{"USD":['),
        point(None, value + 1000, **calendar),
        F.lit(']}},"LiabilitiesAndStockholdersEquity":{"units":{"USD":['),
        point(quarter, value),
        F.lit(","),
        point(None, value + 1000 + F.col("event_id") % 3 * 10, **calendar),
        F.lit("]}}"),
    )
    body = F.concat(
        F.lit('{"cik":'),
        F.col("user_id"),
        F.lit(',"entityName":"Company '),
        F.col("user_id"),
        F.lit('","facts":{"dei":{},"us-gaap":{'),
        best,
        fallback,
        balance,
        F.lit("}}}"),
    )
    return _log(t, events, body)


_EVENT = """
  (select event_id as payload_id, lpad(cast(user_id as varchar), 10, '0') as cik,
          'Company ' || user_id as entity_name, cast(ts as date) as d,
          floor(value * 100) as v, 'a' || event_id as accession_no, event_id, user_id from events)"""


@query(
    f"""select cik, entity_name, metric_code, {day('period_start')} as period_start,
               {day('d')} as period_end, fiscal_year, fiscal_period, cast(value as double) as value,
               unit, vendor_native_tag, '10-Q' as form_type, accession_no,
               {day('d + 20')} as filed_date, payload_id
        from (select *, 'revenue' as metric_code, d - 90 as period_start, year(d) as fiscal_year,
                     'Q1' as fiscal_period, case when event_id % 4 = 0 then v + 7 else v end as value,
                     'USD' as unit, case when event_id % 4 = 0 then 'SalesRevenueNet'
                                         else '{_BEST_TAG}' end as vendor_native_tag from {_EVENT}
              union all
              select *, 'revenue', d - 180, null, null, v * 2, 'USD', 'SalesRevenueNet' from {_EVENT}
              union all
              select *, 'total_assets', null, year(d), 'Q1', v + 1000, 'USD', 'Assets' from {_EVENT})"""
)
def json_companyfacts(t: Tables) -> DataFrame:
    return vendor.parse_companyfacts(
        companyfacts_payloads(t), config.metric_map(config.METRICS)
    )


@query(f"select distinct cik, entity_name as name from {_EVENT}")
def json_entity_names(t: Tables) -> DataFrame:
    return vendor.entity_names(companyfacts_payloads(t)).distinct()


@query(
    f"""select cik, {day('d')} as period_end, cast(min(v + 1000 + event_id % 3 * 10) as double) as value
        from {_EVENT} group by all"""
)
def json_instant_values(t: Tables) -> DataFrame:
    return vendor.instant_values(companyfacts_payloads(t), "LiabilitiesAndStockholdersEquity")


@query(
    """select event_id, cast(props->>'k' as bigint) as k, cast((props->>'k') is not null as bigint) as has_k
       from events"""
)
def json_extract(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.array_contains(F.json_object_keys("props"), "k").alias("has_k"),
    )


@query(
    """select event_id as payload_id, case when event_id % 2 = 0 then 'k,z' else 'z' end as missing
       from (select event_id from events where event_id % 3 <> 0)"""
)
def shape_drift(t: Tables) -> DataFrame:
    """Documents in which keys were renamed: an even id lost `k` too."""
    key = F.when(F.col("event_id") % 2 == 0, "y").otherwise("k")
    drifted = F.when(
        F.col("event_id") % 3 != 0, F.regexp_replace("props", F.lit('"k"'), F.concat(F.lit('"'), key, F.lit('"')))
    ).otherwise(F.lit('{"k": 1, "z": 2}'))
    log = t.events.select(F.col("event_id").alias("payload_id"), drifted.alias("body"))
    return payloads.shape_drift(log, F.col("body"), ["k", "z"])


def _lines(t: Tables, source: str) -> DataFrame:
    """A line item as the price history of one ticker, two days long."""
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("payload_id"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("adjusted"),
        F.col("l_quantity").alias("volume"),
        F.date_add(
            F.col("l_shipdate").cast("date"), (3 + F.col("l_orderkey") % 30).cast("int")
        ).alias("fetched_at"),
        F.lit(source).alias("source"),
    )


def _few_tasks(t: Tables, table: DataFrame) -> bool:
    """Whether fewer tasks than could run at once hold rows of a given table: a scan without columns."""
    tasks = table.select(F.spark_partition_id().alias("task")).distinct().count()
    return tasks < t.spark.sparkContext.defaultParallelism


def csv_payloads(t: Tables) -> DataFrame:
    def line(day: Column, *cells: Column) -> Column:
        stamp = F.concat(day.cast("string"), F.lit(" 23:30:00-05:00"))
        return F.concat_ws(",", stamp, *[cell.cast("string") for cell in cells], F.lit("0.0,0.0"))

    price, empty = F.col("price"), F.lit("")
    body = F.concat_ws(
        "\n",
        F.lit("Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits"),
        line(F.col("day"), price, price + 1, price - 1, price, F.col("adjusted"), F.col("volume")),
        line(F.date_add("day", 1), price, empty, empty, empty, empty, empty),
        F.lit(""),
    )
    return _log(t, _lines(t, "yfinance"), body, "yfinance", spread=_few_tasks(t, t.lineitem))


def _history_sql(first_pos: int) -> str:
    return f"""
  select 'P' || l_partkey as ticker, l_orderkey * 10 + l_linenumber as payload_id,
         i + {first_pos} as row_pos, {day('cast(l_shipdate as date) + i')} as trade_date,
         round(l_extendedprice, 6) as open,
         case when i = 0 then round(l_extendedprice + 1, 6) end as high,
         case when i = 0 then round(l_extendedprice - 1, 6) end as low,
         case when i = 0 then round(l_extendedprice, 6) end as close,
         case when i = 0 then cast(l_quantity as bigint) end as volume,
         case when i = 0 then round(l_extendedprice * (1 - l_discount), 6) end as adj_close
  from lineitem, (select unnest([0, 1]) as i)"""


@query(_history_sql(1))
def csv_parse(t: Tables) -> DataFrame:
    return vendor.price_csv(csv_payloads(t)).drop("source", "fetched_at")


def price_json_payloads(t: Tables) -> DataFrame:
    price = F.col("price")
    rest = "".join(
        f',"{name}":1.0'
        for name in ("adjHigh", "adjLow", "adjOpen", "adjVolume", "divCash", "splitFactor")
    )
    nothing = "".join(f',"{name}":null' for name in ("high", "low", "close", "volume", "adjClose"))

    def point(day: Column, *known: Column | str) -> Column:
        opening = [F.lit('{"date":"'), day.cast("string"), F.lit('T00:00:00.000Z","open":'), price]
        return F.concat(
            *opening, *[F.lit(k) if isinstance(k, str) else k for k in known], F.lit(f"{rest}}}")
        )

    first = point(
        F.col("day"),
        ',"high":', price + 1, ',"low":', price - 1, ',"close":', price,
        ',"volume":', F.col("volume").cast("bigint"), ',"adjClose":', F.col("adjusted"),
    )
    body = F.concat(
        F.lit("["), first, F.lit(","), point(F.date_add("day", 1), nothing), F.lit("]")
    )
    return _log(t, _lines(t, "tiingo"), body, "tiingo", spread=_few_tasks(t, t.lineitem))


@query(_history_sql(0))
def price_json_parse(t: Tables) -> DataFrame:
    return vendor.price_json(price_json_payloads(t)).drop("source", "fetched_at")


@query(
    """select 'C' || c_custkey as ticker, lpad(cast(c_custkey + 1 as varchar), 10, '0') as cik
       from customer
       union all
       select 'X' || c_custkey, case when c_custkey = 3 then '12345678901'
                                     else lpad(cast(c_custkey as varchar), 10, '0') end
       from customer"""
)
def ticker_map_parse(t: Tables) -> DataFrame:
    """Maps in which a ticker is listed twice, in lower and upper case."""
    key = F.col("c_custkey")
    number = F.when(key == 3, F.lit(12345678901)).otherwise(key)

    def entry(cik: Column, ticker: Column) -> Column:
        return F.to_json(
            F.struct(cik.alias("cik_str"), ticker.alias("ticker"), F.col("c_name").alias("title"))
        )

    body = F.concat(
        F.lit('{"0":'), entry(key, F.concat(F.lit("c"), key)),
        F.lit(',"1":'), entry(number, F.concat(F.lit("x"), key)),
        F.lit(',"2":'), entry(key + 1, F.concat(F.lit("C"), key)),
        F.lit("}"),
    )
    rows = t.customer.withColumns(
        {"payload_id": key, "ticker": F.lit(None).cast("string")}
    )
    return vendor.ticker_map(_log(t, rows, body))


@query(
    """select ticker, case when ticker like 'K%' then 'no cik' else 'no companyfacts' end as reason
       from (select case when c_custkey % 3 = 0 then 'K.' else 'L.' end || c_custkey as ticker,
                    c_custkey from customer)
       where c_custkey % 3 = 0 or c_custkey % 4 = 0"""
)
def parse_rejects(t: Tables) -> DataFrame:
    """Universe tickers that cannot be parsed, and why."""
    from hindcast.plans.load import universe_rejects

    key = F.col("c_custkey")
    universe = t.customer.select(
        F.concat(F.when(key % 3 == 0, "K.").otherwise("L."), key).alias("ticker")
    )
    ciks = t.customer.where(key % 3 != 0).select(
        F.concat(F.lit("L-"), key).alias("ticker"), padded("c_custkey").alias("cik")
    )
    documents = t.customer.where(key % 4 != 0).select(
        F.concat(F.lit("L."), key).alias("ticker"), key.alias("payload_id")
    )
    return universe_rejects(universe, ciks, documents)
