from __future__ import annotations

import json

import pytest
from helpers import d, rows, ts
from pyspark.sql import functions as F

from hindcast import config, schemas
from hindcast.operators import coverage
from hindcast.sources import payloads, vendor

METRICS = config.metric_map(config.METRICS)
BEST, OLDER = METRICS[0].tag, "Revenues"


def log(spark, *bodies, source="edgar", endpoint="companyfacts", status=200, fetched="2024-02-01", **params):
    return spark.createDataFrame(
        [
            (i, source, endpoint, {"ticker": "AAPL", **params}, ts(fetched), status, "sha",
             bytearray((body if isinstance(body, str) else json.dumps(body)).encode()), "run")
            for i, body in enumerate(bodies)
        ],
        schemas.PAYLOAD,
    )


def point(end, val, start=None, **more):
    base = {"end": end, "val": val, "accn": "a1", "fy": 2018, "fp": "FY", "form": "10-K", "filed": "2019-02-01"}
    return {**base, **({"start": start} if start else {}), **more}


def document(**tags):
    return {"cik": 1, "entityName": "Test Corp", "facts": {"us-gaap": {
        tag: {"label": tag, "units": units} for tag, units in tags.items()}}}


def parsed(spark, body):
    return vendor.parse_companyfacts(log(spark, body), METRICS)


def test_tag_priority_is_resolved_per_period(spark):
    body = document(**{
        BEST: {"USD": [point("2018-12-31", 200, "2018-01-01")]},
        OLDER: {"USD": [point("2018-12-31", 199, "2018-01-01"), point("2017-12-31", 100, "2017-01-01")]},
        "Unmapped": {"USD": [point("2018-12-31", 5)]},
    })
    got = parsed(spark, body).select("period_end", F.col("value").cast("int"), "vendor_native_tag")
    assert rows(got) == [(d("2017-12-31"), 100, OLDER), (d("2018-12-31"), 200, BEST)]


def test_all_points_of_the_best_tag_survive(spark):
    points = [point("2018-12-31", v, "2018-01-01", accn=f"a{v}") for v in (1, 2, 3)]
    assert parsed(spark, document(**{BEST: {"USD": points}})).count() == 3


def test_unit_instant_and_null_calendar(spark):
    body = document(
        Assets={"USD": [point("2018-12-31", 9)], "EUR": [point("2018-12-31", 8)]},
        NetIncomeLoss={"shares": [point("2018-12-31", 7)]},
        StockholdersEquity={"USD": [point("2018-12-31", 6, fy=None, fp=None, form="8-K")]},
    )
    got = parsed(spark, body).select(
        "cik", "metric_code", "period_start", F.col("value").cast("int"), "fiscal_year", "form_type"
    )
    assert rows(got) == [
        ("0000000001", "total_assets", None, 9, 2018, "10-K"),
        ("0000000001", "total_equity", None, 6, None, "8-K"),
    ]


def test_documents_without_facts_still_name_the_entity(spark):
    empty = {"cik": 7, "entityName": "New Holding", "facts": {}}
    assert parsed(spark, empty).count() == 0
    assert rows(vendor.entity_names(log(spark, empty))) == [("0000000007", "New Holding")]


def test_point_without_a_needed_field_fails(spark):
    broken = point("2018-12-31", 1)
    del broken["accn"]
    with pytest.raises(Exception, match="data point without accn"):
        parsed(spark, document(**{BEST: {"USD": [broken]}})).collect()


def test_ticker_map(spark):
    body = {
        "0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"},
        "1": {"cik_str": 1067983, "ticker": "BRK-B", "title": "Berkshire"},
        "2": {"cik_str": 5, "ticker": "AAPL", "title": "Other"},
    }
    assert rows(vendor.ticker_map(log(spark, body, endpoint="ticker_map"))) == [
        ("AAPL", "0000000005"), ("BRK-B", "0001067983"),
    ]
    with pytest.raises(Exception, match="lacks its fields"):
        vendor.ticker_map(log(spark, {"0": {"cik": 1, "ticker": "A", "title": "A"}})).collect()


CSV = """Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits
2024-01-02 00:00:00-05:00,1.5,2.0,1.0,1.75,1.7,1000.0,0.0,0.0
2024-01-03 23:30:00-05:00,,,,,,,0.0,0.0
"""


def test_price_csv(spark):
    got = vendor.price_csv(log(spark, CSV, source="yfinance", endpoint="history"))
    assert rows(got.select("ticker", "trade_date", "open", "close", "adj_close", "volume")) == [
        ("AAPL", d("2024-01-02"), 1.5, 1.75, 1.7, 1000), ("AAPL", d("2024-01-03"), None, None, None, None),
    ]
    windows = vendor.price_csv(log(spark, CSV.replace("\n", "\r\n"), source="yfinance"))
    assert windows.count() == 2
    with pytest.raises(Exception, match="no column 'Adj Close'"):
        vendor.price_csv(log(spark, CSV.replace("Adj Close", "AdjClose"))).collect()


def price_point(day, **more):
    return {**{key: 1.0 for key in vendor.PRICE_POINT_KEYS}, "date": f"{day}T00:00:00.000Z", "volume": 10, **more}


def test_price_json(spark):
    body = [price_point("2024-01-02", adjClose=0.5), price_point("2024-01-03", close=None)]
    got = vendor.price_json(log(spark, body, source="tiingo", endpoint="prices"))
    assert rows(got.select("trade_date", "close", "adj_close", "volume")) == [
        (d("2024-01-02"), 1.0, 0.5, 10), (d("2024-01-03"), None, 1.0, 10),
    ]
    assert vendor.price_json(log(spark, [], source="tiingo")).count() == 0
    drifted = [{"date": "2024-01-02T00:00:00Z", "close": 1.0}]
    with pytest.raises(Exception, match="lacks keys it always had: adjClose"):
        vendor.price_json(log(spark, drifted, source="tiingo")).collect()


def test_unknown_price_source(spark):
    with pytest.raises(ValueError, match="unknown price source"):
        vendor.parse_prices(log(spark, CSV), "stooq")


def test_latest_payload_can_skip_errors(spark):
    good = log(spark, "good", fetched="2024-01-01")
    bad = log(spark, "bad", fetched="2024-02-01", status=404).withColumn("payload_id", F.lit(9).cast("bigint"))
    both = good.unionByName(bad)
    by = ["source", "endpoint", payloads.ticker_of().alias("ticker")]
    assert rows(payloads.latest(both, by).select("payload_id")) == [(0,)]
    assert rows(payloads.latest(both, by, ok_only=False).select("payload_id")) == [(9,)]


def test_landing_keeps_every_fetch_and_flags_repeats(spark):
    columns = ["source", "endpoint", "request_params", "fetched_at", "http_status", "body"]
    rows_1 = payloads.identified(log(spark, "x", "x", "y").withColumn(
        "fetched_at", F.timestamp_seconds(F.col("payload_id"))).select(*columns), "r1")
    first = payloads.mark_seen(rows_1, log(spark).limit(0))
    assert [r.content_unchanged for r in first.orderBy("fetched_at").collect()] == [False, True, False]
    rows_2 = payloads.identified(log(spark, "y", "z").withColumn(
        "fetched_at", F.timestamp_seconds(F.col("payload_id") + 100)).select(*columns), "r2")
    second = payloads.mark_seen(rows_2, rows_1)
    assert [r.content_unchanged for r in second.orderBy("fetched_at").collect()] == [True, False]
    assert first.select("payload_id").distinct().count() == 3


def test_coverage(spark):
    facts = spark.createDataFrame(
        [("1", 2023, "Q1", "a"), ("1", 2023, "Q1", "b"), ("1", 2023, "Q2", "b"), ("2", 2023, "Q1", "zz"),
         ("1", None, None, "a")],
        "cik string, fiscal_year int, fiscal_period string, metric_code string",
    )
    tickers = spark.createDataFrame([("1", "ONE")], "cik string, ticker string")
    gaps = coverage.ordered_gaps(coverage.coverage_gaps(facts, tickers, ["b", "a"]))
    assert [tuple(r) for r in gaps.collect()] == [
        ("2", "?", 2023, "Q1", ["a", "b"]), ("1", "ONE", 2023, "Q2", ["a"]),
    ]
    assert tuple(coverage.coverage_summary(facts, ["a", "b"]).first()) == (3, 1, pytest.approx(100 / 3))
    assert tuple(coverage.coverage_summary(facts.limit(0), ["a"]).first()) == (0, 0, 0.0)


def test_config_is_rejected_when_empty_or_misshapen():
    for loader, bad in [
        (config.metric_map, {}), (config.source_lags, []), (config.reconciliation_rules, {}),
        (config.slas, []),
    ]:
        with pytest.raises(ValueError):
            loader(bad)
    assert len(METRICS) == 15 or len(METRICS) == 16
    assert config.source_lags({"a": {"availability_lag_days": "2"}}) == {"a": 2}
