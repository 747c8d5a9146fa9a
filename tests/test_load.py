"""From landed payloads to facts, checks and lineage, in a lake folder."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from helpers import d, rows, ts
from pyspark.sql import functions as F
from test_vendor import BEST, CSV, document, point, price_point

from hindcast import config, schemas
from hindcast.operators import integrity
from hindcast.plans import lineage, load, quality
from hindcast.sources.lake import Lake
from hindcast.streaming.prices import _CONTENT, read_price_facts, start_price_refresh

METRICS = config.metric_map(config.METRICS)


def fetched(spark, items):
    return spark.createDataFrame(
        [
            (endpoint, params, ts(at), status, bytearray((b if isinstance(b, str) else json.dumps(b)).encode()))
            for endpoint, params, at, status, b in items
        ],
        "endpoint string, request_params map<string,string>, fetched_at timestamp, http_status int, body binary",
    )


TICKERS = {"0": {"cik_str": 1, "ticker": "AAPL", "title": "A"}, "1": {"cik_str": 2, "ticker": "MSFT", "title": "M"}}


def facts_body(value, filed, accn):
    return document(**{BEST: {"USD": [
        point("2020-12-31", 100, "2020-10-01", accn="a1", filed="2021-02-01"),
        point("2020-12-31", value, "2020-10-01", accn=accn, filed=filed),
    ]}})


@pytest.fixture
def lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    load.land(lake, fetched(spark, [
        ("ticker_map", {}, "2024-01-01", 200, TICKERS),
        ("companyfacts", {"ticker": "AAPL", "cik": "0000000001"}, "2024-01-01", 200, facts_body(100, "2021-03-01", "a2")),
        ("companyfacts", {"ticker": "AAPL", "cik": "0000000001"}, "2024-03-01", 404, "gone"),
    ]), "edgar")
    load.land(lake, fetched(spark, [("history", {"ticker": "AAPL"}, "2024-02-01", 200, CSV)]), "yfinance")
    load.land(lake, fetched(spark, [
        ("prices", {"ticker": "AAPL"}, "2024-02-01", 200, [price_point("2024-01-02", adjClose=1.7)]),
        ("prices", {"ticker": "ZZZ"}, "2024-02-01", 200, []),
    ]), "tiingo")
    return lake


def universe(spark, *tickers):
    return spark.createDataFrame([(t,) for t in tickers], "ticker string")


def test_load_twice_then_restate(spark, lake):
    rejects = load.run_parse(lake, universe(spark, "AAPL", "MSFT", "NONE"), METRICS)
    assert rows(rejects) == [("MSFT", "no companyfacts"), ("NONE", "no cik")]
    assert load.load_fundamentals(lake, 1) == load.LoadSummary(1, 1, 0, 0)
    assert load.load_fundamentals(lake, 1) == load.LoadSummary(1, 0, 1, 0)

    load.land(lake, fetched(spark, [
        ("companyfacts", {"ticker": "AAPL", "cik": "0000000001"}, "2024-04-01", 200, facts_body(140, "2021-06-01", "a3")),
    ]), "edgar")
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    assert load.load_fundamentals(lake, 1) == load.LoadSummary(1, 1, 1, 0)
    facts = lake.read(load.FUNDAMENTAL, schemas.FUNDAMENTAL_FACT)
    assert [int(r.value) for r in facts.orderBy("knowledge_from").collect()] == [100, 140]
    report = integrity.fundamental_invariants(
        facts, load.read_payloads(lake), lake.read(load.ENTITY, schemas.ENTITY)
    )
    assert {r.violations for r in report.collect()} == {0}
    mapping = lake.read(load.TICKER, schemas.ENTITY_TICKER)
    assert rows(mapping.select("ticker", "knowledge_from")) == [("AAPL", ts("2000-01-01"))]


def test_prices_checks_and_exceptions(spark, lake):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    load.load_fundamentals(lake, 1)
    assert load.load_prices(lake, "yfinance", 1) == load.LoadSummary(1, 2, 0, 0)
    assert load.load_prices(lake, "tiingo", 1).rows_inserted == 1
    rules = config.reconciliation_rules(config.RECONCILIATION)
    now = dt.datetime(2024, 2, 1)
    totals = {r.severity: r for r in quality.run_checks(lake, rules, now).collect()}
    assert sum(r.total for r in totals.values()) == lake.read_log(quality.RESULTS, quality.STORED_RESULT).count()
    assert totals["BREAK"].failed == 1  # Prices are a month old.
    state = lake.read(quality.EXCEPTIONS, schemas.EXCEPTION)
    assert rows(state.select("check_name", "status")) == [("price_staleness", "open")]
    names = {r.check_name for r in lake.read_log(quality.RESULTS, quality.STORED_RESULT).collect()}
    assert len(names) == 8
    quality.run_checks(lake, rules, dt.datetime(2024, 1, 4))
    state = lake.read(quality.EXCEPTIONS, schemas.EXCEPTION)
    assert rows(state.select("check_name", "status")) == [("price_staleness", "closed")]


def test_runs_are_recorded_with_counts_and_errors(spark, lake):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    with pytest.raises(ZeroDivisionError):
        with lineage.tracked_run(lake, "broken"):
            1 / 0  # noqa: B018
    runs = {r.pipeline: r for r in lineage.runs(lake).collect()}
    assert runs["ingest:edgar"].status == "success"
    assert (runs["ingest:edgar"].rows_in, runs["ingest:edgar"].rows_out) == (3, 3)
    assert runs["parse"].rows_out == 2
    assert runs["broken"].status == "failed"
    assert json.loads(runs["broken"].error) == {"type": "ZeroDivisionError", "message": "division by zero"}
    assert integrity.domain_violations(lineage.runs(lake), "status", schemas.RUN_STATUSES).count() == 0


def test_a_refused_load_is_not_published(spark, lake):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    load.load_prices(lake, "yfinance", 1)
    before = rows(load.read_prices(lake, ["yfinance"]))
    # The same trade date fetched twice before its price counts as known: an inverted window.
    csv = CSV.replace("1.75,1.7", "1.75,0.85")
    load.land(lake, fetched(spark, [("history", {"ticker": "AAPL"}, "2024-01-02 15:00:00", 200, csv)]), "yfinance")
    load.land(lake, fetched(spark, [("history", {"ticker": "AAPL"}, "2024-01-02 20:00:00", 200, CSV)]), "yfinance")
    with pytest.raises(ValueError, match="window_order"):
        load.load_prices(lake, "yfinance", 1)
    assert rows(load.read_prices(lake, ["yfinance"])) == before


def test_rules_inside_a_key_are_counted_while_prices_are_written(spark, lake, monkeypatch):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)

    def again(*_, **__):
        raise AssertionError("rows of the written table are moved once more")

    monkeypatch.setattr(integrity, "chain_report", again)
    assert load.load_prices(lake, "yfinance", 1) == load.LoadSummary(1, 2, 0, 0)
    assert [(r.rows_in, r.rows_out) for r in lineage.runs(lake).where("pipeline like 'load-prices%'").collect()] == [(2, 2)]
    before = rows(load.read_prices(lake, ["yfinance"]))
    # Two prices that differ, found at one instant.
    for close in ("1.75,1.5", "1.75,0.85"):
        csv = CSV.replace("1.75,1.7", close)
        load.land(lake, fetched(spark, [("history", {"ticker": "AAPL"}, "2024-03-01", 200, csv)]), "yfinance")
    with pytest.raises(ValueError, match="unique_version"):
        load.load_prices(lake, "yfinance", 1)
    assert rows(load.read_prices(lake, ["yfinance"])) == before


def test_two_tickers_of_a_company_make_one_entity(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    both = {"0": {"cik_str": 7, "ticker": "GA", "title": "G"}, "1": {"cik_str": 7, "ticker": "GB", "title": "G"}}
    load.land(lake, fetched(spark, [
        ("ticker_map", {}, "2024-01-01", 200, both),
        ("companyfacts", {"ticker": "GA", "cik": "7"}, "2024-01-01", 200, facts_body(1, "2021-03-01", "a2")),
        ("companyfacts", {"ticker": "GB", "cik": "7"}, "2024-01-01", 200, facts_body(1, "2021-03-01", "a2")),
    ]), "edgar")
    listed = spark.createDataFrame([("GB", 0), ("GA", 1)], "ticker string, ordinal int")
    load.run_parse(lake, listed, METRICS)
    assert lake.read(load.ENTITY, schemas.ENTITY).count() == 1
    assert rows(lake.read(load.TICKER, schemas.ENTITY_TICKER).select("ticker")) == [("GA",)]


def test_a_response_without_body_is_refused(spark, tmp_path):
    empty = fetched(spark, [("history", {"ticker": "A"}, "2024-01-01", 200, "x")]).withColumn(
        "body", F.lit(None).cast("binary"))
    with pytest.raises(Exception, match="no body"):
        load.land(Lake(spark, str(tmp_path)), empty, "yfinance")


def test_landing_flags_are_kept(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for day in ("2024-01-01", "2024-01-02"):
        load.land(lake, fetched(spark, [("history", {"ticker": "A"}, day, 200, "same")]), "yfinance")
    flags = load.read_landings(lake).join(load.read_payloads(lake), "payload_id").orderBy("fetched_at")
    assert [r.content_unchanged for r in flags.collect()] == [False, True]


def test_a_bucket_that_ends_empty_is_emptied(spark, lake, tmp_path):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    mapping = lake.read(load.TICKER, schemas.ENTITY_TICKER)
    state = f"{tmp_path}/stream"

    def refresh(names):
        start_price_refresh(
            spark, f"{lake.path(load.PAYLOAD)}/log", "yfinance", names, lag_days=1, state_path=state, buckets=4
        ).awaitTermination()

    refresh(mapping)
    assert read_price_facts(spark, state).count() == 2
    load.land(lake, fetched(spark, [("history", {"ticker": "AAPL"}, "2024-03-01", 200, CSV)]), "yfinance")
    refresh(mapping.withColumn("knowledge_to", F.lit("2024-02-01").cast("timestamp")))
    assert read_price_facts(spark, state).count() == 0


def test_a_changed_mapping_reaches_buckets_without_new_payloads(spark, lake, tmp_path, monkeypatch):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    mapping = lake.read(load.TICKER, schemas.ENTITY_TICKER)
    state = f"{tmp_path}/stream"

    def refresh(names):
        start_price_refresh(
            spark, f"{lake.path(load.PAYLOAD)}/log", "yfinance", names, lag_days=1, state_path=state, buckets=4
        ).awaitTermination()

    def ids():
        return {r.entity_id for r in read_price_facts(spark, state).collect()}

    assert ids() == set()
    refresh(mapping)
    first = ids()
    refresh(mapping.withColumn("entity_id", F.lit(77).cast("bigint")))
    assert len(first) == 1 and first != {77} and ids() == {77}

    def die(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(Lake, "replace", die)
        with pytest.raises(RuntimeError, match="lost"):
            refresh(mapping)
    assert ids() == {77}
    content = rows(Lake(spark, state).read("price_content", _CONTENT))
    refresh(mapping.withColumn("entity_id", F.lit(77).cast("bigint")))
    # The same mapping and no payloads: nothing is written anew.
    assert rows(Lake(spark, state).read("price_content", _CONTENT)) == content


def test_a_parse_that_dies_publishes_nothing(spark, lake, monkeypatch):
    tables = {load.STG: schemas.STG_FACT, load.ENTITY: schemas.ENTITY, load.TICKER: schemas.ENTITY_TICKER}

    def counts():
        return [lake.read(name, schema).count() for name, schema in tables.items()]

    mark = Lake._mark

    def die_at(step):
        def marked(self, file):
            if step in file:
                raise RuntimeError("lost")
            mark(self, file)
        return marked

    for step in ("core/entity/", "core/entity_ticker/", "/_groups/"):
        with monkeypatch.context() as patched:
            patched.setattr(Lake, "_mark", die_at(step))
            with pytest.raises(RuntimeError, match="lost"):
                load.run_parse(lake, universe(spark, "AAPL"), METRICS)
        assert counts() == [0, 0, 0]
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    assert all(counts())
    # A later version published alone follows one that was published in a group.
    lake.replace(load.ENTITY, lake.read(load.ENTITY, schemas.ENTITY).limit(0))
    assert counts()[1] == 0 and lake.drop_old_versions(load.ENTITY, keep=1) == 1


def test_parse_needs_a_ticker_map(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no ticker map"):
        load.run_parse(Lake(spark, str(tmp_path)), universe(spark, "AAPL"), METRICS)


def test_a_failed_replace_leaves_the_table(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("core.entity", spark.createDataFrame([(1, "1", "A")], schemas.ENTITY))
    broken = spark.range(1).select(
        F.raise_error(F.lit("boom")).cast("bigint").alias("entity_id"), F.lit("1").alias("cik"), F.lit("B").alias("name")
    )
    with pytest.raises(Exception, match="boom"):
        lake.replace("core.entity", broken)
    assert rows(lake.read("core.entity", schemas.ENTITY)) == [(1, "1", "A")]


def test_old_snapshots_can_be_dropped(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for name in "ABC":
        lake.replace("core.entity", spark.createDataFrame([(1, "1", name)], schemas.ENTITY))
    assert lake.drop_old_versions("core.entity", keep=1) == 2
    assert rows(lake.read("core.entity", schemas.ENTITY)) == [(1, "1", "C")]
    lake.replace("core.entity", spark.createDataFrame([(1, "1", "D")], schemas.ENTITY))
    assert rows(lake.read("core.entity", schemas.ENTITY)) == [(1, "1", "D")]


def test_stream_ends_where_a_batch_load_does(spark, lake, tmp_path):
    load.run_parse(lake, universe(spark, "AAPL"), METRICS)
    mapping = lake.read(load.TICKER, schemas.ENTITY_TICKER)
    state = f"{tmp_path}/stream"

    def refresh():
        start_price_refresh(
            spark, f"{lake.path(load.PAYLOAD)}/log", "yfinance", mapping, lag_days=1, state_path=state, buckets=4
        ).awaitTermination()

    refresh()
    load.land(lake, fetched(spark, [
        ("history", {"ticker": "AAPL"}, "2024-03-01", 200, CSV.replace("1.75,1.7", "1.75,0.85")),
    ]), "yfinance")
    refresh()
    load.load_prices(lake, "yfinance", 1)
    batch = load.read_prices(lake, ["yfinance"])
    streamed = read_price_facts(spark, state)
    assert rows(streamed) == rows(batch)
    revised = streamed.where(F.col("trade_date") == d("2024-01-02"))
    assert rows(revised.select("adj_close", "knowledge_from")) == [
        (0.85, ts("2024-03-01")), (1.7, ts("2024-01-03 13:30:00")),
    ]


def test_log_mutations(spark, lake):
    log = load.read_payloads(lake)
    assert integrity.log_mutations(log, log).count() == 0
    assert integrity.log_mutations(log, log.where("http_status = 200")).count() == 1
