"""What the physical plans must look like to hold at scale."""

from __future__ import annotations

import pytest
from helpers import entities

import __spark_entry__ as entry
from catalog import views
from hindcast.operators import chain, factor
from hindcast.session import cut_lineage
from hindcast.sources import payloads

DIRECTORY = "/root/testdata/sf0.001"
PLANNED = [
    "asof_read", "price_chain", "tag_priority", "forward_asof_price", "backward_asof_latest", "version_diff",
    "ticker_scd2", "coverage_gaps", "overlap_violations", "check_cross_vendor", "check_return_outliers",
    "exception_advance", "feed_status", "json_companyfacts", "csv_parse", "price_json_parse", "ttm_panel",
    "earnings_yield_rank",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_or_nested_loop_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, DIRECTORY))
    for word in ("CartesianProduct", "NestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in text


def test_a_chain_moves_its_rows_once(spark):
    t = views.Tables(spark, DIRECTORY)
    facts = chain.version_chain(
        views.stg_facts(t), ["cik", "metric_code", "period_start", "period_end"], lag_days=1
    )
    assert plan(facts).count("Exchange") == 1


def test_as_of_and_metric_filters_reach_the_scan(spark, tmp_path):
    t = views.Tables(spark, DIRECTORY)
    path = str(tmp_path / "facts")
    chain.fundamental_facts(views.stg_facts(t), entities(spark, 1, 2, 3), source="edgar", lag_days=1).write.parquet(path)
    import datetime as dt

    from hindcast import PointInTime

    reader = PointInTime(
        dt.datetime(2024, 1, 20, tzinfo=dt.UTC), entity=views.entity(t), entity_ticker=views.entity_ticker(t),
        fundamental_fact=spark.read.parquet(path),
    )
    text = plan(reader.fundamentals(["revenue"]).select("ticker", "value"))
    pushed = next(line for line in text.splitlines() if "metric_code" in line and "PushedFilters" in line)
    assert "knowledge_from" in pushed and "knowledge_to" in pushed
    assert "vendor_native_tag" not in pushed.split("ReadSchema")[1]


def test_rankings_are_limited_before_the_shuffle(spark):
    text = plan(entry.queries()["earnings_yield_rank"](spark, DIRECTORY))
    assert "WindowGroupLimit" in text


def test_documents_are_parsed_once(spark):
    for name in ("json_companyfacts", "price_json_parse", "json_instant_values"):
        assert plan(entry.queries()[name](spark, DIRECTORY)).count("from_json(") == 1


def test_tag_priority_moves_nothing(spark):
    text = plan(entry.queries()["json_companyfacts"](spark, DIRECTORY))
    # The one exchange spreads the narrow rows that documents are made of.
    assert text.count("Exchange") == 1 and "Window" not in text


def test_the_factor_panel_is_one_pass_over_the_facts(spark):
    t = views.Tables(spark, DIRECTORY)
    facts = cut_lineage(views.quarterly_facts(t))
    text = plan(factor.ttm_and_shares(facts, views.rebalance_dates(t), views.now()))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_bodies_are_not_shuffled_when_landing(spark):
    rows = payloads.identified(views.payload(views.Tables(spark, DIRECTORY)), "run")
    assert "Exchange" not in plan(rows)
    narrow = rows.select("source", "content_sha256", "fetched_at", "payload_id")
    seen = plan(payloads.mark_seen(narrow, narrow))
    assert not [line for line in seen.splitlines() if "Exchange" in line and "body" in line]
