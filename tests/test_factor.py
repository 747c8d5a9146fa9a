from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from helpers import d, rows, table, ts
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.operators import factor

OPEN = ts("9999-12-31 23:59:59.999999")
DATES = [d("2021-01-01"), d("2021-04-01"), d("2021-07-01"), d("2021-10-01")]


def now():
    return F.lit("2030-01-01").cast("timestamp")


def fact(i, entity, end, value, known, until=None, metric="net_income", length=90):
    return {
        "fact_id": i, "entity_id": entity, "metric_code": metric, "period_end": end,
        "period_start": None if length is None else end - dt.timedelta(days=length),
        "value": Decimal(str(value)), "unit": "USD", "source": "edgar", "accession_no": f"a{i}",
        "filed_date": end, "knowledge_from": known, "knowledge_to": until or OPEN, "payload_id": 1,
    }


def random_facts(seed, gaps):
    """Quarters of three entities, restated at random; with `gaps`, some versions are withdrawn."""
    rng = random.Random(seed)
    out = []
    for entity in (1, 2, 3):
        for q in range(14):
            if rng.random() < 0.15:
                continue
            end = d("2018-03-31") + dt.timedelta(days=91 * q)
            known = dt.datetime.combine(end, dt.time(13, 30)) + dt.timedelta(days=rng.randint(1, 300))
            length = rng.choice([90, 90, 90, 270, None])
            for version in range(rng.randint(1, 3)):
                until = known + dt.timedelta(days=rng.randint(1, 200))
                last = version == 2
                end_ = until if (not last or (gaps and rng.random() < 0.3)) else None
                out.append((entity, end, rng.randint(-50, 100), known, end_, length))
                known = until + dt.timedelta(days=rng.choice([0, 40]) if gaps else 0)
            if out[-1][4] is not None and not (gaps and rng.random() < 0.3):
                out[-1] = (*out[-1][:4], None, length)
    return [
        fact(i, entity, end, value, known, until, length=length)
        for i, (entity, end, value, known, until, length) in enumerate(out)
    ]


def loop_ttm(facts, dates, now):
    out = []
    for mode in (factor.POINT_IN_TIME, factor.LATEST):
        for day in dates:
            instant = dt.datetime.combine(day, dt.time()) if mode == factor.POINT_IN_TIME else now
            for entity in (1, 2, 3):
                seen = [
                    f for f in facts
                    if f["entity_id"] == entity and f["period_start"] is not None
                    and 80 <= (f["period_end"] - f["period_start"]).days <= 100
                    and f["knowledge_from"] <= instant < f["knowledge_to"] and f["period_end"] <= day
                ]
                last = sorted(seen, key=lambda f: f["period_end"])[-4:]
                if len(last) == 4:
                    out.append((mode, day, entity, float(sum(f["value"] for f in last)),
                                [f["accession_no"] for f in last]))
    return sorted(out, key=repr)


def loop_latest(facts, dates, now):
    out = []
    for mode in (factor.POINT_IN_TIME, factor.LATEST):
        for day in dates:
            instant = dt.datetime.combine(day, dt.time()) if mode == factor.POINT_IN_TIME else now
            for entity in (1, 2, 3):
                seen = [
                    f for f in facts
                    if f["entity_id"] == entity and f["knowledge_from"] <= instant < f["knowledge_to"]
                    and f["period_end"] <= day
                ]
                if seen:
                    out.append((mode, day, entity, max(seen, key=lambda f: f["period_end"])["accession_no"]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_panels_equal_a_loop_over_dates(spark, seed, gaps):
    facts = random_facts(seed, gaps)
    dates = [d("2018-01-01") + dt.timedelta(days=37 * i) for i in range(45)]
    df = table(spark, schemas.FUNDAMENTAL_FACT, facts)
    panel = factor.ttm_panel(df, dates, now()).select(
        "mode", "date", "entity_id", F.col("ttm_value").cast("double"), "facts.accession_no"
    )
    assert rows(panel) == loop_ttm(facts, dates, ts("2030-01-01"))
    latest = factor.latest_fact_panel(df, dates, now(), metric="net_income").select(
        "mode", "date", "entity_id", "accession_no"
    )
    assert rows(latest) == loop_latest(facts, dates, ts("2030-01-01"))


def test_restatement_shows_in_latest_mode_only(spark):
    ends = [d("2020-03-31"), d("2020-06-30"), d("2020-09-30"), d("2020-12-31")]
    facts = [fact(i, 1, end, 25, ts("2021-02-01")) for i, end in enumerate(ends[:3])]
    facts += [
        fact(3, 1, ends[3], 25, ts("2021-02-01"), ts("2021-08-01")),
        fact(4, 1, ends[3], 65, ts("2021-08-01")),
    ]
    panel = factor.ttm_panel(table(spark, schemas.FUNDAMENTAL_FACT, facts), [d("2021-04-01")], now())
    assert rows(panel.select("mode", F.col("ttm_value").cast("int"))) == [("latest", 140), ("point_in_time", 100)]


def market(spark):
    """Four companies: T4 has the best yield, T1 the worst; T2 is restated above T4 later."""
    facts, i = [], 0
    for entity in (1, 2, 3, 4):
        for q in range(7):
            end = d("2019-12-31") + dt.timedelta(days=91 * q)
            known = dt.datetime.combine(end, dt.time()) + dt.timedelta(days=20)
            if entity == 2 and q == 3:
                facts.append(fact(i, entity, end, 20, known, ts("2022-01-01")))
                facts.append(fact(i + 1, entity, end, 400, ts("2022-01-01")))
                i += 2
            else:
                facts.append(fact(i, entity, end, 10 * entity, known))
                i += 1
            facts.append(fact(i, entity, end, 100, known, metric="shares_outstanding_diluted"))
            i += 1
    prices = [
        {"fact_id": n, "entity_id": entity, "trade_date": day + dt.timedelta(days=2), "close": 10.0,
         "adj_close": 10.0 + entity * k, "source": source, "knowledge_from": ts("2021-01-01"),
         "knowledge_to": OPEN, "payload_id": 1}
        for n, (entity, (k, day), source) in enumerate(
            (e, kd, s) for e in (1, 2, 3, 4) for kd in enumerate(DATES) for s in ("tiingo", "yfinance")
        )
    ]
    mapping = [
        {"entity_id": e, "ticker": f"T{e}", "knowledge_from": ts("2000-01-01"), "knowledge_to": OPEN}
        for e in (1, 2, 3, 4)
    ]
    universe = spark.createDataFrame([(i, f"T{i}") for i in (1, 2, 3, 4)], "ordinal int, ticker string")
    return (
        table(spark, schemas.FUNDAMENTAL_FACT, facts), table(spark, schemas.PRICE_FACT, prices),
        table(spark, schemas.ENTITY_TICKER, mapping), universe,
    )


@pytest.fixture(scope="module")
def experiment(spark):
    facts, prices, mapping, universe = market(spark)
    panel = factor.earnings_yield_panel(
        facts, prices, mapping, universe, DATES, latest_as_of=now(), price_as_of=now()
    ).cache()
    portfolios = factor.long_short_portfolios(panel, size=1, min_cohort=4).cache()
    returns = factor.position_returns(portfolios, prices, mapping, DATES, price_as_of=now())
    return panel, portfolios, returns


def test_portfolios_of_both_modes(experiment):
    _, portfolios, _ = experiment
    pit = portfolios.where("mode = 'point_in_time'")
    assert {(r.side, r.ticker) for r in pit.collect()} == {("long", "T4"), ("short", "T1")}
    late = portfolios.where("mode = 'latest' and date >= '2021-01-01' and side = 'long'")
    assert {r.ticker for r in late.collect()} == {"T2"}


def test_too_small_a_cohort_forms_no_portfolio(experiment):
    panel, _, _ = experiment
    assert factor.long_short_portfolios(panel, size=1, min_cohort=5).count() == 0


def test_ties_follow_universe_order(spark):
    panel = spark.createDataFrame(
        [("m", DATES[0], f"T{i}", i, 1.0) for i in range(6)],
        "mode string, date date, ticker string, ordinal int, earnings_yield double",
    )
    got = factor.long_short_portfolios(panel, size=2, min_cohort=4)
    assert rows(got.select("side", "rank", "ticker")) == [
        ("long", 1, "T0"), ("long", 2, "T1"), ("short", 1, "T5"), ("short", 2, "T4"),
    ]


def test_returns_turnover_and_curve(experiment):
    _, portfolios, returns = experiment
    periods = factor.period_returns(returns)
    pit = {r.date: r for r in periods.where("mode = 'point_in_time'").collect()}
    dates = sorted({r.date for r in portfolios.where("mode = 'point_in_time'").collect()})
    k = DATES.index(dates[0])
    expected = (10 + 4 * (k + 1)) / (10 + 4 * k) - (10 + (k + 1)) / (10 + k)
    assert pit[dates[0]].portfolio_return == pytest.approx(expected)
    turnover = factor.turnover(portfolios)
    assert {r.turnover for r in turnover.where("mode = 'point_in_time'").collect()} == {0.0}
    summary = {r.mode: r for r in factor.performance(periods, turnover).collect()}
    product = 1.0
    for row in pit.values():
        product *= 1 + row.portfolio_return
    assert summary["point_in_time"].cumulative_return == pytest.approx(product - 1)
    assert summary["point_in_time"].n_periods == len(dates) - 1
    curve = factor.equity_curve(portfolios, periods).where("mode = 'point_in_time'").orderBy("date").collect()
    assert curve[0].equity == 1.0
    assert curve[-1].equity == pytest.approx(product)


def test_case_study_names_the_restated_fact(experiment):
    panel, portfolios, _ = experiment
    differences = factor.compare_modes(portfolios)
    first = differences.where(F.col("date") == DATES[0])
    assert rows(first.select("ticker", "point_in_time_side", "latest_side")) == [
        ("T2", None, "long"), ("T4", "long", None),
    ]
    studies = factor.case_studies(first, panel)
    (study,) = studies.collect()
    assert (study.ticker, int(study.point_in_time_value), int(study.latest_value)) == ("T2", 20, 400)
    counts = factor.difference_counts(differences).first()
    assert counts.n_dates == len({r.date for r in differences.collect()})


def test_turnover_counts_replaced_slots(spark):
    positions = spark.createDataFrame(
        [("m", DATES[0], "A", "long"), ("m", DATES[0], "B", "short"),
         ("m", DATES[2], "A", "long"), ("m", DATES[2], "C", "short"),
         ("m", DATES[3], "C", "long"), ("m", DATES[3], "A", "short")],
        "mode string, date date, ticker string, side string",
    )
    assert rows(factor.turnover(positions).select("date", "next_date", "turnover")) == [
        (DATES[0], DATES[2], 0.5), (DATES[2], DATES[3], 1.0),
    ]


def test_sharpe_needs_two_different_returns(spark):
    def summary(*returns):
        periods = spark.createDataFrame(
            [("m", DATES[i], DATES[i + 1], r) for i, r in enumerate(returns)],
            "mode string, date date, next_date date, portfolio_return double",
        )
        none = spark.createDataFrame([], "mode string, turnover double")
        return factor.performance(periods, none).first()

    assert summary(0.1).sharpe is None
    assert summary(0.1, 0.1).sharpe is None
    got = summary(0.1, -0.05, 0.02)
    mean = 0.07 / 3
    stdev = (sum((r - mean) ** 2 for r in (0.1, -0.05, 0.02)) / 2) ** 0.5
    assert got.sharpe == pytest.approx(mean / stdev * 2)
    assert got.cumulative_return == pytest.approx(1.1 * 0.95 * 1.02 - 1)
    assert got.avg_turnover == 0.0
    # A total loss and beyond: no logarithms involved.
    assert summary(-1.5, 0.2).cumulative_return == pytest.approx(-0.5 * 1.2 - 1)
