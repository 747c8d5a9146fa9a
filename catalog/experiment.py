"""Queries over the factor panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views
from catalog.oracle import day, with_parts
from catalog.registry import query
from catalog.views import Tables
from hindcast.operators import factor
from hindcast.session import cut_lineage


def _facts(t: Tables) -> DataFrame:
    """The quarterly fact table, stored as a load leaves it: the panels read it several times."""
    return cut_lineage(views.quarterly_facts(t))


@query(
    with_parts(
        ["ttm"],
        f"""select mode, {day('date')} as date, entity_id, round(ttm_value, 6) as ttm_value, span_days,
                   accessions from ttm""",
    )
)
def ttm_panel(t: Tables) -> DataFrame:
    panel = factor.ttm_panel(_facts(t), views.rebalance_dates(t), views.now())
    return panel.withColumn("accessions", F.col("facts.accession_no")).drop("facts")


@query(
    with_parts(
        ["shares"],
        f"""select mode, {day('date')} as date, entity_id, {day('period_end')} as period_end,
                   shares as value from shares""",
    )
)
def shares_panel(t: Tables) -> DataFrame:
    panel = factor.latest_fact_panel(_facts(t), views.rebalance_dates(t), views.now())
    return panel.drop("fact_id", "accession_no")


def _prices(t: Tables) -> DataFrame:
    return cut_lineage(views.price_facts(t))


def _panel(t: Tables, prices: DataFrame | None = None) -> DataFrame:
    return factor.earnings_yield_panel(
        _facts(t),
        views.price_facts(t) if prices is None else prices,
        views.entity_ticker(t),
        views.universe(t),
        views.rebalance_dates(t),
        latest_as_of=views.now(),
        price_as_of=views.now(),
    )


@query(
    with_parts(
        ["panel"],
        f"""select mode, {day('date')} as date, ticker, ordinal, entity_id,
                   round(ttm_net_income, 6) as ttm_net_income, shares, {day('price_date')} as price_date,
                   price, market_cap, round(earnings_yield, 6) as earnings_yield from panel""",
    )
)
def earnings_yield(t: Tables) -> DataFrame:
    return _panel(t).drop("facts", "shares_fact_id")


@query(
    with_parts(["positions"], f"select mode, {day('date')} as date, ticker, side, rank from positions")
)
def earnings_yield_rank(t: Tables) -> DataFrame:
    return factor.long_short_portfolios(_panel(t))


def _positions_and_returns(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Portfolios and their returns. Prices and the small portfolios are stored, being read often."""
    prices = _prices(t)
    positions = cut_lineage(factor.long_short_portfolios(_panel(t, prices)))
    return positions, factor.position_returns(
        positions,
        prices,
        views.entity_ticker(t),
        views.rebalance_dates(t),
        price_as_of=views.now(),
    )


@query(
    with_parts(
        ["pos_ret"],
        f"""select mode, {day('date')} as date, {day('next_date')} as next_date, ticker, side,
                   round(forward_return, 6) as forward_return from pos_ret""",
    )
)
def forward_returns(t: Tables) -> DataFrame:
    return _positions_and_returns(t)[1]


@query(
    with_parts(
        ["periods"],
        f"""select mode, {day('date')} as date, {day('next_date')} as next_date,
                   round(long_return, 6) as long_return, round(short_return, 6) as short_return,
                   round(portfolio_return, 6) as portfolio_return from periods""",
    )
)
def period_returns(t: Tables) -> DataFrame:
    return factor.period_returns(_positions_and_returns(t)[1])


@query(
    with_parts(
        ["turn"],
        f"""select mode, {day('date')} as date, {day('next_date')} as next_date,
                   round(turnover, 6) as turnover from turn""",
    )
)
def turnover(t: Tables) -> DataFrame:
    return factor.turnover(factor.long_short_portfolios(_panel(t)))


@query(
    with_parts(
        ["periods", "turn"],
        """select mode, round(product(1 + portfolio_return) - 1, 6) as cumulative_return,
                  round(avg(portfolio_return) / stddev_samp(portfolio_return) * 2, 6) as sharpe,
                  count(*) as n_periods, round(any_value(t.avg_turnover), 6) as avg_turnover
           from periods join (select mode, avg(turnover) as avg_turnover from turn group by all) t using (mode)
           group by mode""",
    )
)
def performance_summary(t: Tables) -> DataFrame:
    positions, returns = _positions_and_returns(t)
    return factor.performance(factor.period_returns(returns), factor.turnover(positions))


@query(
    with_parts(
        ["periods"],
        f"""select mode, {day('date')} as date, round(equity, 6) as equity from (
              select mode, min(date) as date, cast(1.0 as double) as equity from positions group by mode
              union all
              select mode, next_date, product(1 + portfolio_return) over (partition by mode order by date)
              from periods)""",
    )
)
def equity_curve(t: Tables) -> DataFrame:
    positions, returns = _positions_and_returns(t)
    return factor.equity_curve(positions, factor.period_returns(returns))


@query(
    with_parts(
        ["diffs"], f"select {day('date')} as date, ticker, point_in_time_side, latest_side from diffs"
    )
)
def mode_differences(t: Tables) -> DataFrame:
    return factor.compare_modes(factor.long_short_portfolios(_panel(t)))


@query(
    with_parts(
        ["diffs"], "select count(*) as n_differences, count(distinct date) as n_dates from diffs"
    )
)
def difference_counts(t: Tables) -> DataFrame:
    return factor.difference_counts(
        factor.compare_modes(factor.long_short_portfolios(_panel(t)))
    )


@query(
    with_parts(
        ["diffs"],
        f"""select {day('d.date')} as date, d.ticker, point_in_time_side, latest_side,
                   {day('a.period_end')} as period_end, a.accession_no as point_in_time_accession_no,
                   cast(a.value as double) as point_in_time_value, b.accession_no as latest_accession_no,
                   cast(b.value as double) as latest_value
            from diffs d
            join panel p on p.date = d.date and p.ticker = d.ticker and p.mode = 'point_in_time'
            join panel q on q.date = d.date and q.ticker = d.ticker and q.mode = 'latest'
            join ttm_rows a on a.mode = 'point_in_time' and a.date = d.date
             and a.entity_id = p.entity_id and a.recency <= 4
            join ttm_rows b on b.mode = 'latest' and b.date = d.date
             and b.entity_id = q.entity_id and b.recency <= 4 and b.period_end = a.period_end
            where a.value <> b.value""",
    )
)
def case_studies(t: Tables) -> DataFrame:
    panel = cut_lineage(_panel(t))
    differences = factor.compare_modes(factor.long_short_portfolios(panel))
    return factor.case_studies(differences, panel).drop("point_in_time_fact_id", "latest_fact_id")
