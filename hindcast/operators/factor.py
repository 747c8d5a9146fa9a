"""The factor experiment as panels: earnings yield, portfolios, returns, and what restatement did.

Every step covers all rebalance dates and both modes at once. In `point_in_time` mode fundamentals
are read as of the rebalance date, in `latest` mode as of `latest_as_of` for every date. Prices are
read as of `price_as_of` in both, because a closing price is never known on its own day.

`dates` is the rebalance calendar, a short Python list.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions.calendar import is_single_quarter
from hindcast.operators.asof import as_of, dates_within, known_at, nearest_on_or_after

POINT_IN_TIME = "point_in_time"
LATEST = "latest"
TTM_QUARTERS = 4
PORTFOLIO_SIZE = 10
MIN_COHORT = 20
PERIODS_PER_YEAR = 4



def _first_midnight(instant: Column) -> Column:
    """Date of the first midnight at or after `instant`: from then on a daily reading sees it."""
    return F.date_add((instant - F.expr("INTERVAL 1 MICROSECOND")).cast("date"), 1)


def _read_points(
    dates: Sequence[dt.date], first: Column, until: Column, in_latest: Column
) -> Column:
    """Array of the (mode, date) at which a row with a knowledge window counts.

    In both modes a date must lie in [first, until). A point-in-time reading at midnight of the
    date must fall into the knowledge window as well; `in_latest` says whether the latest reading
    does. Windows are turned into dates up front, so each calendar date costs two comparisons.
    """

    def points(mode: str, days: Column) -> Column:
        return F.transform(
            days, lambda day: F.struct(F.lit(mode).alias("mode"), day.alias("date"))
        )

    known = F.greatest(first, _first_midnight(F.col("knowledge_from")))
    replaced = F.least(until, _first_midnight(F.col("knowledge_to")))
    latest = F.when(in_latest, dates_within(dates, first, until)).otherwise(
        F.array().cast("array<date>")
    )
    return F.concat(
        points(POINT_IN_TIME, dates_within(dates, known, replaced)), points(LATEST, latest)
    )


def last_periods(
    facts: DataFrame, dates: Sequence[dt.date], latest_as_of: Column, counts: Mapping[str, int]
) -> DataFrame:
    """The latest periods known and ended per (mode, date, entity, metric), one row each.

    `counts` says how many of each metric; rows of other metrics are left out. A period that is
    known stays known, so it leaves the last n for good once n later ones are known. That day bounds
    the dates a version is paired with, which keeps the pairs proportional to the result instead of
    facts times dates. The bound is only used where the windows of the later periods have no gap;
    the exact rank is taken afterwards. Everything happens in one partitioning by entity, whose rows
    are bounded by its calendar and restatements.
    """
    item = ["entity_id", "metric_code", "period_start", "period_end"]
    series = ["entity_id", "metric_code"]
    wanted = facts.where(F.col("metric_code").isin(list(counts))).repartition("entity_id")
    versions = Window.partitionBy(*item)
    length = F.unix_micros("knowledge_to") - F.unix_micros("knowledge_from")
    items = wanted.withColumns(
        {
            "__first": F.min("knowledge_from").over(versions),
            "__last": F.max("knowledge_to").over(versions),
            # NULL on overflow, which only overlapping windows could reach: then no bound is used.
            "__covered": F.try_sum(length).over(versions),
            "__nth": F.dense_rank().over(Window.partitionBy(*series).orderBy("period_end", "period_start")),
        }
    )
    whole = F.unix_micros("__last") - F.unix_micros("__first")
    never = F.lit(dt.date.max)
    stays_known = (F.col("__last") == schemas.open_end()) & (F.col("__covered") == whole)
    usable = F.when(
        stays_known & (F.col("__first") <= latest_as_of),
        F.greatest(_first_midnight(F.col("__first")), F.col("period_end")),
    ).otherwise(never)
    items = items.withColumn("__usable", usable)
    retired, most = F.lit(None).cast("date"), F.lit(0)
    for metric, count in counts.items():
        later = Window.partitionBy(*series).orderBy("__nth").rangeBetween(1, count)
        full = F.max("__nth").over(later) - F.col("__nth") == count
        own = F.col("metric_code") == metric
        retired = F.when(own, F.when(full, F.max("__usable").over(later))).otherwise(retired)
        most = F.when(own, F.lit(count)).otherwise(most)
    paired = items.withColumn("__retired", F.coalesce(retired, never)).select(
        *facts.columns,
        F.inline(
            _read_points(dates, F.col("period_end"), F.col("__retired"), known_at(latest_as_of))
        ),
    )
    newest_first = Window.partitionBy("mode", "date", *series).orderBy(
        F.col("period_end").desc(), F.col("period_start").desc_nulls_last(), F.col("fact_id").desc()
    )
    return paired.withColumn("recency", F.row_number().over(newest_first)).where(
        F.col("recency") <= most
    )


def _usable_rows(metric: str) -> Column:
    """Rows of `metric` that make up a trailing sum: single quarters only."""
    return (F.col("metric_code") == metric) & is_single_quarter(
        F.col("period_start"), F.col("period_end")
    )


def _trailing(metric: str) -> list[Column]:
    own = F.col("metric_code") == metric
    fact = F.struct("period_end", "period_start", "fact_id", "accession_no", "value")
    return [
        F.count_if(own).alias("n_quarters"),
        F.sum(F.when(own, F.col("value"))).alias("ttm_value"),
        F.datediff(
            F.max(F.when(own, F.col("period_end"))), F.min(F.when(own, F.col("period_start")))
        ).alias("span_days"),
        F.array_sort(F.collect_list(F.when(own, fact))).alias("facts"),
    ]


def ttm_panel(
    facts: DataFrame,
    dates: Sequence[dt.date],
    latest_as_of: Column,
    *,
    metric: str = "net_income",
    quarters: int = TTM_QUARTERS,
) -> DataFrame:
    """Sum of the last four single quarters per (mode, date, entity), with the facts behind it.

    Fewer than four quarters give no row. `span_days` shows sums over quarters that are not
    consecutive: the fourth quarter is often missing.
    """
    rows = last_periods(facts.where(_usable_rows(metric)), dates, latest_as_of, {metric: quarters})
    return (
        rows.groupBy("mode", "date", "entity_id")
        .agg(*_trailing(metric))
        .where(F.col("n_quarters") == quarters)
        .drop("n_quarters")
    )


def latest_fact_panel(
    facts: DataFrame,
    dates: Sequence[dt.date],
    latest_as_of: Column,
    *,
    metric: str = "shares_outstanding_diluted",
) -> DataFrame:
    """The latest period's fact of a metric per (mode, date, entity), of any duration."""
    return last_periods(facts, dates, latest_as_of, {metric: 1}).select(
        "mode", "date", "entity_id", "period_end", "fact_id", "accession_no", "value"
    )


def ttm_and_shares(
    facts: DataFrame,
    dates: Sequence[dt.date],
    latest_as_of: Column,
    *,
    income: str = "net_income",
    shares: str = "shares_outstanding_diluted",
    quarters: int = TTM_QUARTERS,
) -> DataFrame:
    """Both panels side by side in one pass over the facts, where both exist."""
    rows = last_periods(
        facts.where(_usable_rows(income) | (F.col("metric_code") == shares)),
        dates, latest_as_of, {income: quarters, shares: 1},
    )
    held = F.struct(F.col("value").cast("double").alias("shares"), F.col("fact_id").alias("shares_fact_id"))
    return (
        rows.groupBy("mode", "date", "entity_id")
        .agg(*_trailing(income), F.max(F.when(F.col("metric_code") == shares, held)).alias("__s"))
        .where((F.col("n_quarters") == quarters) & F.col("__s").isNotNull())
        .select("*", "__s.*")
        .drop("n_quarters", "__s")
    )


def _tickers_on_dates(
    mapping: DataFrame, dates: Sequence[dt.date], latest_as_of: Column
) -> DataFrame:
    return mapping.select(
        "entity_id",
        "ticker",
        F.inline(
            _read_points(
                dates,
                F.lit(min(dates, default=dt.date.max)),
                F.lit(dt.date.max),
                known_at(latest_as_of),
            )
        ),
    )


def priced_tickers(
    prices: DataFrame, mapping: DataFrame, price_as_of: Column, source: str
) -> DataFrame:
    """Prices of one source believed at `price_as_of`, by the ticker held at that instant."""
    held = as_of(mapping, price_as_of).select("entity_id", "ticker")
    return as_of(prices.where(F.col("source") == source), price_as_of).join(held, "entity_id")


def earnings_yield_panel(
    facts: DataFrame,
    prices: DataFrame,
    mapping: DataFrame,
    universe: DataFrame,
    dates: Sequence[dt.date],
    *,
    latest_as_of: Column,
    price_as_of: Column,
    price_source: str = "tiingo",
) -> DataFrame:
    """Earnings yield per (mode, date, ticker) of `universe(ordinal, ticker)`.

    A ticker without four quarters, a positive share count, a price within ten days or a positive
    market value has no row.
    """
    ttm = ttm_and_shares(facts, dates, latest_as_of).where(F.col("shares") > 0)
    tickers = _tickers_on_dates(mapping, dates, latest_as_of).join(universe, "ticker")
    close = nearest_on_or_after(
        priced_tickers(prices, mapping, price_as_of, price_source),
        dates,
        by=["ticker"],
        value="close",
    )
    on = ["mode", "date", "entity_id"]
    return (
        ttm.join(tickers, on)
        .join(close, ["date", "ticker"])
        .withColumn("market_cap", F.col("shares") * F.col("price"))
        .where(F.col("market_cap") > 0)
        .withColumn("ttm_net_income", F.col("ttm_value").cast("double"))
        .withColumn("earnings_yield", F.col("ttm_net_income") / F.col("market_cap"))
        .select(
            "mode", "date", "ticker", "ordinal", "entity_id", "earnings_yield", "ttm_net_income",
            "shares", "shares_fact_id", "price_date", "price", "market_cap", "facts",
        )
    )


def long_short_portfolios(
    panel: DataFrame, *, size: int = PORTFOLIO_SIZE, min_cohort: int = MIN_COHORT
) -> DataFrame:
    """(mode, date, ticker, side, rank): the `size` best and worst yields of each big enough cohort.

    Ties follow universe order. Each leg is ranked only as far as needed, which Spark applies to
    each map task before the shuffle, so a cohort of any size sends a bounded number of rows; that
    the ranks reach `min_cohort` proves the cohort is big enough.
    """

    def leg_row(side: str, first: Column, second: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"), first.alias("first"), second.alias("second")
        )

    best_first = leg_row("long", -F.col("earnings_yield"), F.col("ordinal"))
    worst_first = leg_row("short", F.col("earnings_yield"), -F.col("ordinal"))
    legs = panel.select("mode", "date", "ticker", F.inline(F.array(best_first, worst_first)))
    leg = Window.partitionBy("mode", "date", "side")
    return (
        legs.withColumn("rank", F.row_number().over(leg.orderBy("first", "second")))
        .where(F.col("rank") <= max(size, min_cohort))
        .withColumn("reached", F.max("rank").over(leg))
        .where((F.col("reached") >= min_cohort) & (F.col("rank") <= size))
        .select("mode", "date", "ticker", "side", "rank")
    )


def with_next_date(portfolios: DataFrame) -> DataFrame:
    """Adds `next_date`, the next date of the same mode with a portfolio.

    A mode holds two legs of fixed size per calendar date, which bounds the window.
    """
    following = (
        Window.partitionBy("mode")
        .orderBy(F.unix_date("date"))
        .rangeBetween(1, Window.unboundedFollowing)
    )
    return portfolios.withColumn("next_date", F.min("date").over(following))


def position_returns(
    portfolios: DataFrame,
    prices: DataFrame,
    mapping: DataFrame,
    dates: Sequence[dt.date],
    *,
    price_as_of: Column,
    price_source: str = "yfinance",
) -> DataFrame:
    """Adjusted-close return of each position from its date to the next portfolio's."""
    points = nearest_on_or_after(
        priced_tickers(prices, mapping, price_as_of, price_source),
        dates,
        by=["ticker"],
        value="adj_close",
    )
    start = points.select("date", "ticker", F.col("price").alias("start_price"))
    end = points.select(
        F.col("date").alias("next_date"), "ticker", F.col("price").alias("end_price")
    )
    return (
        with_next_date(portfolios)
        .where(F.col("next_date").isNotNull())
        .join(start, ["date", "ticker"])
        .join(end, ["next_date", "ticker"])
        .where(F.col("start_price") != 0)
        .withColumn("forward_return", F.col("end_price") / F.col("start_price") - 1)
        .select("mode", "date", "next_date", "ticker", "side", "forward_return")
    )


def period_returns(returns: DataFrame) -> DataFrame:
    """Equal-weight return per leg and their spread; a period with an empty leg is left out."""
    return (
        returns.groupBy("mode", "date", "next_date")
        .agg(
            F.avg(F.when(F.col("side") == "long", F.col("forward_return"))).alias("long_return"),
            F.avg(F.when(F.col("side") == "short", F.col("forward_return"))).alias("short_return"),
        )
        .where(F.col("long_return").isNotNull() & F.col("short_return").isNotNull())
        .withColumn("portfolio_return", F.col("long_return") - F.col("short_return"))
    )


def turnover(portfolios: DataFrame) -> DataFrame:
    """(mode, date, next_date, turnover): share of the next portfolio that replaced old slots."""
    slot = Window.partitionBy("mode", "ticker", "side").orderBy("date")
    kept = F.lead("date").over(slot).eqNullSafe(F.col("next_date"))
    per_date = (
        with_next_date(portfolios)
        .withColumn("dropped", F.when(kept, 0).otherwise(1))
        .groupBy("mode", "date", "next_date")
        .agg(F.sum("dropped").alias("dropped"), F.count(F.lit(1)).alias("slots"))
    )
    by_date = Window.partitionBy("mode").orderBy("date")
    return (
        per_date.withColumn("next_slots", F.lead("slots").over(by_date))
        .where(F.col("next_date").isNotNull())
        .select(
            "mode",
            "date",
            "next_date",
            (F.col("dropped") / F.col("next_slots")).alias("turnover"),
        )
    )


def performance(periods: DataFrame, turnovers: DataFrame) -> DataFrame:
    """Per mode: cumulative return, annualised Sharpe ratio, average turnover, periods."""
    value = F.col("portfolio_return")
    sharpe = F.when(
        (F.count(value) >= 2) & (F.stddev_pop(value) > 0),
        F.avg(value) / F.stddev_samp(value) * F.sqrt(F.lit(PERIODS_PER_YEAR)),
    )
    gains = periods.groupBy("mode").agg(
        (F.product(1 + value) - 1).alias("cumulative_return"),
        sharpe.alias("sharpe"),
        F.count(value).alias("n_periods"),
    )
    moves = turnovers.groupBy("mode").agg(F.avg("turnover").alias("avg_turnover"))
    return gains.join(moves, "mode", "full_outer").select(
        "mode",
        F.coalesce("cumulative_return", F.lit(0.0)).alias("cumulative_return"),
        "sharpe",
        F.coalesce("avg_turnover", F.lit(0.0)).alias("avg_turnover"),
        F.coalesce("n_periods", F.lit(0)).alias("n_periods"),
    )


def equity_curve(portfolios: DataFrame, periods: DataFrame) -> DataFrame:
    """(mode, date, equity): 1.0 at the first portfolio, then compounded at each period's end.

    One row per period and mode, so the running product's window is as short as the calendar.
    """
    start = portfolios.groupBy("mode").agg(F.min("date").alias("date"))
    steps = start.select("mode", "date", F.lit(1.0).alias("growth")).unionByName(
        periods.select(
            "mode", F.col("next_date").alias("date"), (1 + F.col("portfolio_return")).alias("growth")
        )
    )
    upto = (
        Window.partitionBy("mode")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return steps.select("mode", "date", F.product("growth").over(upto).alias("equity"))


def compare_modes(portfolios: DataFrame) -> DataFrame:
    """Positions whose side differs between the modes, on dates on which both have a portfolio."""
    sides = portfolios.groupBy("date", "ticker").agg(
        # A ticker in both legs counts as short.
        F.max(F.when(F.col("mode") == POINT_IN_TIME, F.col("side"))).alias("point_in_time_side"),
        F.max(F.when(F.col("mode") == LATEST, F.col("side"))).alias("latest_side"),
    )
    on_date = Window.partitionBy("date")
    both = (
        F.max("point_in_time_side").over(on_date).isNotNull()
        & F.max("latest_side").over(on_date).isNotNull()
    )
    return (
        sides.withColumn("both", both)
        .where(
            F.col("both") & ~F.col("point_in_time_side").eqNullSafe(F.col("latest_side"))
        )
        .drop("both")
    )


def difference_counts(differences: DataFrame) -> DataFrame:
    """One row: position differences and the dates they fall on."""
    return differences.agg(
        F.count(F.lit(1)).alias("n_differences"), F.count_distinct("date").alias("n_dates")
    )


def case_studies(differences: DataFrame, panel: DataFrame) -> DataFrame:
    """The restated facts behind each differing position.

    A position that one mode had no data for has none. `panel` is read twice: pass a stored one.
    """

    def facts_of(mode: str) -> DataFrame:
        return panel.where(F.col("mode") == mode).select("date", "ticker", F.col("facts").alias(mode))

    def of_period(facts: Column, period_end: Column) -> Column:
        # Should two quarters end on one day, the later start stands for it.
        return F.array_max(F.filter(facts, lambda fact: fact["period_end"] == period_end))

    # A position has as many facts as a trailing sum has quarters, so they meet inside its row.
    both = (
        differences.join(facts_of(POINT_IN_TIME), ["date", "ticker"])
        .join(facts_of(LATEST), ["date", "ticker"])
        .withColumn(
            "period_end",
            F.explode(F.array_distinct(F.transform(POINT_IN_TIME, lambda fact: fact["period_end"]))),
        )
    )
    traced = {
        f"{mode}_{name}": of_period(F.col(mode), F.col("period_end"))[name]
        for mode in (POINT_IN_TIME, LATEST)
        for name in ("fact_id", "accession_no", "value")
    }
    return (
        both.withColumns(traced)
        .drop(POINT_IN_TIME, LATEST)
        .where(F.col("point_in_time_value") != F.col("latest_value"))
    )
