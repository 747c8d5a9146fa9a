"""The point-in-time reader: every read is cut to what was known at one instant."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions.scalar import require
from hindcast.operators.asof import as_of, temporal_join
from hindcast.operators.frames import typed
from hindcast.schemas import table

FUNDAMENTALS = table(
    "fact_id bigint, entity_id bigint, cik string, ticker string, metric_code string, "
    "period_start date, period_end date, fiscal_year bigint, fiscal_period string, value double, "
    "unit string, source string, vendor_native_tag string, form_type string, "
    "accession_no string, filed_date date, knowledge_from timestamp"
)
PRICES = table(
    "fact_id bigint, entity_id bigint, cik string, ticker string, trade_date date, open double, "
    "high double, low double, close double, volume bigint, adj_close double, source string, "
    "knowledge_from timestamp"
)


class PointInTime:
    """Reads of the versioned tables as of `instant`, a timezone-aware datetime.

    The tables are DataFrames; results are lazy DataFrames with a fixed schema, also when empty.
    """

    def __init__(
        self,
        instant: dt.datetime,
        *,
        entity: DataFrame,
        entity_ticker: DataFrame,
        fundamental_fact: DataFrame | None = None,
        price_fact: DataFrame | None = None,
    ) -> None:
        if instant.tzinfo is None or instant.utcoffset() is None:
            raise ValueError("as_of must be timezone-aware")
        self.instant = instant.astimezone(dt.UTC)
        self._tables = {
            "entity": entity,
            "entity_ticker": entity_ticker,
            "fundamental_fact": fundamental_fact,
            "price_fact": price_fact,
        }

    def latest(self) -> PointInTime:
        """A reader of the same tables as of now."""
        return PointInTime(dt.datetime.now(dt.UTC), **self._tables)

    def _instant(self) -> Column:
        micros = (self.instant - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(
            microseconds=1
        )
        return F.timestamp_micros(F.lit(micros))

    def _table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if table is None:
            raise ValueError(f"this reader was given no {name} table")
        return table

    def _named(self, facts: DataFrame, tickers: Sequence[str] | None) -> DataFrame:
        named = temporal_join(facts, self._table("entity_ticker"), self._instant())
        if tickers is not None:
            named = named.where(F.col("ticker").isin(list(tickers)))
        return named.join(self._table("entity").select("entity_id", "cik"), "entity_id")

    def fundamentals(
        self, metrics: Sequence[str], tickers: Sequence[str] | None = None
    ) -> DataFrame:
        """Facts of `metrics`; `tickers=None` reads all of them, an empty list none.

        A row filed after the instant would be a leak from the future and fails the job.
        """
        known = as_of(self._table("fundamental_fact"), self._instant())
        rows = self._named(known.where(F.col("metric_code").isin(list(metrics))), tickers)
        guarded = rows.withColumn(
            "filed_date",
            require(
                F.col("filed_date") <= F.lit(self.instant.date()),
                F.col("filed_date"),
                F.concat(
                    F.lit("look-ahead: filed_date after as_of in fact "), F.col("fact_id")
                ),
            ),
        )
        return typed(guarded, FUNDAMENTALS)

    def prices(
        self,
        tickers: Sequence[str],
        start: dt.date,
        end: dt.date,
        source: str | None = None,
    ) -> DataFrame:
        """Prices from `start` to `end`, both included; every vendor's unless one is named."""
        facts = self._table("price_fact").where(F.col("trade_date").between(start, end))
        if source is not None:
            facts = facts.where(F.col("source") == source)
        return typed(self._named(as_of(facts, self._instant()), tickers), PRICES)
