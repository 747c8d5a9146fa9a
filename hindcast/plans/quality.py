"""One data-quality run: all checks, one append of results, one pass over the exceptions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schemas
from hindcast.config import ReconciliationRule
from hindcast.operators import checks, exceptions
from hindcast.plans import load
from hindcast.plans.lineage import tracked_run
from hindcast.sources import payloads
from hindcast.sources.lake import Lake

RESULTS = "dq.check_result"
EXCEPTIONS = "dq.exception"
STORED_RESULT = T.StructType(
    [
        *schemas.CHECK_RESULT.fields,
        T.StructField("run_id", T.StringType()),
        T.StructField("evaluated_at", T.TimestampType()),
    ]
)


def all_checks(
    *,
    facts: DataFrame,
    prices: DataFrame,
    entity: DataFrame,
    payload: DataFrame,
    rules: Sequence[ReconciliationRule],
    as_of,
) -> DataFrame:
    """Results of the eight checks over the given tables."""
    documents = payload.where(
        (F.col("source") == load.FUNDAMENTAL_SOURCE) & (F.col("endpoint") == "companyfacts")
    )
    newest = payloads.latest(documents, [load.cik_request().alias("cik")])
    tasks = checks.tasks_for(prices)
    return checks.union_results(
        [
            checks.check_cross_vendor_price(prices, entity, rules, tasks=tasks),
            checks.check_balance_sheet_identity(facts, entity, newest),
            checks.check_revenue_sanity(facts, entity),
            checks.check_period_coverage_gaps(facts, entity),
            checks.check_price_staleness(prices, entity, as_of),
            checks.check_return_outliers(prices, entity, tasks=tasks),
            checks.check_payload_freshness(payload),
            checks.check_tag_switches(facts, entity),
        ]
    )


def run_checks(
    lake: Lake,
    rules: Sequence[ReconciliationRule],
    now: dt.datetime,
    price_sources: Sequence[str] = ("yfinance", "tiingo"),
) -> DataFrame:
    """Run every check, store every result, advance the exceptions; returns the run's summary.

    Results are written once. The exception state and the summary are derived from what was
    written.
    """
    with tracked_run(lake, "dq") as run:
        at = F.lit(now).cast("timestamp")
        results = all_checks(
            facts=lake.read(load.FUNDAMENTAL, schemas.FUNDAMENTAL_FACT),
            prices=load.read_prices(lake, list(price_sources)),
            entity=lake.read(load.ENTITY, schemas.ENTITY),
            payload=load.read_payloads(lake),
            rules=rules,
            as_of=at,
        ).withColumns({"run_id": F.lit(run.run_id), "evaluated_at": at})
        lake.append(RESULTS, run.counting(results), ("run_id",))
        stored = lake.read_log(RESULTS, STORED_RESULT).where(F.col("run_id") == run.run_id)
        state = lake.read(EXCEPTIONS, schemas.EXCEPTION)
        lake.replace(EXCEPTIONS, exceptions.advance(state, stored, at))
    return checks.summary(stored)
