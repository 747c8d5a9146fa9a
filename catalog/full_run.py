"""One run from landed documents to stored check results: land, parse, load, check.

The companies are the nations of `supplier`, so a document holds at most the calendar of one of them,
however many line items there are. Faults are put into the documents, for every check to find.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.oracle import day
from catalog.registry import query
from catalog.views import Tables
from hindcast import config
from hindcast.plans import lineage, load, quality
from hindcast.session import cut_lineage, ensure_checkpoint_dir
from hindcast.sources.lake import Lake

_BEST_TAG = "RevenueFromContractWithCustomerExcludingAssessedTax"
_NEXT_TAG = "SalesRevenueNet"
_UNMAPPED = 24  # the nation that the ticker map leaves out
_EDGAR = ["2002-01-01", "2002-02-01", "2002-06-01"]
_PRICES = ["2002-02-01", "2002-02-10"]
_NOW = dt.datetime(2001, 11, 5, tzinfo=dt.UTC)

# ---- Documents ----


def _daily(t: Tables) -> DataFrame:
    """(n, d, cents, k): cents and number of line items of a nation's suppliers per day."""
    nation = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("n"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return cut_lineage(
        t.lineitem.join(nation, "l_suppkey")
        .groupBy("n", F.col("l_shipdate").cast("date").alias("d"))
        .agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("k"))
    )


def _quarters(daily: DataFrame) -> DataFrame:
    """(n, start, end, value): quarterly revenue; one company in six lacks a quarter."""
    sums = daily.groupBy("n", F.trunc("d", "quarter").alias("start")).agg(F.sum("cents").alias("cents"))
    shifted = (F.col("n") % 10 == 0) & (F.col("start") == F.lit("1999-10-01").cast("date"))
    return sums.where(~((F.col("n") % 6 == 1) & (F.col("start") == F.lit("1995-07-01").cast("date")))).select(
        "n",
        "start",
        F.date_sub(F.add_months("start", 3), 1).alias("end"),
        (F.expr("cents div 100") * F.when(shifted, 10).otherwise(1)).alias("value"),
    )


def _companyfacts(quarters: DataFrame) -> DataFrame:
    """(n, body): a company's document, with its balance sheets and some restatements."""
    fourth = F.quarter("start") == 4

    def point(start: Column, value: Column, version: str = "", delay: int = 30) -> Column:
        return F.struct(
            start.cast("string").alias("start"),
            F.col("end").cast("string").alias("end"),
            value.alias("val"),
            F.concat_ws("-", "n", F.col("end").cast("string"), F.lit(f"v{version}")).alias("accn"),
            F.year("start").alias("fy"),
            F.concat(F.lit("Q"), F.quarter("start")).alias("fp"),
            F.lit("10-Q").alias("form"),
            F.date_add("end", delay).cast("string").alias("filed"),
        )

    instant = F.lit(None).cast("date")
    off = F.when((F.col("n") % 4 == 0) & (F.quarter("start") == 2), F.expr("value div 50")).otherwise(0)
    restated = (F.col("n") % 5 == 2) & fourth & F.col("restating")
    first = F.when((F.col("n") + F.year("start")) % 5 != 0, _BEST_TAG).otherwise(_NEXT_TAG)
    reports = F.array(
        F.struct(first.alias("tag"), point(F.col("start"), F.col("value")).alias("point")),
        F.struct(
            F.when(restated, first).alias("tag"), point(F.col("start"), F.col("value") + 5, "r", 200).alias("point")
        ),
        F.struct(F.lit("Assets").alias("tag"), point(instant, F.col("value") + 1000).alias("point")),
        F.struct(
            F.lit("LiabilitiesAndStockholdersEquity").alias("tag"),
            point(instant, F.col("value") + 1000 + off).alias("point"),
        ),
    )
    tags = [_BEST_TAG, _NEXT_TAG, "Assets", "LiabilitiesAndStockholdersEquity"]
    gathered = quarters.select("n", F.inline(reports)).groupBy("n").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("tag") == tag, F.col("point")))).alias(tag) for tag in tags]
    )
    facts = F.struct(*[F.struct(F.struct(F.col(tag).alias("USD")).alias("units")).alias(tag) for tag in tags])
    document = F.struct(
        (F.col("n") + 1).alias("cik"),
        F.concat(F.lit("Nation "), F.col("n")).alias("entityName"),
        F.struct(facts.alias("us-gaap")).alias("facts"),
    )
    return gathered.select("n", F.to_json(document).alias("body"))


def _histories(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, body) of CSV and of JSON price histories, one document a nation."""
    mean = F.expr("cents div k")
    close = mean * F.when((F.col("n") % 4 == 0) & (F.dayofyear("d") % 97 == 0), 3).otherwise(1) / F.lit(100.0)
    adjusted = mean / F.lit(100.0)
    off = F.when(
        (F.col("n") % 3 == 0) & (F.dayofmonth("d") <= 5), F.expr("cents div k * 105 div 100")
    ).otherwise(mean) / F.lit(100.0)
    text = F.col("d").cast("string")
    stopped = (F.col("n") % 8 == 1) & (F.col("d") > F.lit("2001-10-01").cast("date"))
    cells = [close, close, close, close, adjusted, F.col("k")]
    line = F.concat_ws(
        ",", F.concat(text, F.lit(" 23:30:00-05:00")), *[c.cast("string") for c in cells], F.lit("0.0,0.0")
    )
    header = F.lit("Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits")
    csv = daily.where(~stopped).groupBy("n").agg(F.sort_array(F.collect_list(line)).alias("lines")).select(
        "n", F.concat_ws("\n", header, F.array_join("lines", "\n"), F.lit("")).alias("body")
    )
    names = ["open", "high", "low", "close", "adjOpen", "adjHigh", "adjLow", "adjClose"]
    values = [close] * 4 + [off] * 4
    point = F.struct(
        F.concat(text, F.lit("T00:00:00.000Z")).alias("date"),
        *[value.alias(name) for name, value in zip(names, values, strict=True)],
        F.col("k").alias("volume"), F.col("k").alias("adjVolume"),
        F.lit(0.0).alias("divCash"), F.lit(1.0).alias("splitFactor"),
    )
    js = daily.groupBy("n").agg(F.to_json(F.sort_array(F.collect_list(point))).alias("body"))
    return csv, js


def _responses(bodies: DataFrame, endpoint: str, fetched: str, status: Column | int = 200) -> DataFrame:
    ticker = F.concat(F.lit("T"), F.col("n"))
    return bodies.select(
        F.lit(endpoint).alias("endpoint"),
        F.create_map(F.lit("ticker"), ticker, F.lit("cik"), (F.col("n") + 1).cast("string")).alias("request_params"),
        F.lit(f"{fetched} 00:00:00").cast("timestamp").alias("fetched_at"),
        (F.lit(status) if isinstance(status, int) else status).alias("http_status"),
        F.col("body").cast("binary").alias("body"),
    )


def _run(t: Tables) -> Lake:
    """Land, parse, load and check. Some later responses are errors."""
    lake = Lake(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/lake-{uuid.uuid4().hex}")
    daily = _daily(t)
    quarters = _quarters(daily)
    before = quarters.where(F.col("end") < F.lit("1997-01-01").cast("date"))
    early = _companyfacts(before.withColumn("restating", F.lit(False)))
    full = cut_lineage(_companyfacts(quarters.withColumn("restating", F.lit(True))))
    entry = F.struct(
        (F.col("n") + 1).alias("cik_str"),
        F.concat(F.lit("t"), F.col("n")).alias("ticker"),
        F.concat(F.lit("Nation "), F.col("n")).alias("title"),
    )
    mapped = daily.where(F.col("n") != _UNMAPPED).select("n").distinct()
    numbered = F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("string"), entry)))
    ticker_map = mapped.agg(F.to_json(numbered).alias("body"), F.lit(0).alias("n"))
    nobody = F.create_map().cast("map<string,string>")
    load.land(lake, _responses(ticker_map, "ticker_map", _EDGAR[0]).withColumn("request_params", nobody), "edgar")
    load.land(lake, _responses(early, "companyfacts", _EDGAR[0]), "edgar")
    lost = F.col("n") % 7 == 3
    answered = full.withColumn("body", F.when(lost, F.lit("unavailable")).otherwise(F.col("body")))
    load.land(lake, _responses(answered, "companyfacts", _EDGAR[1], F.when(lost, 500).otherwise(200)), "edgar")
    load.land(lake, _responses(full.where("n % 2 = 0"), "companyfacts", _EDGAR[2]), "edgar")
    csv, js = _histories(daily)
    load.land(lake, _responses(csv, "history", _PRICES[0]), "yfinance")
    load.land(lake, _responses(csv.where("n % 3 = 0"), "history", _PRICES[1]), "yfinance")
    load.land(lake, _responses(js, "prices", _PRICES[0]), "tiingo")
    universe = daily.select(F.concat(F.lit("T"), F.col("n")).alias("ticker"), F.col("n").alias("ordinal")).distinct()
    load.run_parse(lake, universe, config.metric_map(config.METRICS))
    load.load_fundamentals(lake, 1)
    load.load_prices(lake, "yfinance", 1)
    load.load_prices(lake, "tiingo", 1)
    quality.run_checks(lake, config.reconciliation_rules(config.RECONCILIATION), _NOW)
    return lake


# ---- What must come out, computed from the line items alone ----

_CIK = "lpad(cast(n + 1 as varchar), 10, '0')"
_STEPS = {
    "daily": """
      select cast(s_nationkey as bigint) as n, cast(l_shipdate as date) as d,
             cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents, count(*) as k
      from lineitem join supplier on s_suppkey = l_suppkey group by all""",
    "quarters": """
      select n, start, cast(start + interval 3 month as date) - 1 as "end",
             cents // 100 * case when n % 10 = 0 and start = date '1999-10-01' then 10 else 1 end as value
      from (select n, cast(date_trunc('quarter', d) as date) as start, cast(sum(cents) as bigint) as cents
            from daily group by all)
      where not (n % 6 = 1 and start = date '1995-07-01')""",
    # The newest successful document is the first one for odd companies whose second fetch failed.
    "known": f"""
      select *, {_CIK} as cik,
             n % 5 = 2 and quarter(start) = 4 and not (n % 7 = 3 and n % 2 = 1) as restated,
             case when (n + year(start)) % 5 <> 0 then '{_BEST_TAG}' else '{_NEXT_TAG}' end as tag
      from quarters
      where n <> {_UNMAPPED} and (not (n % 7 = 3 and n % 2 = 1) or "end" < date '1997-01-01')""",
    "mean": "select *, cents // k as c from daily",
    "csv": f"""
      select n, {_CIK} as cik, d, c / cast(100 as double) as adjusted,
             c * case when n % 4 = 0 and dayofyear(d) % 97 = 0 then 3 else 1 end / cast(100 as double) as close
      from mean where not (n % 8 = 1 and d > date '2001-10-01')""",
    "js": """
      select n, d, case when n % 3 = 0 and dayofmonth(d) <= 5 then c * 105 // 100 else c end
                   / cast(100 as double) as adjusted
      from mean""",
    "compared": f"""
      select n, cik, d, abs(csv.adjusted - js.adjusted) / abs(js.adjusted) <= 0.015 as agrees
      from csv join js using (n, d) where n <> {_UNMAPPED}""",
    "grouped": """
      select *, sum(cast(agrees as int)) over (partition by n order by d) as part from compared""",
    "vendors": f"""
      select 'price_close_cross_vendor' as check_name, cik || ':' || {day('d')} as dimension_key,
             case when sum(cast(not agrees as int)) over (partition by n, part order by d) >= 3
                  then 'BREAK' else 'WARN' end as severity, agrees as good
      from grouped""",
    "balance": f"""
      select 'balance_sheet_identity' as check_name, cik || ':' || {day('"end"')} as dimension_key,
             'BREAK' as severity,
             case when n % 4 = 0 and quarter(start) = 2 then value // 50 else 0 end
               / cast(value + 1000 as double) <= 0.01 as good
      from known""",
    "before": """
      select *, list_sort(list(now) over (partition by n order by "end"
                            rows between 8 preceding and 1 preceding)) as earlier
      from (select *, cast(value + case when restated then 5 else 0 end as double) as now from known)""",
    "revenue": f"""
      select 'revenue_sanity' as check_name, cik || ':' || {day('"end"')} as dimension_key, 'WARN' as severity,
             now >= 0 and coalesce(
               now / nullif(earlier[cast(floor(len(earlier) / 2) as int) + 1], 0) between 0.3 and 3.0, true) as good
      from before where len(earlier) >= 4""",
    "gaps": f"""
      select 'period_coverage_gaps' as check_name,
             cik || ':' || metric || ':' || {day('previous')} || '-' || {day('"end"')} as dimension_key,
             'WARN' as severity, "end" - previous <= 130 as good
      from (select *, lag("end") over (partition by n order by "end") as previous from known),
           (select unnest(['revenue', 'total_assets']) as metric)
      where previous is not null""",
    "stale": f"""
      select 'price_staleness' as check_name, cik as dimension_key, 'BREAK' as severity,
             (select count(*) from range(1, greatest(date '2001-11-05' - newest, 0) + 1) r(i)
              where isodow(newest + cast(i as int)) < 6) <= 5 as good
      from (select cik, max(d) as newest from csv where n <> {_UNMAPPED} group by all)""",
    "returns": f"""
      select n, cik, d, close / nullif(lag(close) over (partition by n order by d), 0) - 1 as r
      from csv where n <> {_UNMAPPED}""",
    "moments": """
      select *, avg(r) over w as mean, stddev_samp(r) over w as deviation from returns
      window w as (partition by n order by d rows between 250 preceding and 1 preceding)""",
    "outliers": f"""
      select 'return_outliers' as check_name, cik || ':' || {day('d')} as dimension_key, 'INFO' as severity,
             abs((r - mean) / deviation) <= 4 as good
      from moments where r is not null and deviation > 1e-12""",
    "companies": "select distinct n from daily",
    "fresh": f"""
      select 'payload_freshness' as check_name, feed || ':T' || n || ':' || fetched || 'T00:00:00.000000' as dimension_key,
             'WARN' as severity, good
      from (select n, 'edgar:companyfacts' as feed, '{_EDGAR[1]}' as fetched, true as good from companies
            union all select n, 'edgar:companyfacts', '{_EDGAR[2]}', n % 7 = 3 from companies where n % 2 = 0
            union all select n, 'yfinance:history', '{_PRICES[1]}', false from companies where n % 3 = 0)""",
    "tags": """
      select 'tag_switches' as check_name, cik || ':revenue' as dimension_key, 'INFO' as severity,
             count(distinct tag) = 1 as good from known group by cik
      union all select distinct 'tag_switches', cik || ':total_assets', 'INFO', true from known""",
    "results": """
      select * from vendors union all select * from balance union all select * from revenue
      union all select * from gaps union all select * from stale union all select * from outliers
      union all select * from fresh union all select * from tags""",
}
_WITH = "with " + ",\n".join(f"{name} as materialized ({sql})" for name, sql in _STEPS.items())


@query(
    f"""{_WITH}
    select check_name, dimension_key, severity, case when good then 'pass' else 'fail' end as status,
           cast(not good as bigint) as listed
    from results"""
)
def parse_load_check(t: Tables) -> DataFrame:
    """Every stored result of a run over parsed documents, and whether the report lists it as open."""
    lake = _run(t)
    results = lake.read_log(quality.RESULTS, quality.STORED_RESULT)
    state = lake.read(quality.EXCEPTIONS, quality.schemas.EXCEPTION)
    listed = quality.exceptions.open_exceptions(state).select("check_name", "dimension_key", F.lit(1).alias("listed"))
    return results.join(listed, ["check_name", "dimension_key"], "left").select(
        "check_name", "dimension_key", "severity", "status", F.coalesce("listed", F.lit(0)).alias("listed")
    )


@query(
    f"""{_WITH},
    staged as (select (select count(*) from known) * 2 + (select count(*) from known where restated) as n),
    all_csv as (select count(*) as n, count(*) filter (n <> {_UNMAPPED}) as mapped from csv),
    again as (select count(*) as n from csv where n % 3 = 0),
    all_js as (select count(*) as n, count(*) filter (n <> {_UNMAPPED}) as mapped from js)
    select 'ingest:edgar' as pipeline, 'success' as status, 1 as rows_in, 1 as rows_out
    union all select 'ingest:edgar', 'success', n, n from (select count(distinct n) as n from quarters
      where "end" < date '1997-01-01')
    union all select 'ingest:edgar', 'success', count(*), count(*) from companies
    union all select 'ingest:edgar', 'success', count(*), count(*) from companies where n % 2 = 0
    union all select 'ingest:edgar', 'failed', 0, 0
    union all select 'ingest:yfinance', 'success', count(*), count(*) from companies
    union all select 'ingest:yfinance', 'success', count(*), count(*) from companies where n % 3 = 0
    union all select 'ingest:tiingo', 'success', count(*), count(*) from companies
    union all select 'parse', 'success', (select count(distinct cik) from known), n from staged
    union all select 'load-fundamentals', 'success', n, n from staged
    union all select 'load-prices:yfinance', 'success', a.n + b.n, a.mapped from all_csv a, again b
    union all select 'load-prices:tiingo', 'success', n, mapped from all_js
    union all select 'dq', 'success', 0, count(*) from results"""
)
def full_run_counters(t: Tables) -> DataFrame:
    """The recorded runs, with that of a landing which is refused because a response has no body."""
    lake = _run(t)
    log = load.read_payloads(lake).where(F.col("endpoint") == "companyfacts")
    try:
        load.land(lake, log.withColumn("body", F.lit(None).cast("binary")), "edgar")
    except PySparkException:
        pass  # recorded as failed, and nothing landed
    return lineage.runs(lake).select("pipeline", "status", "rows_in", "rows_out")
