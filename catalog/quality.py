"""Queries over the data-quality checks, the exception lifecycle and the feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog import views
from catalog.oracle import OPEN, day, ts, with_parts
from catalog.registry import ORACLES, query
from catalog.vendor import companyfacts_payloads
from catalog.views import Tables
from hindcast import config
from hindcast.operators import checks, exceptions, feeds
from hindcast.operators.frames import literal_table
from hindcast.session import cut_lineage

RULE = config.reconciliation_rules(config.RECONCILIATION)[0]

_XV = {
    "xv0": f"""
      select l.entity_id, e.cik, l.trade_date, l.adj_close as left_value, r.adj_close as right_value,
             abs(l.adj_close - r.adj_close) / abs(r.adj_close) as relative_diff
      from prices l join prices r using (entity_id, trade_date) join entity e using (entity_id)
      where l.source = 'yfinance' and r.source = 'tiingo'
        and l.knowledge_to = {OPEN} and r.knowledge_to = {OPEN}""",
    "xv1": """
      select *, case when relative_diff <= 0.015 then 'pass' else 'fail' end as status from xv0""",
    "xv2": """
      select *, sum(case when status = 'pass' then 1 else 0 end)
                  over (partition by entity_id order by trade_date) as run from xv1""",
    "xv": f"""
      select *, cast(sum(case when status = 'fail' then 1 else 0 end)
                  over (partition by entity_id, run order by trade_date) as bigint) as streak,
             cik || ':' || {day('trade_date')} as dimension_key from xv2""",
}


@query(
    with_parts(
        ["prices", "entity"],
        f"""select entity_id, {day('trade_date')} as trade_date, round(left_value, 6) as left_value,
                   round(right_value, 6) as right_value, round(relative_diff, 6) as relative_diff,
                   status, streak, case when streak >= 3 then 'BREAK' else 'WARN' end as severity,
                   dimension_key from xv""",
        _XV,
    )
)
def check_cross_vendor(t: Tables) -> DataFrame:
    return checks.cross_vendor_detail(views.price_facts(t), views.entity(t), RULE).drop("cik")


@query(
    with_parts(
        ["prices", "entity"],
        """select dimension_key, status, case when streak >= 3 then 'BREAK' else 'WARN' end as severity,
                  round(left_value, 6) as left_value, round(right_value, 6) as right_value,
                  round(relative_diff, 6) as relative_diff, 'relative' as tolerance_type,
                  cast(0.015 as double) as tolerance from xv""",
        _XV,
    )
)
def check_documents(t: Tables) -> DataFrame:
    """What the stored results say was observed and expected, read back from their JSON."""
    results = checks.check_cross_vendor_price(views.price_facts(t), views.entity(t), [RULE])

    def number(document: str, path: str) -> Column:
        return F.get_json_object(document, path).cast("double")

    return results.select(
        "dimension_key",
        "status",
        "severity",
        number("observed", "$.left").alias("left_value"),
        number("observed", "$.right").alias("right_value"),
        number("observed", "$.relative_diff").alias("relative_diff"),
        F.get_json_object("expected", "$.tolerance_type").alias("tolerance_type"),
        number("expected", "$.tolerance").alias("tolerance"),
    )


_BALANCE = {
    "inst": """
      select lpad(cast(user_id as varchar), 10, '0') as cik, last_day(cast(ts as date) - 60) as period_end,
             cast(min(floor(value / 25) + event_id % 2 * 0.01) as double) as le
      from events group by all""",
    "bal": f"""
      select f.entity_id, i.cik, i.period_end, cast(f.value as double) as assets,
             i.le as liabilities_and_equity,
             abs(f.value - i.le) / nullif(abs(cast(f.value as double)), 0) as relative_diff
      from shifted f join entity e using (entity_id) join inst i on i.cik = e.cik
       and i.period_end = f.period_end
      where f.metric_code = 'total_assets' and f.knowledge_to = {OPEN}""",
    "balr": f"""
      select *, case when relative_diff <= 0.01 then 'pass' else 'fail' end as status,
             cik || ':' || {day('period_end')} as dimension_key from bal""",
}
_SHIFTED = {
    "shifted": """select * replace (case when period_end = date '2022-03-31' then date '2023-11-30'
                                         else date '2023-10-31' end as period_end) from facts"""
}


@query(
    with_parts(
        ["facts"],
        f"""select entity_id, cik, {day('period_end')} as period_end, round(assets, 6) as assets,
                   round(liabilities_and_equity, 6) as liabilities_and_equity,
                   round(relative_diff, 6) as relative_diff, status, dimension_key from balr""",
        {**_SHIFTED, **_BALANCE},
    )
)
def check_balance(t: Tables) -> DataFrame:
    return checks.balance_detail(_balance_facts(t), views.entity(t), _instants(t))


def _balance_facts(t: Tables) -> DataFrame:
    march = F.lit("2022-03-31").cast("date")
    return views.fundamental_facts(t).withColumn(
        "period_end",
        F.when(F.col("period_end") == march, F.lit("2023-11-30")).otherwise(F.lit("2023-10-31")).cast("date"),
    )


def _instants(t: Tables) -> DataFrame:
    value = F.floor(F.col("value") / 25) + F.col("event_id") % 2 * 0.01
    return t.events.groupBy(
        views.padded("user_id").alias("cik"),
        F.last_day(F.date_sub(F.col("ts").cast("date"), 60)).alias("period_end"),
    ).agg(F.min(value).alias("value"))


_REVENUE = {
    "rq": f"""
      select f.entity_id, e.cik, f.period_start, f.period_end,
             cast(f.value as double) * case when f.entity_id % 10 = 0
               and f.period_end = date '1999-12-31' then 10 else 1 end as value
      from qfacts f join entity e using (entity_id)
      where f.metric_code = 'net_income' and f.knowledge_to = {OPEN}
        and f.period_end - f.period_start between 80 and 100""",
    "rl": """
      select *, list_sort(list(value) over (partition by entity_id order by period_end, period_start
                            rows between 8 preceding and 1 preceding)) as before from rq""",
    "rm": """
      select *, before[cast(floor(len(before) / 2) as int) + 1] as trailing_median from rl
      where len(before) >= 4""",
    "rev": f"""
      select entity_id, cik, period_start, period_end, value, trailing_median,
             value / nullif(trailing_median, 0) as ratio,
             case when value < 0 or coalesce(value / nullif(trailing_median, 0) not between 0.3 and 3.0, false)
                  then 'fail' else 'pass' end as status,
             cik || ':' || {day('period_end')} as dimension_key from rm""",
}


def _revenue_facts(t: Tables) -> DataFrame:
    """Quarterly facts in which every tenth company has a shifted decimal in one quarter."""
    shifted = (F.col("entity_id") % 10 == 0) & (
        F.col("period_end") == F.lit("1999-12-31").cast("date")
    )
    return views.quarterly_facts(t).withColumn(
        "value", F.when(shifted, F.col("value") * 10).otherwise(F.col("value"))
    )


@query(
    with_parts(
        ["qfacts"],
        f"""select entity_id, cik, {day('period_start')} as period_start, {day('period_end')} as period_end,
                   round(value, 6) as value, round(trailing_median, 6) as trailing_median,
                   round(ratio, 6) as ratio, status, dimension_key from rev""",
        _REVENUE,
    )
)
def check_revenue_sanity(t: Tables) -> DataFrame:
    return checks.revenue_detail(_revenue_facts(t), views.entity(t), metric="net_income")


_GAPS = {
    "gaps0": f"""
      select entity_id, metric_code, period_end,
             lag(period_end) over (partition by entity_id, metric_code order by period_end) as previous_end
      from (select distinct entity_id, metric_code, period_end from facts
            where knowledge_to = {OPEN} and fiscal_period is not null)""",
    "gaps": f"""
      select g.*, e.cik, period_end - previous_end as gap_days,
             case when period_end - previous_end > 130 then 'fail' else 'pass' end as status,
             e.cik || ':' || metric_code || ':' || {day('previous_end')} || '-' || {day('period_end')}
               as dimension_key
      from gaps0 g join entity e using (entity_id) where previous_end is not null""",
}


@query(
    with_parts(
        ["facts"],
        f"""select entity_id, metric_code, cik, {day('previous_end')} as previous_end,
                   {day('period_end')} as period_end, gap_days, status, dimension_key from gaps""",
        _GAPS,
    )
)
def check_period_gaps(t: Tables) -> DataFrame:
    return checks.period_gap_detail(views.fundamental_facts(t), views.entity(t))


_STALE = {
    "stale0": f"""
      select entity_id, max(trade_date) as max_trade_date from prices
      where source = 'yfinance' and knowledge_to = {OPEN} group by all""",
    "stale": """
      select s.entity_id, e.cik, s.max_trade_date,
             (select count(*) from range(1, greatest(date '2001-11-05' - s.max_trade_date, 0) + 1) r(i)
              where isodow(s.max_trade_date + cast(i as int)) < 6) as business_days_stale
      from stale0 s join entity e using (entity_id)""",
    "staler": """
      select *, case when business_days_stale > 5 then 'fail' else 'pass' end as status,
             cik as dimension_key from stale""",
}


@query(
    with_parts(
        ["prices", "entity"],
        f"""select entity_id, cik, {day('max_trade_date')} as max_trade_date, business_days_stale,
                   status, dimension_key from staler""",
        _STALE,
    )
)
def check_staleness(t: Tables) -> DataFrame:
    as_of = F.lit("2001-11-05 00:00:00").cast("timestamp")
    return checks.staleness_detail(views.price_facts(t), views.entity(t), as_of)


_OUTLIERS = {
    "ret": f"""
      select entity_id, trade_date,
             close / nullif(lag(close) over (partition by entity_id order by trade_date), 0) - 1
               as daily_return
      from prices where source = 'yfinance' and knowledge_to = {OPEN}""",
    "stats": """
      select *, avg(daily_return) over w as trailing_mean, stddev_samp(daily_return) over w as trailing_stddev
      from ret window w as (partition by entity_id order by trade_date
                            rows between 250 preceding and 1 preceding)""",
    "outl": f"""
      select s.entity_id, e.cik, trade_date, daily_return,
             (daily_return - trailing_mean) / trailing_stddev as z_score,
             case when abs((daily_return - trailing_mean) / trailing_stddev) > 4 then 'fail' else 'pass' end
               as status,
             e.cik || ':' || {day('trade_date')} as dimension_key
      from stats s join entity e using (entity_id)
      where daily_return is not null and trailing_stddev > 1e-12""",
}


@query(
    with_parts(
        ["prices", "entity"],
        f"""select entity_id, {day('trade_date')} as trade_date, round(daily_return, 6) as daily_return,
                   round(z_score, 4) + 0.0 as z_score, status, dimension_key from outl""",
        _OUTLIERS,
    )
)
def check_return_outliers(t: Tables) -> DataFrame:
    return _outliers(checks.return_outlier_detail(views.price_facts(t), views.entity(t)))


def _outliers(detail: DataFrame) -> DataFrame:
    return detail.select(
        "entity_id", "trade_date", "daily_return", F.round("z_score", 4).alias("z_score"),
        "status", "dimension_key",
    )


@query(ORACLES["check_return_outliers"])
def return_outliers_hot(t: Tables) -> DataFrame:
    """The same scores, with every longer series cut into chunks as a hot one is."""
    return _outliers(
        checks.return_outlier_detail(cut_lineage(views.price_facts(t)), views.entity(t), hot_key_rows=40)
    )


_FRESH = {
    "fresh0": """
      select *, lag(content_sha256) over w as previous_hash, lag(fetched_at) over w as previous_fetched_at
      from payload window w as (partition by source, endpoint, ticker order by fetched_at, payload_id)""",
    "fresh": """
      select *, content_sha256 = previous_hash as unchanged,
             cast(floor((epoch_us(fetched_at) - epoch_us(previous_fetched_at)) / 86400000000.0) as bigint)
               as days_since_previous_fetch,
             case source when 'src0' then 1 when 'src1' then 2 else 0 end as expected_refresh_days
      from fresh0 where previous_hash is not null""",
    "freshr": """
      select *, case when unchanged and days_since_previous_fetch >= expected_refresh_days
                     then 'fail' else 'pass' end as status,
             source || ':' || endpoint || ':' || ticker || ':'
               || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%f') as dimension_key from fresh""",
}
_FRESH_OPTIONS = {"expected_days": {"src0": 1, "src1": 2}, "default_days": 0}


def _feed_log(t: Tables) -> DataFrame:
    """Payloads of which a fifth repeat one body per feed, so that some fetches bring nothing new."""
    same = F.col("payload_id") % 5 < 2
    return views.payload(t).withColumn(
        "content_sha256", F.when(same, F.sha2("source", 256)).otherwise(F.col("content_sha256"))
    )


_FEED_LOG = {
    "feed": """select * replace (case when payload_id % 5 < 2 then sha256(source) else content_sha256 end
                                 as content_sha256) from payload"""
}
_FRESH = {**_FEED_LOG, **{k: v.replace("from payload window", "from feed window") for k, v in _FRESH.items()}}


@query(
    with_parts(
        ["payload"],
        f"""select source, ticker, payload_id, {ts('fetched_at')} as fetched_at,
                   cast(unchanged as bigint) as unchanged, days_since_previous_fetch,
                   expected_refresh_days, status, dimension_key from freshr""",
        _FRESH,
    )
)
def check_freshness(t: Tables) -> DataFrame:
    log = _feed_log(t).withColumn("ticker", F.col("request_params")["ticker"])
    return checks.freshness_detail(log, **_FRESH_OPTIONS).select(
        "source", "ticker", "payload_id", "fetched_at", "unchanged", "days_since_previous_fetch",
        "expected_refresh_days", "status", "dimension_key",
    )


@query(
    with_parts(
        ["payload"],
        f"""select source, ticker, payload_id, {ts('fetched_at')} as fetched_at,
                   cast(unchanged as bigint) as unchanged, days_since_previous_fetch,
                   expected_refresh_days, status, dimension_key from freshr""",
        _FRESH,
    )
)
def freshness_hot(t: Tables) -> DataFrame:
    log = _feed_log(t).withColumn("ticker", F.col("request_params")["ticker"])
    return checks.freshness_detail(log, **_FRESH_OPTIONS, hot_key_rows=8).select(
        "source", "ticker", "payload_id", "fetched_at", "unchanged", "days_since_previous_fetch",
        "expected_refresh_days", "status", "dimension_key",
    )


_TAGS = {
    "tags": """
      select f.entity_id, e.cik, metric_code,
             list_sort(list(distinct vendor_native_tag)) as used,
             case when count(distinct vendor_native_tag) > 1 then 'fail' else 'pass' end as status,
             e.cik || ':' || metric_code as dimension_key
      from facts f join entity e using (entity_id) group by 1, 2, 3"""
}


@query(
    with_parts(
        ["facts"],
        """select entity_id, metric_code, cik, array_to_string(used, ',') as tags_used, status, dimension_key
           from tags""",
        _TAGS,
    )
)
def check_tag_switch(t: Tables) -> DataFrame:
    return checks.tag_switch_detail(views.fundamental_facts(t), views.entity(t))


def all_results(t: Tables) -> DataFrame:
    """Every check's rows in the common schema."""
    facts, prices = cut_lineage(views.fundamental_facts(t)), cut_lineage(views.price_facts(t))
    entity = views.entity(t)
    as_of = F.lit("2001-11-05 00:00:00").cast("timestamp")
    tasks = checks.tasks_for(prices)
    return checks.union_results(
        [
            checks.check_cross_vendor_price(prices, entity, [RULE], tasks=tasks),
            checks.check_balance_sheet_identity(facts, entity, companyfacts_payloads(t)),
            checks.check_revenue_sanity(facts, entity),
            checks.check_period_coverage_gaps(facts, entity),
            checks.check_price_staleness(prices, entity, as_of),
            checks.check_return_outliers(prices, entity, tasks=tasks),
            checks.check_payload_freshness(_feed_log(t), **_FRESH_OPTIONS),
            checks.check_tag_switches(facts, entity),
        ]
    )


_SUMMARY = """
  select 'price_close_cross_vendor' as check_name, case when streak >= 3 then 'BREAK' else 'WARN' end
           as severity, status from xv
  union all select 'period_coverage_gaps', 'WARN', status from gaps
  union all select 'price_staleness', 'BREAK', status from staler
  union all select 'return_outliers', 'INFO', status from outl
  union all select 'payload_freshness', 'WARN', status from freshr
  union all select 'tag_switches', 'INFO', status from tags
  union all select 'balance_sheet_identity', 'BREAK', 'pass'
  union all select 'revenue_sanity', 'WARN', 'pass'"""


@query(
    with_parts(
        ["facts", "prices", "payload"],
        f"""select check_name, severity, status, count(*) as n from ({_SUMMARY}) group by all""",
        {**_XV, **_GAPS, **_STALE, **_OUTLIERS, **_FRESH, **_TAGS},
    )
)
def dq_results(t: Tables) -> DataFrame:
    """All eight checks; two of them find nothing to compare and pass vacuously."""
    return all_results(t).groupBy("check_name", "severity", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    with_parts(
        ["facts", "prices", "payload"],
        f"""select severity, count(*) as total, count(*) filter (status = 'pass') as passed,
                   count(*) filter (status = 'fail') as failed from ({_SUMMARY}) group by all""",
        {**_XV, **_GAPS, **_STALE, **_OUTLIERS, **_FRESH, **_TAGS},
    )
)
def dq_summary(t: Tables) -> DataFrame:
    return checks.summary(all_results(t))


# ---- Exceptions ----


def _run_results(t: Tables, status) -> DataFrame:
    """One result per order status and customer, as a check keyed by customer would give."""
    order = t.orders.where(F.col("o_orderkey") % 3 != F.lit(status))
    return order.select(
        F.lit("order_status").alias("check_name"),
        F.col("o_custkey").cast("string").alias("dimension_key"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "BREAK").otherwise("WARN").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"),
        F.col("o_custkey").alias("entity_id"),
        F.col("o_orderkey").alias("ordinal"),
    )


_EXC = {
    "r1": """select o_custkey, arg_max(o_orderstatus = 'F', o_orderkey) as failed,
                    arg_max(o_orderpriority = '1-URGENT', o_orderkey) as urgent
             from orders where o_orderkey % 3 <> 0 group by all""",
    "r2": """select o_custkey, arg_max(o_orderstatus = 'F', o_orderkey) as failed,
                    arg_max(o_orderpriority = '1-URGENT', o_orderkey) as urgent
             from orders where o_orderkey % 3 <> 1 group by all""",
}


@query(
    with_parts(
        [],
        """select cast(coalesce(a.o_custkey, b.o_custkey) as varchar) as dimension_key,
                  coalesce(a.o_custkey, b.o_custkey) as entity_id,
                  case when case when a.failed then a.urgent else b.urgent end then 'BREAK' else 'WARN' end
                    as severity,
                  case when case when b.failed then b.urgent else a.urgent end then 'BREAK' else 'WARN' end
                    as last_severity,
                  case when not coalesce(a.failed, false) then 'open'
                       when not coalesce(b.failed, true) then 'closed' else 'open' end as status,
                  case when coalesce(a.failed, false) then '2024-01-01 00:00:00'
                       else '2024-01-02 00:00:00' end as opened_at,
                  case when coalesce(a.failed, false) and not coalesce(b.failed, true)
                       then '2024-01-02 00:00:00' end as closed_at,
                  case when coalesce(a.failed, false) and not coalesce(b.failed, true)
                       then 'auto-resolved: check passed again' end as resolution_note
           from r1 a full join r2 b using (o_custkey)
           where coalesce(a.failed, false) or coalesce(b.failed, false)""",
        _EXC,
    )
)
def exception_advance(t: Tables) -> DataFrame:
    """Two runs: the first opens exceptions, the second opens, keeps or closes them."""
    first_run = F.lit("2024-01-01 00:00:00").cast("timestamp")
    second_run = F.lit("2024-01-02 00:00:00").cast("timestamp")
    none = exceptions.empty_exceptions(t.spark)
    after_first = exceptions.advance(none, _run_results(t, 0), first_run)
    return exceptions.advance(after_first, _run_results(t, 1), second_run).drop(
        "exception_id", "check_name"
    )


# ---- Feeds ----

_FEED_SQL = {
    "sla": """
      select source, 1 + i % 7 as expected_days, 3 + i % 11 as max_days
      from (select distinct source, cast(substr(source, 4) as bigint) as i from documents
            union select source || '0', cast(substr(source, 4) as bigint) + 1000 from documents)""",
    "feed_age": """
      select s.*, m.last_fetched_at,
             (epoch_us(timestamp '2024-02-18 12:00:00') - epoch_us(m.last_fetched_at)) / 86400000000.0
               as staleness_days
      from sla s left join (select source, max(fetched_at) as last_fetched_at from aged group by all) m
        using (source)""",
    "status": """
      select source, last_fetched_at, staleness_days,
             case when last_fetched_at is null then 'no_data' when staleness_days > max_days then 'breach'
                  when staleness_days > expected_days then 'stale' else 'ok' end as status from feed_age""",
}
_AGED = {
    "aged": """select source, fetched_at - to_days(cast(substr(source, 4) as int) % 9) as fetched_at
               from (select source, timestamp '2024-01-01' + to_hours(cast(doc_id % 1000 as int))
                              as fetched_at from documents)"""
}


def _feed_status(t: Tables) -> DataFrame:
    hours = F.make_dt_interval(F.lit(0), (F.col("doc_id") % 1000).cast("int"))
    days = F.make_dt_interval((F.substring("source", 4, 4).cast("int") % 9).cast("int"))
    log = t.documents.select(
        "source", (F.lit("2024-01-01 00:00:00").cast("timestamp") + hours - days).alias("fetched_at")
    )
    # Every feed of the table, and one more each, of which most have no data.
    number = F.substring("source", 4, 20).cast("bigint")
    promised = t.documents.select(
        F.inline(F.array(
            F.struct(F.col("source"), number.alias("i")),
            F.struct(F.concat("source", F.lit("0")).alias("source"), (number + 1000).alias("i")),
        ))
    ).distinct()
    sla = promised.select(
        "source",
        (1 + F.col("i") % 7).alias("expected_refresh_days"),
        (3 + F.col("i") % 11).alias("max_staleness_days"),
    )
    return feeds.feed_status(log, sla, F.lit("2024-02-18 12:00:00").cast("timestamp"))


@query(
    with_parts(
        [],
        f"""select source, {ts('last_fetched_at')} as last_fetched_at, round(staleness_days, 6) as staleness_days,
                   status from status""",
        {**_AGED, **_FEED_SQL},
    )
)
def feed_status(t: Tables) -> DataFrame:
    return _feed_status(t)


def _edges(t: Tables) -> DataFrame:
    """Feed -> language -> quality label -> toxicity label -> back to quality: has a cycle."""
    labelled = t.documents.join(t.labels, "doc_id")
    quality = F.concat(F.lit("quality:"), F.col("quality"))
    toxic = F.concat(F.lit("toxic:"), F.col("toxic"))
    return (
        t.documents.select(F.col("source").alias("src"), F.concat(F.lit("lang:"), "lang").alias("dst"))
        .unionByName(labelled.select(F.concat(F.lit("lang:"), "lang").alias("src"), quality.alias("dst")))
        .unionByName(labelled.select(quality.alias("src"), toxic.alias("dst")))
        .unionByName(labelled.select(toxic.alias("src"), quality.alias("dst")))
    )


_EDGES = {
    "edges": """
      select distinct source as src, 'lang:' || lang as dst from documents
      union select 'lang:' || lang, 'quality:' || quality from documents join labels using (doc_id)
      union select 'quality:' || quality, 'toxic:' || toxic from documents join labels using (doc_id)
      union select 'toxic:' || toxic, 'quality:' || quality from documents join labels using (doc_id)"""
}
_REACH = """with recursive edges as ({edges}), reach(root, node) as (
  select src, dst from edges where src like 'src%'
  union select r.root, e.dst from reach r join edges e on r.node = e.src) """


@query(_REACH.format(**_EDGES) + "select root, node from reach")
def blast_radius(t: Tables) -> DataFrame:
    roots = t.documents.select(F.col("source").alias("root")).distinct()
    return feeds.downstream(_edges(t), roots)


@query(
    "with recursive "
    + ", ".join(f"{k} as ({v})" for k, v in {**_AGED, **_FEED_SQL, **_EDGES}.items())
    + """, reach(root, node) as (
        select src, dst from edges where src in (select source from status where status in ('stale', 'breach'))
        union select r.root, e.dst from reach r join edges e on r.node = e.src)
      select node, count(distinct root) as n_feeds from reach group by all"""
)
def at_risk(t: Tables) -> DataFrame:
    return feeds.at_risk(_feed_status(t), _edges(t))


_CHAINED = """
  edges as (
    select 'c' || c_custkey as src, 'c' || case when c_custkey % 10 = 0 then c_custkey - 9 else c_custkey + 1 end as dst
    from customer
    union select 'c' || c_custkey, 's' || (c_custkey % 97) from customer where c_custkey % 25 = 0
    union select 's' || s_suppkey, 'n' || s_nationkey from supplier),
  status as (
    select 'c' || c_custkey as source, case when c_acctbal < 0 then 'breach' when c_acctbal < 1000 then 'stale'
                                            else 'ok' end as status
    from customer)"""


@query(
    f"""with recursive {_CHAINED}, reach(root, node) as (
          select src, dst from edges where src in (select source from status where status <> 'ok')
          union select r.root, e.dst from reach r join edges e on r.node = e.src)
        select node, count(distinct root) as n_feeds from reach group by all"""
)
def at_risk_rings(t: Tables) -> DataFrame:
    """A deep graph with a ring of every ten customers, more failing feeds than bits in a word."""
    def named(prefix: str, number: Column) -> Column:
        return F.concat(F.lit(prefix), number.cast("string"))

    key = F.col("c_custkey")
    after = F.when(key % 10 == 0, key - 9).otherwise(key + 1)
    edges = (
        t.customer.select(named("c", key).alias("src"), named("c", after).alias("dst"))
        .unionByName(
            t.customer.where(key % 25 == 0).select(named("c", key).alias("src"), named("s", key % 97).alias("dst"))
        )
        .unionByName(
            t.supplier.select(
                named("s", F.col("s_suppkey")).alias("src"), named("n", F.col("s_nationkey")).alias("dst")
            )
        )
    )
    worst = F.when(F.col("c_acctbal") < 0, "breach").when(F.col("c_acctbal") < 1000, "stale").otherwise("ok")
    return feeds.at_risk(t.customer.select(named("c", key).alias("source"), worst.alias("status")), edges)
