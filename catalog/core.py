"""Queries over the versioned tables: chains, reads, joins, mappings, integrity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog import oracle, views
from catalog.oracle import OPEN, day, knowledge, ts, with_parts
from catalog.registry import query
from catalog.views import Tables
from hindcast import schemas
from hindcast.functions import calendar
from hindcast.operators import asof, chain, coverage, integrity, scd2
from hindcast.plans.reader import PointInTime
from hindcast.session import cut_lineage
from hindcast.sources import payloads

# Low enough that keys of the given tables take the path of hot keys.
HOT_ROWS = 8

_FACT_COLUMNS = [
    "entity_id", "metric_code", "period_start", "period_end", "value", "unit", "accession_no",
    "filed_date", "knowledge_from", "knowledge_to",
]
_FACT_SQL = (
    f"entity_id, metric_code, {day('period_start')} as period_start, {day('period_end')} as period_end, "
    f"cast(value as double) as value, unit, accession_no, {day('filed_date')} as filed_date, "
    f"{ts('knowledge_from')} as knowledge_from, {ts('knowledge_to')} as knowledge_to"
)


@query(with_parts(["facts"], f"select {_FACT_SQL}, prior_accession from facts"))
def fact_chain(t: Tables) -> DataFrame:
    stg = views.stg_facts(t)
    known, _ = chain.with_entity(chain.loadable(stg), views.entity(t))
    keys = ["entity_id", "metric_code", "period_start", "period_end"]
    facts = chain.version_chain(known, keys, lag_days=1, total=stg)
    return facts.select(*_FACT_COLUMNS, F.col("prior_version").alias("prior_accession"))


@query(with_parts(["facts"], f"select {_FACT_SQL}, prior_accession from facts"))
def fact_chain_hot(t: Tables) -> DataFrame:
    """The same chains, with every longer key scanned in chunks as a hot one is."""
    stg = views.stg_facts(t)
    known, _ = chain.with_entity(chain.loadable(stg), views.entity(t))
    keys = ["entity_id", "metric_code", "period_start", "period_end"]
    facts = chain.version_chain(known, keys, lag_days=1, total=stg, hot_key_rows=HOT_ROWS)
    return facts.select(*_FACT_COLUMNS, F.col("prior_version").alias("prior_accession"))


def _reader(t: Tables, day_: str, **facts: DataFrame) -> PointInTime:
    return PointInTime(
        dt.datetime.fromisoformat(day_).replace(tzinfo=dt.UTC),
        entity=views.entity(t),
        entity_ticker=views.entity_ticker(t),
        **facts,
    )


_READ = """
  select f.entity_id, e.cik, m.ticker, metric_code, {start} as period_start,
         {end} as period_end, fiscal_year, fiscal_period, cast(value as double) as value, unit,
         vendor_native_tag, accession_no, {filed} as filed_date, {kf} as knowledge_from
  from facts f join entity e using (entity_id) join mapping m using (entity_id)
  where f.knowledge_from <= timestamp '{at}' and f.knowledge_to > timestamp '{at}'
    and m.knowledge_from <= timestamp '{at}' and m.knowledge_to > timestamp '{at}'
    and metric_code in ('revenue', 'net_income') {more}"""


def _read_sql(at: str, more: str = "") -> str:
    return with_parts(
        ["facts", "mapping"],
        _READ.format(
            at=at, more=more, start=day("period_start"), end=day("period_end"),
            filed=day("filed_date"), kf=ts("f.knowledge_from"),
        ),
    )


def _read(reader: PointInTime, tickers: list[str] | None = None) -> DataFrame:
    return reader.fundamentals(["revenue", "net_income"], tickers).drop(
        "fact_id", "source", "form_type"
    )


@query(_read_sql("2024-01-20"))
def asof_read(t: Tables) -> DataFrame:
    return _read(_reader(t, "2024-01-20", fundamental_fact=views.fundamental_facts(t)))


@query(_read_sql("2024-01-10", "and m.ticker in ('T1', 'T3', 'T3_OLD', 'T8', 'T13_OLD')"))
def asof_read_tickers(t: Tables) -> DataFrame:
    reader = _reader(t, "2024-01-10", fundamental_fact=views.fundamental_facts(t))
    return _read(reader, ["T1", "T3", "T3_OLD", "T8", "T13_OLD"])


@query(with_parts(["facts"], f"select {_FACT_SQL} from facts where knowledge_to = {OPEN}"))
def asof_latest(t: Tables) -> DataFrame:
    return asof.current_versions(views.fundamental_facts(t)).select(*_FACT_COLUMNS)


@query(
    with_parts(
        ["prices", "mapping", "entity"],
        f"""select p.entity_id, e.cik, m.ticker, {day('trade_date')} as trade_date, close, volume,
                   round(adj_close, 6) as adj_close, source, {ts('p.knowledge_from')} as knowledge_from
            from prices p join entity e using (entity_id) join mapping m using (entity_id)
            where p.knowledge_from <= timestamp '1999-06-01' and p.knowledge_to > timestamp '1999-06-01'
              and m.knowledge_from <= timestamp '1999-06-01' and m.knowledge_to > timestamp '1999-06-01'
              and trade_date between date '1998-01-01' and date '1999-12-31' and source = 'yfinance'
              and m.ticker in ('T0', 'T1', 'T2', 'T4', 'T5')""",
    )
)
def asof_prices(t: Tables) -> DataFrame:
    return _reader(t, "1999-06-01", price_fact=views.price_facts(t)).prices(
        ["T0", "T1", "T2", "T4", "T5"], dt.date(1998, 1, 1), dt.date(1999, 12, 31), "yfinance"
    ).drop("fact_id", "open", "high", "low")


@query(
    with_parts(
        ["prices"],
        f"""select entity_id, source, {day('trade_date')} as trade_date, close,
                   round(adj_close, 6) as adj_close, volume, payload_id,
                   {ts('knowledge_from')} as knowledge_from, {ts('knowledge_to')} as knowledge_to
            from prices""",
    )
)
def price_chain(t: Tables) -> DataFrame:
    return views.price_facts(t).select(
        "entity_id", "source", "trade_date", "close", "adj_close", "volume", "payload_id",
        "knowledge_from", "knowledge_to",
    )


@query(
    with_parts(
        ["prices"],
        f"""select entity_id, source, {day('trade_date')} as trade_date, close,
                   round(adj_close, 6) as adj_close, volume, payload_id,
                   {ts('knowledge_from')} as knowledge_from, {ts('knowledge_to')} as knowledge_to
            from prices""",
    )
)
def price_chain_hot(t: Tables) -> DataFrame:
    return views.price_facts(t, hot_key_rows=2).select(
        "entity_id", "source", "trade_date", "close", "adj_close", "volume", "payload_id",
        "knowledge_from", "knowledge_to",
    )


@query(
    with_parts(
        ["stg"],
        f"""select cik, metric_code, {day('period_start')} as period_start,
                   {day('period_end')} as period_end, vendor_native_tag, payload_id
            from (select *, event_id % 3 as priority,
                         min(event_id % 3) over (partition by cik, metric_code, period_start, period_end)
                           as best from stg) where priority = best""",
    )
)
def tag_priority(t: Tables) -> DataFrame:
    points = views.stg_facts(t).withColumn("priority", F.col("payload_id") % 3)
    best = chain.best_tag_points(points, ["cik", "metric_code", "period_start", "period_end"])
    return best.select(
        "cik", "metric_code", "period_start", "period_end", "vendor_native_tag", "payload_id"
    )


@query(
    with_parts(
        ["stg"],
        f"""select cik, metric_code, {day('period_start')} as period_start,
                   {day('period_end')} as period_end, accession_no, {day('filed_date')} as filed_date,
                   payload_id, cast(value as double) as value
            from stg qualify row_number() over (
              partition by cik, metric_code, period_start, period_end, accession_no
              order by filed_date, payload_id, value) = 1""",
    )
)
def dedupe_accession(t: Tables) -> DataFrame:
    rows = chain.dedupe_accessions(
        chain.loadable(views.stg_facts(t)), ["cik", "metric_code", "period_start", "period_end"]
    )
    return rows.select(
        "cik", "metric_code", "period_start", "period_end", "accession_no", "filed_date",
        "payload_id", "value",
    )


@query(
    f"""select {day('d')} as base_date, lag as lag_days, {ts(knowledge('d', 'lag'))} as known_at,
               count(*) as n
        from (select cast(o_orderdate as date) as d, o_orderkey % 5 as lag from orders)
        group by all"""
)
def knowledge_calendar(t: Tables) -> DataFrame:
    base = t.orders.select(
        F.col("o_orderdate").cast("date").alias("base_date"),
        (F.col("o_orderkey") % 5).cast("int").alias("lag_days"),
    )
    counted = base.groupBy("base_date", "lag_days").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn(
        "known_at", calendar.knowledge_from(F.col("base_date"), F.col("lag_days"))
    )


@query(
    f"""select {day('d')} as start_date, span, n,
               (select count(*) from range(1, greatest(span, 0) + 1) r(i)
                where isodow(d + cast(i as int)) < 6) as business_days
        from (select cast(o_orderdate as date) as d, o_orderkey % 40 - 5 as span, count(*) as n
              from orders group by all)"""
)
def business_days(t: Tables) -> DataFrame:
    spans = (
        t.orders.select(
            F.col("o_orderdate").cast("date").alias("start_date"),
            (F.col("o_orderkey") % 40 - 5).alias("span"),
        )
        .groupBy("start_date", "span")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    end = F.date_add("start_date", F.col("span").cast("int"))
    return spans.withColumn(
        "business_days", calendar.business_days_between(F.col("start_date"), end)
    )


@query(
    f"""select c.o_custkey, {day('q')} as quarter_start
        from (select o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from orders
              group by all) c
        join (select unnest(generate_series(timestamp '1994-01-01', timestamp '2002-01-01',
                                            interval 3 month)) as q) on q between a and b"""
)
def rebalance_calendar(t: Tables) -> DataFrame:
    spans = t.orders.groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first"),
        F.max(F.col("o_orderdate").cast("date")).alias("last"),
    )
    return spans.select(
        "o_custkey",
        F.explode(calendar.quarter_starts(F.col("first"), F.col("last"))).alias("quarter_start"),
    )


@query(
    with_parts(
        ["mapping"],
        f"""select entity_id, ticker, {ts('knowledge_from')} as knowledge_from,
                   {ts('knowledge_to')} as knowledge_to from (
            select entity_id, ticker, knowledge_from,
                   case when knowledge_to = {OPEN} and entity_id % 7 = 0
                        then timestamp '2024-03-01' else knowledge_to end as knowledge_to from old
            union all
            select s_suppkey, 'T' || s_suppkey || '_X', timestamp '2024-03-01', {OPEN}
            from supplier where s_suppkey % 7 = 0 and s_suppkey % 10 <> 9
            union all
            select s_suppkey, 'T' || s_suppkey || case when s_suppkey % 7 = 0 then '_X' else '' end,
                   timestamp '2000-01-01', {OPEN}
            from supplier where s_suppkey % 10 = 9 and s_suppkey % 3 <> 0
            union all
            select s_suppkey, 'T' || (s_suppkey - 2) || '_OLD',
                   case when exists (select 1 from old o where o.ticker = 'T' || (s_suppkey - 2) || '_OLD')
                        then timestamp '2024-03-01' else timestamp '2000-01-01' end, {OPEN}
            from supplier where s_suppkey % 10 = 9 and s_suppkey % 3 = 0)""",
        {"old": "select * from mapping where entity_id % 10 <> 9"},
    )
)
def ticker_scd2(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    ticker = F.when(
        (key % 10 == 9) & (key % 3 == 0), F.concat(F.lit("T"), key - 2, F.lit("_OLD"))
    ).otherwise(F.concat(F.lit("T"), key, F.when(key % 7 == 0, "_X").otherwise("")))
    current = t.supplier.select(key.alias("entity_id"), ticker.alias("ticker"))
    known = views.entity_ticker(t).where(F.col("entity_id") % 10 != 9)
    return scd2.merge_ticker_mapping(
        known, current, F.lit("2024-03-01 00:00:00").cast("timestamp")
    )


@query(
    """select entity_id, lpad(cast(s_suppkey as varchar), 10, '0') as cik, name from (
         select s_suppkey, case when s_suppkey % 10 = 9 then null else s_suppkey end as entity_id,
                case when s_suppkey % 4 = 0 then upper(s_name) else s_name end as name
         from supplier where s_suppkey % 10 <> 9 or s_suppkey % 4 <> 1)"""
)
def entity_merge(t: Tables) -> DataFrame:
    entity = views.entity(t)
    key = F.col("entity_id")
    seen = entity.where((key % 4 == 0) | ((key % 10 == 9) & (key % 4 != 1))).select(
        "cik", F.when(key % 4 == 0, F.upper("name")).otherwise(F.col("name")).alias("name")
    )
    merged = scd2.merge_entities(entity.where(key % 10 != 9), seen)
    # New entities get a hashed id; it is blanked as SQL has no such hash.
    return merged.withColumn("entity_id", F.when(F.col("cik").cast("bigint") % 10 != 9, key))


@query(
    with_parts(
        ["facts", "mapping"],
        f"""select f.entity_id, m.ticker, metric_code, accession_no, {ts('f.knowledge_from')} as knowledge_from,
                   cast(value as double) as value
            from facts f join mapping m using (entity_id)
            where m.knowledge_from <= timestamp '2024-01-10' and m.knowledge_to > timestamp '2024-01-10'""",
    )
)
def temporal_join(t: Tables) -> DataFrame:
    instant = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return asof.temporal_join(
        views.fundamental_facts(t), views.entity_ticker(t), instant
    ).select("entity_id", "ticker", "metric_code", "accession_no", "knowledge_from", "value")


@query(
    with_parts(
        ["prices", "cal"],
        f"""select {day('c.date')} as date, entity_id, {day('trade_date')} as price_date, close as price
            from prices p join cal c on p.trade_date between c.date and c.date + 10
            where p.knowledge_to = {OPEN} and source = 'tiingo'
            qualify row_number() over (partition by c.date, entity_id order by trade_date) = 1""",
    )
)
def forward_asof_price(t: Tables) -> DataFrame:
    current = asof.current_versions(views.price_facts(t)).where(F.col("source") == "tiingo")
    return asof.nearest_on_or_after(current, views.rebalance_dates(t), by=["entity_id"], value="close")


_INSTANTS = """
  select l.event_id, l.user_id, r.event_id as matched_event_id, round(r.value, 6) as matched_value,
         strftime(r.ts, '%Y-%m-%d %H:%M:%S') as matched_ts
  from events l left join lateral (
    select * from events r where {match} order by {order} limit 1) r on true
  where l.event_type = '{left}'"""


def _instants(t: Tables, left: str, right: str, by: Column, **options) -> DataFrame:
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value", by.alias("key"))
    found = asof.nearest_instant(
        events.where(F.col("event_type") == left), events.where(F.col("event_type") == right),
        by=["key"], left_time="ts", right_time="ts", payload=["event_id", "value"], **options,
    )
    return found.select("event_id", "user_id", "matched_event_id", "matched_value", "matched_ts")


@query(
    _INSTANTS.format(
        left="error", order="r.ts, r.event_id desc",
        match="""r.event_type = 'purchase' and r.user_id = l.user_id and r.ts >= l.ts
                 and r.ts <= l.ts + interval 36 hours""",
    )
)
def asof_next_instant(t: Tables) -> DataFrame:
    """After each error of a user, their next purchase within 36 hours."""
    return _instants(t, "error", "purchase", F.col("user_id"), tolerance_s=36 * 3600)


@query(
    _INSTANTS.format(
        left="purchase", order="r.ts desc, r.event_id desc",
        match="r.event_type = 'view' and r.user_id % 3 = l.user_id % 3 and r.ts <= l.ts",
    )
)
def asof_last_instant_hot(t: Tables) -> DataFrame:
    """Before each purchase, the last view in its third of the users, with keys scanned in chunks."""
    return _instants(t, "purchase", "view", F.col("user_id") % 3, direction="backward", hot_key_rows=100)


@query(
    with_parts(
        ["cal"],
        f"""select {day('c.date')} as date, o_custkey, {day('od')} as order_day,
                   arg_max(o_totalprice, o_orderkey) as o_totalprice, max(o_orderkey) as o_orderkey
            from (select o.*, cast(o_orderdate as date) as od from orders o) o
            join cal c on od <= c.date
            where od = (select max(cast(p.o_orderdate as date)) from orders p
                        where p.o_custkey = o.o_custkey and p.o_orderdate <= c.date)
            group by all""",
    )
)
def backward_asof_latest(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("order_day", F.col("o_orderdate").cast("date"))
    return asof.latest_on_or_before(
        orders,
        views.rebalance_dates(t),
        by=["o_custkey"],
        day="order_day",
        payload=["o_totalprice", "o_orderkey"],
        tie=[F.col("o_orderkey")],
    )


@query(
    with_parts(
        ["stg", "entity"],
        """select cik, metric_code, count(*) as n from stg
           where cik not in (select cik from entity) group by all""",
    )
)
def reject_anti_join(t: Tables) -> DataFrame:
    _, rejected = chain.with_entity(chain.loadable(views.stg_facts(t)), views.entity(t))
    return rejected.groupBy("cik", "metric_code").agg(F.count(F.lit(1)).alias("n"))


def _old_and_new(t: Tables) -> DataFrame:
    """A stored table that missed a tenth of the filings, against the full recomputation."""
    partial = views.stg_facts(t).where(F.col("payload_id") % 10 != 0)
    stored = chain.fundamental_facts(partial, views.entity(t), source="edgar", lag_days=1)
    return chain.version_diff(
        stored, views.fundamental_facts(t), keys=schemas.FACT_KEY, version="accession_no"
    )


_DIFF_PARTS = {
    **oracle.chain_parts("stg", "part", "event_id % 10 <> 0"),
    "vdiff": """
      select coalesce(n.entity_id, o.entity_id) as entity_id,
             coalesce(n.metric_code, o.metric_code) as metric_code,
             coalesce(n.period_start, o.period_start) as period_start,
             coalesce(n.period_end, o.period_end) as period_end,
             coalesce(n.accession_no, o.accession_no) as accession_no,
             case when o.entity_id is null then 'insert' when n.entity_id is null then 'orphan'
                  else 'relink' end as action,
             o.knowledge_to as old_knowledge_to, n.knowledge_to as new_knowledge_to,
             coalesce(o.knowledge_to <> n.knowledge_to, false) as moved
      from facts n full join part o
        on n.entity_id = o.entity_id and n.metric_code = o.metric_code
       and n.period_start is not distinct from o.period_start and n.period_end = o.period_end
       and n.accession_no = o.accession_no""",
}


@query(
    with_parts(
        ["facts"],
        f"""select entity_id, metric_code, {day('period_start')} as period_start,
                   {day('period_end')} as period_end, accession_no, action, cast(moved as bigint) as moved,
                   {ts('old_knowledge_to')} as old_knowledge_to, {ts('new_knowledge_to')} as new_knowledge_to
            from vdiff""",
        _DIFF_PARTS,
    )
)
def version_diff(t: Tables) -> DataFrame:
    return _old_and_new(t).drop("source")


@query(
    with_parts(
        ["facts"],
        """select count(*) filter (kept > 0) as keys_processed, cast(sum(ins) as bigint) as rows_inserted,
                  cast(sum(rel) as bigint) as rows_relinked, cast(sum(orp) as bigint) as rows_orphaned
           from (select count(*) filter (action = 'insert') as ins,
                        count(*) filter (action = 'relink') as rel,
                        count(*) filter (action = 'orphan') as orp,
                        count(*) filter (action <> 'orphan') as kept
                 from vdiff group by entity_id, metric_code, period_start, period_end)""",
        _DIFF_PARTS,
    )
)
def load_counters(t: Tables) -> DataFrame:
    return chain.load_summary(_old_and_new(t), schemas.FACT_KEY)


@query(
    with_parts(
        ["payload"],
        f"""select source, endpoint, ticker, payload_id, {ts('fetched_at')} as fetched_at, content_sha256
            from payload where http_status = 200
            qualify row_number() over (partition by source, endpoint, ticker
                                       order by fetched_at desc, payload_id desc) = 1""",
    )
)
def latest_payload(t: Tables) -> DataFrame:
    newest = payloads.latest(
        views.payload(t), ["source", "endpoint", payloads.ticker_of().alias("ticker")]
    )
    return newest.select(
        "source", "endpoint", payloads.ticker_of().alias("ticker"), "payload_id", "fetched_at",
        "content_sha256",
    )


@query(
    """select distinct source, lang as ticker from documents"""
)
def log_tickers(t: Tables) -> DataFrame:
    return payloads.tickers_in_log(views.payload(t))


@query(
    with_parts(
        ["payload"],
        f"""select source, ticker, {ts('fetched_at')} as fetched_at, payload_id, content_sha256,
                   cast(exists (select 1 from payload p where p.source = b.source
                                and p.content_sha256 = b.content_sha256
                                and (p.payload_id % 3 = 0 or
                                     (p.fetched_at, p.payload_id) < (b.fetched_at, b.payload_id)))
                        as bigint) as content_unchanged
            from payload b where payload_id % 3 <> 0""",
    )
)
def payload_hash_seen(t: Tables) -> DataFrame:
    log = views.payload(t)
    seen = payloads.mark_seen(
        log.where(F.col("payload_id") % 3 != 0), log.where(F.col("payload_id") % 3 == 0)
    )
    return seen.select(
        "source", payloads.ticker_of().alias("ticker"), "fetched_at", "payload_id",
        "content_sha256", "content_unchanged",
    )


_METRICS = ["revenue", "net_income", "total_assets", "total_equity"]


@query(
    with_parts(
        ["stg", "mapping"],
        f"""select p.cik, coalesce(m.ticker, '?') as ticker, fiscal_year, fiscal_period,
                   string_agg(x.metric, ',' order by x.metric) as missing_metrics
            from (select distinct cik, fiscal_year, fiscal_period from stg where fiscal_year is not null) p
            cross join (select unnest({_METRICS}) as metric) x
            left join (select lpad(cast(entity_id as varchar), 10, '0') as cik, ticker from mapping
                       where knowledge_to = {OPEN}) m using (cik)
            where not exists (select 1 from stg s where s.cik = p.cik and s.fiscal_year = p.fiscal_year
                                and s.fiscal_period = p.fiscal_period and s.metric_code = x.metric)
            group by all""",
    )
)
def coverage_gaps(t: Tables) -> DataFrame:
    tickers = asof.current_versions(views.entity_ticker(t)).join(views.entity(t), "entity_id")
    return coverage.coverage_gaps(views.stg_facts(t), tickers, _METRICS)


@query(
    with_parts(
        ["stg"],
        f"""select count(*) as total_entity_quarters, count(*) filter (n = {len(_METRICS)}) as fully_covered,
                   round(count(*) filter (n = {len(_METRICS)}) * 100.0 / count(*), 6)::double as coverage_pct
            from (select cik, fiscal_year, fiscal_period,
                         count(distinct metric_code) filter (list_contains({_METRICS}, metric_code)) as n
                  from stg where fiscal_year is not null group by all)""",
    )
)
def coverage_summary(t: Tables) -> DataFrame:
    return coverage.coverage_summary(views.stg_facts(t), _METRICS)


# ---- Integrity ----


def _order_windows(t: Tables) -> DataFrame:
    start = F.col("o_orderdate").cast("timestamp")
    days = (F.col("o_orderkey") % 200 - 2).cast("int")
    return t.orders.select(
        "o_custkey",
        "o_orderkey",
        start.alias("knowledge_from"),
        F.when(F.col("o_orderkey") % 9 == 0, schemas.open_end())
        .otherwise(start + F.make_dt_interval(days))
        .alias("knowledge_to"),
    )


_WINDOWS = {
    "win": f"""
      select o_custkey, o_orderkey, o_orderdate as knowledge_from,
             case when o_orderkey % 9 = 0 then {OPEN}
                  else o_orderdate + to_days(cast(o_orderkey % 200 - 2 as int)) end as knowledge_to
      from orders"""
}


@query(
    with_parts(
        [],
        f"""select o_custkey, o_orderkey, {ts('knowledge_from')} as knowledge_from,
                   {ts('knowledge_to')} as knowledge_to, {ts('held_until')} as held_until
            from (select *, max(knowledge_to) over (
                    partition by o_custkey order by knowledge_from, knowledge_to, o_orderkey
                    rows between unbounded preceding and 1 preceding) as held_until
                  from win where knowledge_from < knowledge_to)
            where held_until > knowledge_from""",
        _WINDOWS,
    )
)
def overlap_violations(t: Tables) -> DataFrame:
    return integrity.overlap_violations(
        _order_windows(t), ["o_custkey"], tie=["knowledge_to", "o_orderkey"]
    )


@query(
    with_parts(
        [],
        f"""select o_custkey, o_orderkey, {ts('knowledge_from')} as knowledge_from,
                   {ts('knowledge_to')} as knowledge_to, {ts('held_until')} as held_until
            from (select *, max(knowledge_to) over (
                    partition by o_custkey order by knowledge_from, knowledge_to, o_orderkey
                    rows between unbounded preceding and 1 preceding) as held_until
                  from win where knowledge_from < knowledge_to)
            where held_until > knowledge_from""",
        _WINDOWS,
    )
)
def overlap_hot(t: Tables) -> DataFrame:
    return integrity.overlap_violations(
        _order_windows(t), ["o_custkey"], tie=["knowledge_to", "o_orderkey"], hot_key_rows=HOT_ROWS
    )


@query(
    with_parts(
        [],
        f"""select o_custkey, count(*) as open_rows from win where knowledge_to = {OPEN}
            group by all having count(*) > 1""",
        _WINDOWS,
    )
)
def open_row_violations(t: Tables) -> DataFrame:
    return integrity.open_row_violations(_order_windows(t), ["o_custkey"])


@query(
    with_parts(
        [],
        f"""select o_custkey, o_orderkey, {ts('knowledge_from')} as knowledge_from,
                   {ts('knowledge_to')} as knowledge_to from win where knowledge_from >= knowledge_to""",
        _WINDOWS,
    )
)
def window_violations(t: Tables) -> DataFrame:
    return integrity.window_violations(_order_windows(t))


@query(
    """select event_id, user_id from events where user_id not in (select s_suppkey from supplier)"""
)
def fk_violations(t: Tables) -> DataFrame:
    return integrity.orphans(
        t.events.select("event_id", "user_id"), "user_id", t.supplier, "s_suppkey"
    )


@query(
    """select doc_id, payload_id from (
         select doc_id, case when doc_id % 11 = 0 then null else doc_id * 2 end as payload_id
         from documents) where payload_id is null or payload_id not in (select doc_id from documents)"""
)
def lineage_violations(t: Tables) -> DataFrame:
    facts = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") * 2).alias("payload_id")
    )
    return integrity.lineage_violations(facts, views.payload(t))


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus not in ('F', 'O')")
def domain_violations(t: Tables) -> DataFrame:
    return integrity.domain_violations(t.orders, "o_orderstatus", ["F", "O"]).select(
        "o_orderkey", "o_orderstatus"
    )


@query(
    """select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by all
       having count(*) > 1"""
)
def duplicate_keys(t: Tables) -> DataFrame:
    return integrity.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    with_parts(
        ["facts"],
        f"""select accession_no, metric_code, {day('period_end')} as period_end,
                   {day('basis')} as basis, {ts('knowledge_from')} as knowledge_from
            from (select *, filed_date + cast(payload_id % 4 as int) as basis from facts)
            where knowledge_from < cast(basis as timestamp)""",
    )
)
def early_knowledge_violations(t: Tables) -> DataFrame:
    facts = views.fundamental_facts(t).withColumn(
        "basis", F.date_add("filed_date", (F.col("payload_id") % 4).cast("int"))
    )
    return integrity.early_knowledge_violations(facts, "basis").select(
        "accession_no", "metric_code", "period_end", "basis", "knowledge_from"
    )


@query(
    """select doc_id as payload_id, 'row changed or removed' as reason from documents
       where doc_id % 50 in (0, 1)
       union all
       select doc_id, 'body does not match its hash' from documents where doc_id % 50 = 2"""
)
def log_mutations(t: Tables) -> DataFrame:
    """A log from which rows were removed, replaced, or altered under their old hash."""
    before = views.payload(t)
    kind = F.col("payload_id") % 50
    altered = F.concat(F.col("body"), F.lit("!").cast("binary"))
    after = (
        before.where(kind != 0)
        .withColumn("body", F.when(kind.isin(1, 2), altered).otherwise(F.col("body")))
        .withColumn(
            "content_sha256",
            F.when(kind == 1, F.sha2("body", 256)).otherwise(F.col("content_sha256")),
        )
    )
    return integrity.log_mutations(before, after)


def _seeded(t: Tables) -> DataFrame:
    """The fact table with every kind of fault put into some of its rows."""
    facts = views.fundamental_facts(t).withColumn("n", F.col("payload_id"))
    n = F.col("n")
    broken = facts.withColumns(
        {
            "knowledge_from": F.when(n % 89 == 1, F.col("filed_date").cast("timestamp") - F.expr("INTERVAL 1 DAY"))
            .otherwise(F.col("knowledge_from")),
            "knowledge_to": F.when(n % 97 == 0, F.col("knowledge_from")).otherwise(F.col("knowledge_to")),
            "entity_id": F.when(n % 79 == 3, F.col("entity_id") + 1_000_000).otherwise(F.col("entity_id")),
            "payload_id": F.when(n % 83 == 2, -n - 1).otherwise(n),
            "supersedes": F.when((n % 71 == 5) & F.col("supersedes").isNotNull(), F.lit(-1))
            .otherwise(F.col("supersedes")),
        }
    )
    twice = F.explode(F.when(n % 73 == 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return cut_lineage(broken.withColumn("copy", twice).drop("copy", "n"))


_SEEDED = {
    "seeded": f"""
      select * replace (
        case when n % 89 = 1 then cast(filed_date as timestamp) - interval 1 day else knowledge_from end as knowledge_from,
        case when n % 97 = 0 then knowledge_from else knowledge_to end as knowledge_to,
        case when n % 79 = 3 then entity_id + 1000000 else entity_id end as entity_id,
        case when n % 83 = 2 then -n - 1 else n end as payload_id)
      from (select *, payload_id as n from facts)
      cross join lateral (select unnest(case when n % 73 = 4 then [1, 2] else [1] end) as copy)""",
    "fact_key": "select *, (entity_id, metric_code, period_start, period_end) as k from seeded",
}


@query(
    with_parts(
        ["facts", "entity"],
        f"""select 'no_overlap' as invariant, (
              select count(*) from (
                select knowledge_from, max(knowledge_to) over (
                  partition by k order by knowledge_from, knowledge_to
                  rows between unbounded preceding and 1 preceding) as held_until
                from fact_key where knowledge_from < knowledge_to)
              where held_until > knowledge_from) as violations
            union all select 'one_open_row', (select count(*) from (
              select k from fact_key where knowledge_to = {OPEN} group by k having count(*) > 1))
            union all select 'not_known_early',
              (select count(*) from seeded where knowledge_from < cast(filed_date as timestamp))
            union all select 'window_order', (select count(*) from seeded where knowledge_from >= knowledge_to)
            union all select 'payload_lineage', (select count(*) from seeded where payload_id < 0)
            union all select 'known_entity', (select count(*) from seeded where entity_id >= 1000000)
            union all select 'supersedes_exists',
              (select count(*) from seeded where n % 71 = 5 and prior_accession is not null)
            union all select 'unique_version', (select count(*) from (
              select k from fact_key group by k, knowledge_from having count(*) > 1))
            union all select 'unique_id', (select count(*) from facts where payload_id % 73 = 4)""",
        _SEEDED,
    )
)
def fundamental_invariants(t: Tables) -> DataFrame:
    """What a load would be refused for, on facts into which every kind of fault was put."""
    events = t.events.select(F.col("event_id").alias("payload_id"))
    return integrity.fundamental_invariants(_seeded(t), events, views.entity(t))


@query(
    with_parts(
        ["prices"],
        f"""select 'no_overlap' as invariant, (
              select count(*) from (
                select knowledge_from, max(knowledge_to) over (
                  partition by entity_id, source, trade_date order by knowledge_from, knowledge_to
                  rows between unbounded preceding and 1 preceding) as held_until
                from prices where knowledge_from < knowledge_to)
              where held_until > knowledge_from) as violations
            union all select 'one_open_row', (select count(*) from (
              select 1 from prices where knowledge_to = {OPEN}
              group by entity_id, source, trade_date having count(*) > 1))
            union all select 'not_known_early',
              (select count(*) from prices where knowledge_from < cast(trade_date as timestamp))
            union all select 'window_order', (select count(*) from prices where knowledge_from >= knowledge_to)
            union all select 'unique_version', (select count(*) from (
              select 1 from prices group by entity_id, source, trade_date, knowledge_from having count(*) > 1))
            union all select 'unique_id', (select count(*) from (
              select 1 from prices group by entity_id, source, trade_date, knowledge_from having count(*) > 1))
            union all select 'payload_lineage',
              (select count(*) from prices where payload_id not in (select o_orderkey from orders))
            union all select 'known_entity',
              (select count(*) from prices where entity_id not in (select s_suppkey from supplier))""",
    )
)
def price_invariants(t: Tables) -> DataFrame:
    """Two fetches at one instant leave an empty window: those rows are the reported ones."""
    orders = t.orders.select(F.col("o_orderkey").alias("payload_id"))
    facts = cut_lineage(views.price_facts(t))
    return integrity.price_invariants(facts, orders, views.entity(t))
