"""DuckDB SQL for the registered queries, built from shared WITH parts."""

from __future__ import annotations

OPEN = "timestamp '9999-12-31 23:59:59.999999'"
NOW = "timestamp '2024-06-01 00:00:00'"


def ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def knowledge(base: str, lag: str = "1") -> str:
    moved = f"({base} + cast({lag} as int))"
    return (
        f"(cast({moved} + case isodow({moved}) when 6 then 2 when 7 then 1 else 0 end as timestamp)"
        " + interval 810 minute)"
    )


PARTS: dict[str, str] = {}

PARTS["stg"] = """
  select cik, metric_code,
         case when metric_code in ('total_assets','total_equity') then null
              when event_id % 5 = 0 then period_end - 270 else period_end - 90 end as period_start,
         period_end,
         case when event_id % 50 <> 0 then year(period_end) end as fiscal_year,
         case when event_id % 50 <> 0 then 'Q' || quarter(period_end) end as fiscal_period,
         cast(floor(value / 25) as bigint) as value, 'USD' as unit,
         'tag' || (event_id % 3) as vendor_native_tag,
         cik || '-' || lpad(cast(cast(floor(dayofyear(filed_date) / 2) as int) as varchar), 3, '0')
           as accession_no,
         filed_date, event_id as payload_id, event_id
  from (select lpad(cast(user_id as varchar), 10, '0') as cik,
               case event_type when 'purchase' then 'revenue' when 'view' then 'net_income'
                    when 'error' then 'shares_outstanding_diluted'
                    when 'click' then 'total_assets' when 'signup' then 'total_equity' end as metric_code,
               cast(date '2022-01-01'
                    + to_months(cast(3 * ((event_id % 3) * (1 + user_id % 3) + 1) as int)) as date) - 1
                 as period_end,
               cast(ts as date) as filed_date, value, event_id, user_id
        from events)
"""

PARTS["entity"] = """
  select s_suppkey as entity_id, lpad(cast(s_suppkey as varchar), 10, '0') as cik, s_name as name
  from supplier
"""

PARTS["mapping"] = f"""
  select s_suppkey as entity_id, 'T' || s_suppkey as ticker,
         case s_suppkey % 5 when 2 then timestamp '1998-06-15' when 3 then timestamp '2024-01-15'
              else timestamp '1990-01-01' end as knowledge_from, {OPEN} as knowledge_to
  from supplier
  union all
  select s_suppkey, 'T' || s_suppkey || '_OLD',
         case s_suppkey % 5 when 2 then timestamp '1990-01-01' else timestamp '2000-01-01' end,
         case s_suppkey % 5 when 2 then timestamp '1998-06-15' else timestamp '2024-01-15' end
  from supplier where s_suppkey % 5 in (2, 3)
"""


def chain_parts(source: str, name: str, where: str = "true") -> dict[str, str]:
    """WITH parts that turn staged rows of `source` into the versioned facts `name`."""
    key = "entity_id, metric_code, period_start, period_end"
    w = f"partition by {key} order by filed_date, accession_no"
    return {
        f"{name}_known": f"""
  select e.entity_id, s.* from {source} s join entity e using (cik) where {where}""",
        f"{name}_first": f"""
  select * from {name}_known
  qualify row_number() over (partition by {key}, accession_no
                             order by filed_date, payload_id, value) = 1""",
        f"{name}_cmp": f"""
  select *, lag(value) over ({w}) as pv, lag(unit) over ({w}) as pu,
         row_number() over ({w}) as rn from {name}_first""",
        f"{name}_links": f"""
  select *, {knowledge('filed_date')} as c, row_number() over ({w}) as i
  from {name}_cmp where rn = 1 or pv is distinct from value or pu is distinct from unit""",
        f"{name}_open": f"""
  select *, to_timestamp(max(epoch(c)::bigint - i) over ({w}) + i) at time zone 'UTC'
           as knowledge_from from {name}_links""",
        name: f"""
  select *, coalesce(lead(knowledge_from) over ({w}), {OPEN}) as knowledge_to,
         lag(accession_no) over ({w}) as prior_accession from {name}_open""",
    }


PARTS |= chain_parts("stg", "facts")

PARTS["quarterly"] = """
  select l_suppkey as entity_id, cast(date_trunc('quarter', l_shipdate) as date) as period_start,
         cast(date_trunc('quarter', l_shipdate) + interval 3 month as date) - 1 as period_end,
         sum(case when l_returnflag <> 'R' then cast(l_extendedprice as decimal(18,2)) else 0 end)
           as original,
         sum(cast(l_extendedprice as decimal(18,2))) as restated, count(*) + 1000 as shares
  from lineitem group by all
"""
PARTS["qstg"] = """
  select lpad(cast(entity_id as varchar), 10, '0') as cik, metric_code, period_start, period_end,
         value, unit, entity_id || '-' || strftime(period_end, '%Y-%m-%d') || '-' || ver
           as accession_no,
         period_end + delay as filed_date, entity_id as payload_id
  from (select entity_id, period_start, period_end, 'net_income' as metric_code, '1' as ver,
               original as value, 'USD' as unit, 30 as delay from quarterly
        union all
        select entity_id, period_start, period_end, 'net_income', '2', restated, 'USD', 200
        from quarterly
        union all
        select entity_id, period_start, period_end, 'shares_outstanding_diluted', '1', shares,
               'shares', 30 from quarterly)
"""
PARTS |= chain_parts("qstg", "qfacts")

PARTS["payload"] = """
  select doc_id as payload_id, source, 'history' as endpoint, lang as ticker,
         timestamp '2024-01-01' + to_hours(cast(doc_id % 4000 as int)) as fetched_at,
         case when doc_id % 17 = 0 then 404 else 200 end as http_status,
         sha256(text) as content_sha256
  from documents
"""

PARTS["obs"] = """
  select l_suppkey as entity_id,
         case l_linestatus when 'F' then 'yfinance' else 'tiingo' end as source,
         cast(date_trunc('week', l_shipdate) as date) as trade_date,
         floor(l_extendedprice / 10000) + 1 as close,
         (floor(l_extendedprice / 10000) + 1)
           * case when l_discount > 0.05 then cast(0.9 as double) else 1 end as adj_close,
         cast(l_quantity as bigint) as volume,
         cast(cast(l_shipdate as date) + cast(3 + l_orderkey % 30 as int) as timestamp) as fetched_at,
         l_orderkey as payload_id, l_linenumber as row_pos, l_partkey, l_extendedprice, l_discount
  from lineitem
"""
_PW = (
    "partition by entity_id, source, trade_date order by fetched_at, payload_id, row_pos, "
    "l_partkey, l_extendedprice, l_discount, volume"
)
PARTS["price_cmp"] = f"""
  select *, lag(close) over ({_PW}) as pc, lag(adj_close) over ({_PW}) as pa,
         row_number() over ({_PW}) as rn from obs"""
PARTS["price_open"] = f"""
  select *, case when rn = 1 then {knowledge('trade_date')} else fetched_at end as knowledge_from
  from price_cmp where rn = 1 or pc <> close or pa <> adj_close"""
PARTS["prices"] = f"""
  select *, coalesce(lead(knowledge_from) over ({_PW}), {OPEN}) as knowledge_to from price_open"""

# ---- The factor experiment ----
PARTS["cal"] = """
  select date from (
    select cast(unnest(generate_series(date_trunc('quarter', lo), cast(hi as timestamp),
                                       interval 3 month)) as date) as date, lo
    from (select cast(min(l_shipdate) as date) as lo, cast(max(l_shipdate) as date) as hi from lineitem))
  where date >= lo
"""
PARTS["modes"] = f"""
  select 'point_in_time' as mode, date, cast(date as timestamp) as fundamentals_as_of from cal
  union all select 'latest', date, {NOW} from cal
"""
PARTS["ttm_rows"] = """
  select m.mode, m.date, f.entity_id, f.period_start, f.period_end, f.accession_no, f.value,
         row_number() over (partition by m.mode, m.date, f.entity_id
                            order by f.period_end desc, f.period_start desc) as recency
  from qfacts f join modes m
    on f.knowledge_from <= m.fundamentals_as_of and f.knowledge_to > m.fundamentals_as_of
   and f.period_end <= m.date
  where f.metric_code = 'net_income' and f.period_end - f.period_start between 80 and 100
"""
PARTS["ttm"] = """
  select mode, date, entity_id, cast(sum(value) as double) as ttm_value,
         max(period_end) - min(period_start) as span_days,
         string_agg(accession_no, ',' order by period_end) as accessions
  from ttm_rows where recency <= 4 group by all having count(*) = 4
"""
PARTS["shares"] = """
  select m.mode, m.date, f.entity_id, arg_max(cast(f.value as double), f.period_end) as shares,
         max(f.period_end) as period_end
  from qfacts f join modes m
    on f.knowledge_from <= m.fundamentals_as_of and f.knowledge_to > m.fundamentals_as_of
   and f.period_end <= m.date
  where f.metric_code = 'shares_outstanding_diluted' group by 1, 2, 3
"""
PARTS["tickers"] = """
  select m.mode, m.date, t.entity_id, t.ticker, s.s_suppkey as ordinal
  from mapping t join modes m
    on t.knowledge_from <= m.fundamentals_as_of and t.knowledge_to > m.fundamentals_as_of
  join supplier s on t.ticker = 'T' || s.s_suppkey
"""
PARTS["priced"] = f"""
  select t.ticker, p.* from prices p join mapping t using (entity_id)
  where p.knowledge_from <= {NOW} and p.knowledge_to > {NOW}
    and t.knowledge_from <= {NOW} and t.knowledge_to > {NOW}
"""
PARTS["near"] = """
  select c.date, p.ticker, p.source, p.trade_date as price_date, p.close, p.adj_close
  from priced p join cal c on p.trade_date between c.date and c.date + 10
  qualify row_number() over (partition by c.date, p.ticker, p.source order by p.trade_date) = 1
"""
PARTS["panel"] = """
  select mode, date, ticker, ordinal, entity_id, ttm_value as ttm_net_income, shares, price_date,
         close as price, shares * close as market_cap, ttm_value / (shares * close) as earnings_yield
  from ttm join shares using (mode, date, entity_id) join tickers using (mode, date, entity_id)
  join near using (date, ticker)
  where near.source = 'tiingo' and shares > 0 and shares * close > 0
"""
PARTS["ranked"] = """
  select *, row_number() over (partition by mode, date order by earnings_yield desc, ordinal) as rn,
         count(*) over (partition by mode, date) as n from panel
"""
PARTS["positions"] = """
  select mode, date, ticker, 'long' as side, rn as rank from ranked where n >= 20 and rn <= 10
  union all
  select mode, date, ticker, 'short', n - rn + 1 from ranked where n >= 20 and rn > n - 10
"""
PARTS["formed"] = """
  select mode, date, lead(date) over (partition by mode order by date) as next_date
  from (select distinct mode, date from positions)
"""
PARTS["pos_ret"] = """
  select p.mode, p.date, f.next_date, p.ticker, p.side, b.adj_close / a.adj_close - 1 as forward_return
  from positions p join formed f using (mode, date)
  join near a on a.date = p.date and a.ticker = p.ticker and a.source = 'yfinance'
  join near b on b.date = f.next_date and b.ticker = p.ticker and b.source = 'yfinance'
  where a.adj_close <> 0
"""
PARTS["periods"] = """
  select *, long_return - short_return as portfolio_return
  from (select mode, date, next_date, avg(forward_return) filter (side = 'long') as long_return,
               avg(forward_return) filter (side = 'short') as short_return
        from pos_ret group by all)
  where long_return is not null and short_return is not null
"""
PARTS["turn"] = """
  select f.mode, f.date, f.next_date,
         (select count(*) from positions p where p.mode = f.mode and p.date = f.date
            and not exists (select 1 from positions q where q.mode = p.mode and q.date = f.next_date
                              and q.ticker = p.ticker and q.side = p.side))
         / cast((select count(*) from positions p where p.mode = f.mode and p.date = f.next_date)
                as double) as turnover
  from formed f where f.next_date is not null
"""
PARTS["diffs"] = """
  select coalesce(a.date, b.date) as date, coalesce(a.ticker, b.ticker) as ticker,
         a.side as point_in_time_side, b.side as latest_side
  from (select date, ticker, max(side) as side from positions
        where mode = 'point_in_time' group by all) a
  full join (select date, ticker, max(side) as side from positions
             where mode = 'latest' group by all) b on a.date = b.date and a.ticker = b.ticker
  where a.side is distinct from b.side
    and coalesce(a.date, b.date) in (select date from positions where mode = 'point_in_time')
    and coalesce(a.date, b.date) in (select date from positions where mode = 'latest')
"""

# What each part reads; the rest reads given tables only.
_NEEDS = {
    "facts": ["stg", "entity", "facts_known", "facts_first", "facts_cmp", "facts_links", "facts_open"],
    "qfacts": [
        "quarterly", "qstg", "entity", "qfacts_known", "qfacts_first", "qfacts_cmp",
        "qfacts_links", "qfacts_open",
    ],
    "prices": ["obs", "price_cmp", "price_open"],
    "modes": ["cal"],
    "ttm_rows": ["qfacts", "modes"],
    "ttm": ["ttm_rows"],
    "shares": ["qfacts", "modes"],
    "tickers": ["mapping", "modes"],
    "priced": ["prices", "mapping"],
    "near": ["priced", "cal"],
    "panel": ["ttm", "shares", "tickers", "near"],
    "ranked": ["panel"],
    "positions": ["ranked"],
    "formed": ["positions"],
    "pos_ret": ["positions", "formed", "near"],
    "periods": ["pos_ret"],
    "turn": ["positions", "formed"],
    "diffs": ["positions"],
}


def with_parts(names: list[str], select: str, extra: dict[str, str] | None = None) -> str:
    """`select` preceded by the named parts and everything they read, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [(name, PARTS[name]) for name in ordered] + list((extra or {}).items())
    return "with " + ",\n".join(f"{name} as materialized ({sql})" for name, sql in parts) + "\n" + select
