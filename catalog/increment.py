"""Loads and streams that touch only some keys, checked against one load of everything."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import views
from catalog.core import _FACT_COLUMNS, _FACT_SQL
from catalog.oracle import OPEN, chain_parts, with_parts
from catalog.registry import query
from catalog.views import Tables
from hindcast.plans import increment, load
from hindcast.session import ensure_checkpoint_dir
from hindcast.sources.lake import Lake
from hindcast.streaming.fundamentals import start_fundamental_refresh

_BUCKETS = 16


def _lake(t: Tables) -> Lake:
    lake = Lake(t.spark, f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/lake-{uuid.uuid4().hex}")
    lake.replace(load.ENTITY, views.entity(t))
    return lake


def _batches(t: Tables) -> list[DataFrame]:
    """First the history, then one company in a hundred, then filings that come late, with repeats."""
    stg = views.stg_facts(t)
    late = F.col("payload_id") % 50
    return [
        stg.where((F.col("cik").cast("bigint") % 100 != 3) & (late != 7)),
        stg.where((F.col("cik").cast("bigint") % 100 == 3) & (late != 7)),
        stg.where(late.isin(7, 8)),
    ]


def _loaded(t: Tables) -> tuple[Lake, list[load.LoadSummary]]:
    lake = _lake(t)
    # These facts come from events, so there is no payload log to trace them to.
    return lake, [
        increment.load_observations(lake, batch, 1, buckets=_BUCKETS, lineage_checked=False)
        for batch in _batches(t)
    ]


@query(with_parts(["facts"], f"select {_FACT_SQL} from facts"))
def load_increment(t: Tables) -> DataFrame:
    lake, _ = _loaded(t)
    return increment.read_facts(lake, buckets=_BUCKETS).select(*_FACT_COLUMNS)


_KEY = "entity_id, metric_code, period_start, period_end"
_STEPS = {
    **chain_parts("stg", "c1", "cast(cik as bigint) % 100 <> 3 and event_id % 50 <> 7"),
    **chain_parts("stg", "c2", "event_id % 50 <> 7"),
}


@query(
    with_parts(
        ["facts"],
        f"""select 1 as step, (select count(*) from (select distinct {_KEY} from c1)) as keys_processed,
                   count(*) as rows_inserted, 0 as rows_relinked, 0 as rows_orphaned from c1
            union all
            select 2, (select count(*) from (select distinct {_KEY} from c2 where cast(cik as bigint) % 100 = 3)),
                   count(*), 0, 0 from c2 where cast(cik as bigint) % 100 = 3
            union all
            select 3, (select count(*) from touched), count(*) filter (o is null), count(*) filter (o = n),
                   count(*) filter (n is null)
            from (select a.entity_id as n, b.entity_id as o
                  from (select * from facts join touched using (entity_id, metric_code, period_end)
                        where facts.period_start is not distinct from touched.period_start) a
                  full join (select * from c2 join touched using (entity_id, metric_code, period_end)
                             where c2.period_start is not distinct from touched.period_start) b
                  on a.entity_id = b.entity_id and a.metric_code = b.metric_code and a.period_end = b.period_end
                     and a.period_start is not distinct from b.period_start and a.accession_no = b.accession_no)""",
        {**_STEPS, "touched": f"select distinct {_KEY} from facts_known where event_id % 50 in (7, 8)"},
    )
)
def increment_counters(t: Tables) -> DataFrame:
    _, summaries = _loaded(t)
    rows = [
        (i, s.keys_processed, s.rows_inserted, s.rows_relinked, s.rows_orphaned)
        for i, s in enumerate(summaries, 1)
    ]
    return t.spark.createDataFrame(
        rows, "step bigint, keys_processed bigint, rows_inserted bigint, rows_relinked bigint, rows_orphaned bigint"
    )


@query(with_parts(["facts"], f"select {_FACT_SQL} from facts where knowledge_to = {OPEN}"))
def stored_current(t: Tables) -> DataFrame:
    """Current versions out of the stored table; only files of open rows are opened."""
    lake, _ = _loaded(t)
    return increment.read_facts(lake, current=True, buckets=_BUCKETS).select(*_FACT_COLUMNS)


@query(with_parts(["facts"], f"select {_FACT_SQL} from facts"))
def stream_fact_chain(t: Tables) -> DataFrame:
    """The same batches as a stream, the first of which arrives a second time."""
    lake = _lake(t)
    folder = f"{lake.root}/arriving"
    batches = _batches(t)
    for batch in [*batches, batches[0]]:
        batch.write.mode("append").parquet(folder)
        start_fundamental_refresh(
            lake, folder, lag_days=1, buckets=_BUCKETS, lineage_checked=False
        ).awaitTermination()
    return increment.read_facts(lake, buckets=_BUCKETS).select(*_FACT_COLUMNS)
