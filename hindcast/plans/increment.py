"""Loads of fundamental facts that touch only the keys of new observations.

Observations are kept in a staging log, dealt to the buckets of the fact table. A load appends the new
ones, finds the keys they name and recomputes those chains from all their observations, so a filing
that arrives late is spliced in. The other chains of the same buckets are carried over as they are, and
other buckets aren't read. The result is that of one load of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schemas
from hindcast.operators import chain, integrity
from hindcast.operators.frames import broadcast_if_small, null_safe_join
from hindcast.plans.lineage import tracked_run
from hindcast.plans.load import ENTITY, FUNDAMENTAL_SOURCE, LoadSummary, read_payloads
from hindcast.session import cut_lineage
from hindcast.sources.buckets import BucketTable, bucket_of
from hindcast.sources.lake import Lake

FACTS = "core.fundamental_bucket"
OBSERVED = "stg.fundamental_log"
BUCKETS = 256
LAYOUT = ["metric_code", "entity_id", "period_end", "knowledge_from"]

_CHAIN_KEY = [name for name in schemas.FACT_KEY if name != "source"]
_OBSERVED_SCHEMA = T.StructType(
    [*schemas.STG_FACT.fields, T.StructField("entity_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
)


def fact_table(lake: Lake, buckets: int = BUCKETS) -> BucketTable:
    return BucketTable(lake, FACTS, schemas.FUNDAMENTAL_FACT, schemas.FACT_KEY, "entity_id", buckets)


def _invariants(lake: Lake, facts: DataFrame, lineage_checked: bool) -> dict[str, int]:
    """Broken invariants of whole buckets. Lineage needs the payload log; feeds without one skip it."""
    entity = lake.read(ENTITY, schemas.ENTITY)
    log = read_payloads(lake) if lineage_checked else facts.select("payload_id")
    report = integrity.fundamental_invariants(facts, log, entity)
    return {row.invariant: row.violations for row in report.where("violations > 0").collect()}


def load_observations(
    lake: Lake,
    observed: DataFrame,
    lag_days: int,
    *,
    buckets: int = BUCKETS,
    batch: int | None = None,
    lineage_checked: bool = True,
    hot_key_rows: int | None = chain.HOT_KEY_ROWS,
) -> LoadSummary:
    """Add staged rows of known entities and bring the chains of their keys up to date.

    `batch` numbers the loads of a stream: one that was published already does nothing, so a stream may
    repeat its last batch. A load that dies before it publishes leaves observations behind that the
    repetition stages again; exact repeats of an observation are no new version.

    The summary counts the touched keys only. Buckets whose content didn't change are not compared row
    by row.
    """
    table = fact_table(lake, buckets)
    if batch is not None and (last := table.last_batch()) is not None and batch <= last:
        return LoadSummary(0, 0, 0, 0)
    with tracked_run(lake, "load-observations") as run:
        entity = lake.read(ENTITY, schemas.ENTITY)
        staged = cut_lineage(observed.select(*schemas.STG_FACT.fieldNames()))
        run.rows_in = staged.count()
        known, _ = chain.with_entity(chain.loadable(staged), entity)
        names = _OBSERVED_SCHEMA.fieldNames()
        known = cut_lineage(known.withColumn("bucket", bucket_of(F.col("entity_id"), buckets)).select(*names))
        # At most `buckets` numbers.
        touched = sorted(row.bucket for row in known.select("bucket").distinct().collect())
        if not touched:
            return LoadSummary(0, 0, 0, 0)
        lake.append(OBSERVED, known.hint("rebalance", "bucket"), ("bucket",))

        keys = cut_lineage(known.select(*_CHAIN_KEY).distinct())
        # The hint is for a counted, small set of keys; a larger one is joined by shuffle.
        keys = broadcast_if_small(keys, keys.count())
        history = lake.read_log(OBSERVED, _OBSERVED_SCHEMA).where(F.col("bucket").isin(touched))
        history = null_safe_join(history, keys, _CHAIN_KEY, "left_semi")
        fresh = chain.fundamental_facts(
            history.select(*schemas.STG_FACT.fieldNames()), entity,
            source=FUNDAMENTAL_SOURCE, lag_days=lag_days, hot_key_rows=hot_key_rows,
        )
        before = table.read(touched)
        rest = null_safe_join(before, keys, _CHAIN_KEY, "left_anti")
        folder = table.stage(run.counting(rest.unionByName(fresh)), LAYOUT)
        after = table.staged(folder)
        if broken := _invariants(lake, after, lineage_checked):
            lake.discard(folder)
            raise ValueError(f"{FACTS} refused, rows that break an invariant: {broken}")
        changed = table.publish(folder, touched, batch)
        return _summary(before, after, keys, [b for b, _, _ in changed], buckets)


def _summary(before: DataFrame, after: DataFrame, keys: DataFrame, changed: list[int], buckets: int) -> LoadSummary:
    """What became of the touched keys. Only buckets with another digest are joined row by row."""
    differs = bucket_of(F.col("entity_id"), buckets).isin(changed) if changed else F.lit(False)
    now = null_safe_join(after, keys, _CHAIN_KEY, "left_semi")
    same = now.where(~differs).groupBy(*schemas.FACT_KEY).agg(F.count(F.lit(1)).alias("n"))
    n_keys, n_rows = same.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not changed:
        return LoadSummary(n_keys, 0, n_rows, 0)
    old = null_safe_join(before.where(differs), keys, _CHAIN_KEY, "left_semi")
    diff = chain.version_diff(old, now.where(differs), keys=schemas.FACT_KEY, version="accession_no")
    counted = chain.load_summary(diff, schemas.FACT_KEY).first()
    return LoadSummary(
        n_keys + counted.keys_processed, counted.rows_inserted, n_rows + counted.rows_relinked, counted.rows_orphaned
    )


def rebuild(
    lake: Lake, lag_days: int, *, buckets: int = BUCKETS, lineage_checked: bool = True,
    hot_key_rows: int | None = chain.HOT_KEY_ROWS,
) -> LoadSummary:
    """Recompute every chain from the staging log, as after a change of entities or of `lag_days`.

    Buckets that come out as they were are told by their digests; only the others are compared.
    """
    table = fact_table(lake, buckets)
    with tracked_run(lake, "rebuild-fundamentals") as run:
        log = lake.read_log(OBSERVED, _OBSERVED_SCHEMA)
        run.rows_in = log.count()
        facts = chain.fundamental_facts(
            log.select(*schemas.STG_FACT.fieldNames()), lake.read(ENTITY, schemas.ENTITY),
            source=FUNDAMENTAL_SOURCE, lag_days=lag_days, hot_key_rows=hot_key_rows,
        )
        old = {r.bucket: r for r in table.content()}
        folder = table.stage(run.counting(facts), LAYOUT)
        if broken := _invariants(lake, table.staged(folder), lineage_checked):
            lake.discard(folder)
            raise ValueError(f"{FACTS} refused, rows that break an invariant: {broken}")
        changed = table.publish(folder, None)
        new = {r.bucket: r for r in table.content()}
        different = [b for b, _, _ in changed]
        same = [new[b] for b in new if b not in different]
        n_keys, n_rows = sum(r.keys for r in same), sum(r.rows for r in same)
        if not changed:
            return LoadSummary(n_keys, 0, n_rows, 0)
        before = table.at([old[b].folder for b in different if b in old])
        after = table.at([new[b].folder for b in different if b in new])
        diff = chain.version_diff(before, after, keys=schemas.FACT_KEY, version="accession_no")
        counted = chain.load_summary(diff, schemas.FACT_KEY).first()
        return LoadSummary(
            n_keys + counted.keys_processed, counted.rows_inserted, n_rows + counted.rows_relinked, counted.rows_orphaned
        )


def read_facts(lake: Lake, *, current: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """All versions, or those still believed, for which files of ended versions aren't opened."""
    return fact_table(lake, buckets).read(current=current)
