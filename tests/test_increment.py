"""Loads that touch some keys: what they leave alone, what they read, what a repetition does."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_load import METRICS, TICKERS, facts_body, fetched

from hindcast import schemas
from hindcast.operators import chain
from hindcast.plans import increment, lineage, load
from hindcast.sources.lake import Lake
from hindcast.streaming.fundamentals import start_fundamental_refresh

COMPANIES, BUCKETS = 40, 8


def observed(spark, seed, companies, n):
    random.seed(seed)
    out = []
    for _ in range(n):
        company = random.choice(companies)
        filed = dt.date(2023, 1, 1) + dt.timedelta(days=random.randrange(200))
        out.append((
            f"{company:010d}", "C", random.choice(["revenue", "net_income"]),
            random.choice([None, dt.date(2022, 10, 1)]), dt.date(2022, 12, 31), 2022, "Q4",
            random.randrange(3), "USD", "tag", "10-K", f"{company}-{filed}", filed, 1,
        ))
    frame = spark.createDataFrame(
        [(*r[:7], float(r[7]), *r[8:]) for r in out],
        "cik string, entity_name string, metric_code string, period_start date, period_end date, fiscal_year int,"
        "fiscal_period string, value double, unit string, vendor_native_tag string, form_type string,"
        "accession_no string, filed_date date, payload_id bigint",
    )
    # A company reports a fact once in an accession, so that the chain doesn't depend on ties.
    return frame.withColumn("value", F.col("value").cast(schemas.VALUE_TYPE))


@pytest.fixture
def lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.replace(load.ENTITY, spark.createDataFrame(
        [(i, f"{i:010d}", "C") for i in range(1, COMPANIES + 1)], schemas.ENTITY))
    return lake


def add(lake, new, **options):
    return increment.load_observations(lake, new, 1, buckets=BUCKETS, lineage_checked=False, **options)


def whole(lake, *batches):
    total = batches[0]
    for batch in batches[1:]:
        total = total.unionByName(batch)
    return chain.fundamental_facts(total, lake.read(load.ENTITY, schemas.ENTITY), source="edgar", lag_days=1)


def files(lake):
    """Data files of the buckets that are current, by bucket."""
    table = increment.fact_table(lake, BUCKETS)
    return {
        r.bucket: sorted(p.name for p in Path(r.folder.removeprefix("file:")).rglob("*.parquet"))
        for r in table.content()
    }


def test_a_load_leaves_other_buckets_files_alone(spark, lake):
    first = observed(spark, 1, range(1, COMPANIES + 3), 900)
    second = observed(spark, 2, [5, 6], 30)
    add(lake, first)
    before = files(lake)
    summary = add(lake, second)
    after = files(lake)
    touched = {r[0] for r in spark.range(5, 7).select(increment.bucket_of(F.col("id"), BUCKETS)).collect()}
    assert 0 < len(touched) < len(before)
    assert {b for b in after if before.get(b) != after[b]} == touched
    facts = increment.read_facts(lake, buckets=BUCKETS)
    assert rows(facts) == rows(whole(lake, first, second))
    keys = second.select("cik", "metric_code", "period_start", "period_end").distinct().count()
    assert summary.keys_processed == keys and summary.rows_inserted > 0
    assert facts.where("entity_id > 40").count() == 0


def test_hot_keys_give_the_same_chains(spark, lake):
    batches = [observed(spark, 3, [1, 1, 1, 2], 300), observed(spark, 4, [1], 100)]
    for batch in batches:
        add(lake, batch, hot_key_rows=20)
    assert rows(increment.read_facts(lake, buckets=BUCKETS)) == rows(whole(lake, *batches))


def test_a_load_of_known_observations_changes_nothing(spark, lake):
    batch = observed(spark, 5, range(1, 20), 200)
    add(lake, batch)
    facts = rows(increment.read_facts(lake, buckets=BUCKETS))
    again = add(lake, batch)
    assert (again.rows_inserted, again.rows_orphaned) == (0, 0) and again.rows_relinked == len(facts)
    assert rows(increment.read_facts(lake, buckets=BUCKETS)) == facts
    summary = increment.rebuild(lake, 1, buckets=BUCKETS, lineage_checked=False)
    assert (summary.keys_processed, summary.rows_relinked) == (again.keys_processed, len(facts))
    assert rows(increment.read_facts(lake, buckets=BUCKETS)) == facts


def test_rebuild_compares_only_what_differs(spark, lake, monkeypatch):
    batch = observed(spark, 6, range(1, COMPANIES + 1), 400)
    add(lake, batch)
    facts = increment.read_facts(lake, buckets=BUCKETS)
    n = facts.count()
    lost = facts.where("entity_id = 9").count()
    entity = lake.read(load.ENTITY, schemas.ENTITY)
    lake.replace(load.ENTITY, entity.where("entity_id <> 9"))
    compared = []
    diff = chain.version_diff

    def watched(old, new, **options):
        compared.append({r[0] for r in old.select("entity_id").distinct().collect()})
        return diff(old, new, **options)

    monkeypatch.setattr(chain, "version_diff", watched)
    summary = increment.rebuild(lake, 1, buckets=BUCKETS, lineage_checked=False)
    assert (summary.rows_inserted, summary.rows_relinked, summary.rows_orphaned) == (0, n - lost, lost)
    bucket = {r[0]: r[1] for r in entity.select("entity_id", increment.bucket_of(F.col("entity_id"), BUCKETS)).collect()}
    assert {bucket[e] for e in compared[0]} == {bucket[9]}
    assert compared[0] == {e for e in bucket if bucket[e] == bucket[9]}


def test_current_rows_are_read_from_open_files_only(spark, lake):
    add(lake, observed(spark, 7, range(1, 20), 400))
    current = increment.read_facts(lake, current=True, buckets=BUCKETS)
    plan = current._jdf.queryExecution().toString()
    assert "is_open" in plan.split("PartitionFilters:")[1].split("]")[0]
    opened = {name for name in current.inputFiles()}
    read = {r[0] for r in current.select(F.input_file_name()).distinct().collect()}
    assert read and all("is_open=true" in name for name in read) and len(read) <= len(opened)
    assert rows(current) == rows(
        increment.read_facts(lake, buckets=BUCKETS).where(F.col("knowledge_to") == schemas.open_end()))


def test_a_refused_load_stays_unseen_and_can_be_repeated(spark, lake, monkeypatch):
    first, second = observed(spark, 8, range(1, 9), 100), observed(spark, 9, range(1, 9), 50)
    add(lake, first)
    before = rows(increment.read_facts(lake, buckets=BUCKETS))
    with monkeypatch.context() as patch:
        patch.setattr(increment, "_invariants", lambda *_: {"no_overlap": 1})
        with pytest.raises(ValueError, match="no_overlap"):
            add(lake, second)
    assert rows(increment.read_facts(lake, buckets=BUCKETS)) == before
    add(lake, second)
    assert rows(increment.read_facts(lake, buckets=BUCKETS)) == rows(whole(lake, first, second))
    assert {r.status for r in lineage.runs(lake).collect()} == {"success", "failed"}


def test_nothing_new_and_an_empty_table(spark, lake):
    none = observed(spark, 1, [1], 1).limit(0)
    assert add(lake, none) == load.LoadSummary(0, 0, 0, 0)
    assert increment.read_facts(lake, buckets=BUCKETS).count() == 0
    assert increment.read_facts(lake, current=True, buckets=BUCKETS).count() == 0
    unknown = observed(spark, 1, [999], 5)
    assert add(lake, unknown) == load.LoadSummary(0, 0, 0, 0)


def test_a_published_batch_is_not_loaded_again(spark, lake, monkeypatch):
    first, late = observed(spark, 10, range(1, 30), 300), observed(spark, 11, range(1, 30), 40)
    add(lake, first, batch=0)
    add(lake, late, batch=1)
    state = files(lake)
    assert add(lake, late, batch=1) == load.LoadSummary(0, 0, 0, 0)
    assert add(lake, first, batch=0) == load.LoadSummary(0, 0, 0, 0)
    assert files(lake) == state
    # A load without a number keeps the last one.
    add(lake, observed(spark, 12, [3], 5))
    assert increment.fact_table(lake, BUCKETS).last_batch() == 1


def test_stream_of_documents_equals_a_batch_load(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))

    def document(value, filed, accn, day):
        load.land(lake, fetched(spark, [
            ("companyfacts", {"ticker": "AAPL", "cik": "0000000001"}, day, 200, facts_body(value, filed, accn)),
            ("companyfacts", {"ticker": "AAPL", "cik": "0000000001"}, day, 404, "gone"),
        ]), "edgar")

    def refresh():
        start_fundamental_refresh(
            lake, f"{lake.path(load.PAYLOAD)}/log", lag_days=1, metrics=METRICS, buckets=4
        ).awaitTermination()

    load.land(lake, fetched(spark, [("ticker_map", {}, "2024-01-01", 200, TICKERS)]), "edgar")
    document(140, "2021-06-01", "a3", "2024-01-01")
    load.run_parse(lake, spark.createDataFrame([("AAPL",)], "ticker string"), METRICS)
    refresh()
    # An older filing arrives after a newer one, then the same document once more.
    document(120, "2021-03-15", "a2", "2024-04-01")
    refresh()
    document(120, "2021-03-15", "a2", "2024-05-01")
    refresh()
    facts = increment.read_facts(lake, buckets=4).orderBy("knowledge_from").collect()
    assert [int(r.value) for r in facts] == [100, 120, 140]
    assert [r.knowledge_to for r in facts[:-1]] == [r.knowledge_from for r in facts[1:]]
    assert [r.supersedes for r in facts] == [None, facts[0].fact_id, facts[1].fact_id]
