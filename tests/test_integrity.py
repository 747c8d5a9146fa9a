from __future__ import annotations

import random

import pytest
from helpers import rows, ts
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.operators import integrity


def windows(spark, items):
    return spark.createDataFrame(
        [(i, k, ts(a), ts(b)) for i, (k, a, b) in enumerate(items)],
        "id int, k string, knowledge_from timestamp, knowledge_to timestamp",
    )


OPEN = schemas.OPEN_END


def test_overlaps_are_found_behind_a_contained_window(spark):
    df = windows(spark, [
        ("a", "2021-01-01", "2021-12-31"), ("a", "2021-02-01", "2021-03-01"), ("a", "2021-06-01", "2021-07-01"),
        ("b", "2021-01-01", "2021-02-01"), ("b", "2021-02-01", OPEN),
        (None, "2021-01-01", "2021-03-01"), (None, "2021-02-01", OPEN),
    ])
    found = integrity.overlap_violations(df, ["k"], tie=["knowledge_to", "id"])
    assert rows(found.select("id")) == [(1,), (2,), (6,)]


@pytest.mark.parametrize("hot_key_rows", [None, 20])
def test_overlaps_equal_a_loop(spark, hot_key_rows):
    rng = random.Random(3)
    items = []
    for i in range(200):
        start = rng.randint(0, 20000)
        items.append((i, rng.choice("aaab"), start, start + rng.randint(0, 300)))
    df = spark.createDataFrame(items, "id int, k string, f bigint, t bigint").select(
        "id", "k", F.timestamp_seconds("f").alias("knowledge_from"), F.timestamp_seconds("t").alias("knowledge_to")
    )
    found = integrity.overlap_violations(
        df, ["k"], tie=["knowledge_to", "id"], hot_key_rows=hot_key_rows
    )
    expected = [
        (i,) for i, k, f, t in items
        if f < t and any(k == k2 and f2 < t2 and (f2, t2, i2) < (f, t, i) and t2 > f for i2, k2, f2, t2 in items)
    ]
    assert rows(found.select("id")) == sorted(expected, key=repr)


def test_small_rules(spark):
    df = windows(spark, [("a", "2021-01-01", OPEN), ("a", "2021-02-01", OPEN), ("b", "2021-01-02", "2021-01-02")])
    assert rows(integrity.open_row_violations(df, ["k"])) == [("a", 2)]
    assert rows(integrity.window_violations(df).select("k")) == [("b",)]
    dated = df.withColumn("filed_date", F.lit("2021-01-02").cast("date"))
    assert rows(integrity.early_knowledge_violations(dated, "filed_date").select("id")) == [(0,)]
    assert integrity.domain_violations(df, "k", ["a"]).count() == 1
    assert integrity.domain_violations(df.withColumn("k", F.lit(None).cast("string")), "k", ["a"]).count() == 3


def test_entity_tables_are_reported(spark):
    entity = spark.createDataFrame([(1, "a", "A"), (2, "a", "B"), (3, "c", "C")], "entity_id long, cik string, name string")
    mapping = windows(spark, [("X", "2021-01-01", OPEN), ("X", "2021-02-01", OPEN)]).withColumnRenamed("k", "ticker")
    mapping = mapping.withColumn("entity_id", F.lit(9).cast("bigint"))
    report = {r.invariant: r.violations for r in integrity.entity_invariants(entity, mapping).collect()}
    assert report == {
        "unique_cik": 1, "unique_entity": 0, "one_open_ticker": 1, "one_open_holder": 1, "no_overlap": 1,
        "window_order": 0, "known_entity": 2,
    }


@pytest.mark.parametrize("hot_key_rows", [None, 3])
def test_one_pass_counts_what_the_rules_find(spark, hot_key_rows):
    random.seed(5)
    day = [ts(f"2024-01-{k:02d}") for k in range(1, 9)] + [ts("9999-12-31")]
    end = spark.range(1).select(schemas.open_end()).first()[0]
    data = [
        (random.choice(["a", "b", None, f"k{i}"]), random.choice(day[:8]), random.choice([*day[:8], end]), random.randrange(40))
        for i in range(200)
    ]
    df = spark.createDataFrame(
        [(k, f, t, i) for k, f, t, i in data],
        "k string, knowledge_from timestamp, knowledge_to timestamp, fact_id bigint",
    )
    report = {r.invariant: r.violations for r in integrity.chain_report(df, ["k"], hot_key_rows=hot_key_rows).collect()}
    assert report == {
        "no_overlap": integrity.overlap_violations(df, ["k"], tie=["knowledge_to", "fact_id"]).count(),
        "one_open_row": integrity.open_row_violations(df, ["k"]).count(),
        "unique_version": integrity.duplicate_keys(df, ["k", "knowledge_from"]).count(),
        "unique_id": integrity.duplicate_keys(df, ["k", "fact_id"]).count(),
    }
    assert all(report.values())


def test_invariants_inside_a_key_move_rows_once(spark, capsys):
    df = spark.createDataFrame([], schemas.PRICE_FACT)
    integrity.chain_report(df, schemas.PRICE_KEY).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1
