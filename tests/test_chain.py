from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import d, entities, rows, stg, table, ts
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.operators import chain, integrity

OPEN = ts("9999-12-31 23:59:59.999999")


def facts_of(spark, staged, **options):
    return chain.fundamental_facts(staged, entities(spark, 1, 2), source="edgar", lag_days=1, **options)


def windows(facts):
    out = facts.orderBy("knowledge_from").select(
        F.col("value").cast("int"), "accession_no", "knowledge_from", "knowledge_to"
    )
    return [tuple(row) for row in out.collect()]


def test_simple_amendment_gives_contiguous_versions(spark):
    facts = facts_of(
        spark,
        stg(spark, [
            {"value": 100, "accession_no": "a1", "filed_date": d("2021-02-01")},
            {"value": 110, "accession_no": "a2", "filed_date": d("2021-06-01")},
        ]),
    )
    assert windows(facts) == [
        (100, "a1", ts("2021-02-02 13:30:00"), ts("2021-06-02 13:30:00")),
        (110, "a2", ts("2021-06-02 13:30:00"), OPEN),
    ]
    first, second = facts.orderBy("knowledge_from").collect()
    assert first.supersedes is None
    assert second.supersedes == first.fact_id


def test_same_day_filings_are_staggered(spark):
    facts = facts_of(
        spark,
        stg(spark, [
            {"value": 100, "accession_no": "a1", "filed_date": d("2021-02-01")},
            {"value": 105, "accession_no": "a2", "filed_date": d("2021-02-01")},
        ]),
    )
    assert [w[2] for w in windows(facts)] == [ts("2021-02-02 13:30:00"), ts("2021-02-02 13:30:01")]


def test_weekend_filings_share_an_opening_and_are_staggered(spark):
    days = ["2021-02-05", "2021-02-06", "2021-02-07", "2021-02-08"]
    facts = facts_of(
        spark,
        stg(spark, [
            {"value": i, "accession_no": f"a{i}", "filed_date": d(day)} for i, day in enumerate(days)
        ]),
    )
    assert [w[2] for w in windows(facts)] == [
        ts("2021-02-08 13:30:00"), ts("2021-02-08 13:30:01"), ts("2021-02-08 13:30:02"),
        ts("2021-02-09 13:30:00"),
    ]


def test_repeat_of_a_value_is_no_version_but_a_return_is(spark):
    facts = facts_of(
        spark,
        stg(spark, [
            {"value": v, "accession_no": f"a{i}", "filed_date": d(f"2021-0{i + 1}-01")}
            for i, v in enumerate([100, 100, 110, 100])
        ]),
    )
    assert [(w[0], w[1]) for w in windows(facts)] == [(100, "a0"), (110, "a2"), (100, "a3")]


def test_quarter_and_year_to_date_are_separate_facts(spark):
    facts = facts_of(
        spark,
        stg(spark, [
            {"value": 100, "accession_no": "a1", "filed_date": d("2021-02-01")},
            {"value": 300, "accession_no": "a1", "filed_date": d("2021-02-01"),
             "period_start": d("2020-01-01")},
        ]),
    )
    assert facts.where(F.col("knowledge_to") == schemas.open_end()).count() == 2


def test_late_original_is_spliced_in_front(spark):
    amended = [{"value": 110, "accession_no": "a2", "filed_date": d("2021-06-01")}]
    original = [{"value": 100, "accession_no": "a1", "filed_date": d("2021-02-01")}]
    before = facts_of(spark, stg(spark, amended))
    after = facts_of(spark, stg(spark, amended + original))
    diff = chain.version_diff(before, after, keys=schemas.FACT_KEY, version="accession_no")
    assert rows(diff.select("accession_no", "action")) == [("a1", "insert"), ("a2", "relink")]
    assert chain.load_summary(diff, schemas.FACT_KEY).first().asDict() == {
        "keys_processed": 1, "rows_inserted": 1, "rows_relinked": 1, "rows_orphaned": 0,
    }


def test_second_run_over_the_same_input_inserts_nothing(spark):
    staged = stg(spark, [
        {"value": 100, "accession_no": "a1", "filed_date": d("2021-02-01")},
        {"value": 110, "accession_no": "a2", "filed_date": d("2021-06-01")},
    ])
    diff = chain.version_diff(
        facts_of(spark, staged), facts_of(spark, staged), keys=schemas.FACT_KEY, version="accession_no"
    )
    summary = chain.load_summary(diff, schemas.FACT_KEY).first()
    assert (summary.rows_inserted, summary.rows_relinked) == (0, 2)
    assert diff.where("moved").count() == 0


def test_facts_without_entity_or_key_are_left_out(spark):
    staged = stg(spark, [
        {"value": 1, "accession_no": "a1", "filed_date": d("2021-02-01"), "cik": "0000000009"},
        {"value": 1, "accession_no": None, "filed_date": d("2021-02-01")},
        {"value": 1, "accession_no": "a1", "filed_date": None},
    ])
    assert facts_of(spark, staged).count() == 0
    _, rejected = chain.with_entity(chain.loadable(staged), entities(spark, 1))
    assert rejected.count() == 1


def test_accession_seen_twice_keeps_the_earliest_filing(spark):
    staged = stg(spark, [
        {"value": 2, "accession_no": "a1", "filed_date": d("2021-02-03"), "payload_id": 1},
        {"value": 1, "accession_no": "a1", "filed_date": d("2021-02-01"), "payload_id": 2},
        {"value": 3, "accession_no": "a1", "filed_date": d("2021-02-01"), "payload_id": 3},
    ])
    assert [w[0] for w in windows(facts_of(spark, staged))] == [1]


def random_versions(seed: int, n: int) -> list[dict]:
    rng = random.Random(seed)
    return [
        {
            "value": rng.randint(1, 4),
            "cik": f"{rng.choice([1, 1, 1, 2]):010d}",
            "metric_code": rng.choice(["revenue", "net_income"]),
            "period_start": rng.choice([None, d("2020-10-01")]),
            "accession_no": f"a{rng.randint(0, n):05d}",
            "filed_date": d("2021-01-01") + dt.timedelta(days=rng.randint(0, 25)),
            "payload_id": i,
        }
        for i in range(n)
    ]


def brute_force(observed: list[dict]) -> list[tuple]:
    """The chain of every key, one row after the other."""
    def opening(day: dt.date) -> dt.datetime:
        day += dt.timedelta(days=1)
        while day.weekday() > 4:
            day += dt.timedelta(days=1)
        return dt.datetime(day.year, day.month, day.day, 13, 30)

    by_key: dict = {}
    for row in observed:
        by_key.setdefault((int(row["cik"]), row["metric_code"], row["period_start"]), []).append(row)
    out = []
    for key, versions in by_key.items():
        chosen: dict = {}
        for row in sorted(versions, key=lambda r: (r["filed_date"], r["payload_id"])):
            chosen.setdefault(row["accession_no"], row)
        links: list = []
        for row in sorted(chosen.values(), key=lambda r: (r["filed_date"], r["accession_no"])):
            if links and links[-1][0] == row["value"]:
                continue
            start = opening(row["filed_date"])
            if links and start <= links[-1][2]:
                start = links[-1][2] + dt.timedelta(seconds=1)
            links.append((row["value"], row["accession_no"], start))
        ends = [link[2] for link in links[1:]] + [OPEN]
        out += [(*key, *link, end) for link, end in zip(links, ends, strict=True)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_key_rows", [None, 10, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_chain_equals_a_loop_also_when_keys_are_hot(spark, seed, hot_key_rows):
    observed = random_versions(seed, 600)
    facts = facts_of(spark, stg(spark, observed), hot_key_rows=hot_key_rows)
    got = facts.select(
        "entity_id", "metric_code", "period_start", F.col("value").cast("int"), "accession_no",
        "knowledge_from", "knowledge_to",
    )
    assert rows(got) == brute_force(observed)
    assert integrity.overlap_violations(facts, schemas.FACT_KEY).count() == 0
    assert integrity.open_row_violations(facts, schemas.FACT_KEY).count() == 0


def test_as_of_reads_at_most_one_row_per_key(spark):
    from hindcast.operators.asof import as_of

    facts = facts_of(spark, stg(spark, random_versions(3, 400)))
    for day in range(1, 30, 7):
        instant = F.lit(ts("2021-01-01 12:00:00") + dt.timedelta(days=day)).cast("timestamp")
        known = as_of(facts, instant)
        assert integrity.duplicate_keys(known, schemas.FACT_KEY).count() == 0
        assert known.where(F.col("filed_date") > instant.cast("date")).count() == 0


# ---- Prices ----


def price_rows(spark, items: list[tuple]):
    return table(
        spark,
        schemas.PRICE_ROW,
        [
            {
                "ticker": "AAPL", "source": "yfinance", "payload_id": i, "row_pos": 0,
                "trade_date": d(day), "close": close, "adj_close": adj, "fetched_at": ts(fetched),
            }
            for i, (day, close, adj, fetched) in enumerate(items)
        ],
    )


def mapped(spark):
    return table(
        spark,
        schemas.ENTITY_TICKER,
        [
            {"entity_id": 1, "ticker": "AAPL", "knowledge_from": ts("2000-01-01"), "knowledge_to": OPEN},
            {"entity_id": 2, "ticker": "OLD", "knowledge_from": ts("2000-01-01"), "knowledge_to": ts("2001-01-01")},
        ],
    )


@pytest.mark.parametrize("hot_key_rows", [None, 1])
def test_price_revision_opens_at_the_fetch_that_found_it(spark, hot_key_rows):
    observed = price_rows(spark, [
        ("2024-01-02", 10.5, 10.5, "2026-05-01 08:00:00"),
        ("2024-01-02", 10.5, 10.5, "2026-05-15 08:00:00"),
        ("2024-01-02", 10.5, 5.25, "2026-06-01 08:00:00"),
        ("2024-01-05", 11.0, None, "2026-05-01 08:00:00"),
        ("2024-01-05", 11.0, 11.0, "2026-06-01 08:00:00"),
    ])
    facts = chain.price_facts(observed, mapped(spark), lag_days=1, hot_key_rows=hot_key_rows)
    got = facts.select("trade_date", "adj_close", "knowledge_from", "knowledge_to")
    assert rows(got) == sorted([
        (d("2024-01-02"), 10.5, ts("2024-01-03 13:30:00"), ts("2026-06-01 08:00:00")),
        (d("2024-01-02"), 5.25, ts("2026-06-01 08:00:00"), OPEN),
        (d("2024-01-05"), None, ts("2024-01-08 13:30:00"), ts("2026-06-01 08:00:00")),
        (d("2024-01-05"), 11.0, ts("2026-06-01 08:00:00"), OPEN),
    ], key=repr)


@pytest.mark.parametrize("flags", [False, True])
def test_price_rows_move_once_beside_a_mapping_of_any_size(spark, flags):
    """Rows and mapping by ticker; neither the chain nor the rules inside a key move rows again."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = chain.price_facts(
            price_rows(spark, [("2024-01-02", 1.0, 1.0, "2024-02-01")]), mapped(spark), lag_days=1, flags=flags
        )
        plan = facts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert facts.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("hot_key_rows", [None, 1, 3])
def test_prices_of_several_tickers_of_an_entity_make_one_chain(spark, hot_key_rows):
    """AAPL and APL have one entity in the first mapping, entities of their own in the second."""
    observed = price_rows(spark, [
        ("2024-01-02", 10.0, 10.0, "2024-02-01"),
        ("2024-01-02", 11.0, 11.0, "2024-02-03"),
        ("2024-01-02", 12.0, 12.0, "2024-02-04"),
        ("2024-01-02", 13.0, 13.0, "2024-02-05"),
    ])
    late = price_rows(spark, [("2024-01-02", 10.0, 10.0, "2024-02-02")])
    observed = observed.unionByName(late.withColumns({"ticker": F.lit("APL"), "payload_id": F.lit(9).cast("bigint")}))

    def closes(entity_id: int) -> list:
        other = mapped(spark).where("ticker = 'AAPL'").withColumns(
            {"ticker": F.lit("APL"), "entity_id": F.lit(entity_id).cast("bigint")}
        )
        facts = chain.price_facts(
            observed, mapped(spark).unionByName(other), lag_days=1, hot_key_rows=hot_key_rows, flags=True
        )
        assert facts.where(" or ".join(integrity.CHAIN_RULES)).count() == 0
        return [tuple(r) for r in facts.select("entity_id", "close").orderBy("entity_id", "knowledge_from").collect()]

    assert closes(1) == [(1, 10.0), (1, 11.0), (1, 12.0), (1, 13.0)]
    assert closes(3) == [(1, 10.0), (1, 11.0), (1, 12.0), (1, 13.0), (3, 10.0)]


def test_prices_of_unmapped_tickers_are_reported(spark):
    observed = price_rows(spark, [("2024-01-02", 1.0, 1.0, "2024-02-01")]).withColumn(
        "ticker", F.lit("OLD")
    )
    assert chain.price_facts(observed, mapped(spark), lag_days=1).count() == 0
    assert rows(chain.unmapped_tickers(observed, mapped(spark))) == [("OLD",)]
