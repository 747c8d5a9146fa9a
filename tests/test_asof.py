from __future__ import annotations

import datetime as dt
import random

import pytest
from helpers import d, entities, rows, stg, table, ts
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions import calendar, scalar
from hindcast.operators import asof, chain, scd2
from hindcast.plans.reader import FUNDAMENTALS, PRICES, PointInTime

OPEN = ts("9999-12-31 23:59:59.999999")


def mapping(spark, *items):
    return table(
        spark,
        schemas.ENTITY_TICKER,
        [
            {"entity_id": e, "ticker": t, "knowledge_from": ts(a), "knowledge_to": OPEN if b is None else ts(b)}
            for e, t, a, b in items
        ],
    )


@pytest.fixture(scope="module")
def reader_tables(spark):
    staged = stg(spark, [
        {"value": 100, "accession_no": "a1", "filed_date": d("2021-02-01")},
        {"value": 110, "accession_no": "a2", "filed_date": d("2021-06-01")},
        {"value": 7, "accession_no": "b1", "filed_date": d("2021-03-01"), "cik": "0000000002"},
        {"value": 9, "accession_no": "a3", "filed_date": d("2021-03-01"), "metric_code": "net_income"},
    ])
    entity = entities(spark, 1, 2)
    prices = table(spark, schemas.PRICE_FACT, [
        {"fact_id": i, "entity_id": 1, "trade_date": d(day), "close": 1.0 * i, "adj_close": 1.0,
         "source": source, "knowledge_from": ts(known), "knowledge_to": OPEN, "payload_id": 1}
        for i, (day, source, known) in enumerate([
            ("2021-01-04", "yfinance", "2021-01-05 13:30:00"),
            ("2021-01-04", "tiingo", "2021-01-05 13:30:00"),
            ("2021-01-05", "yfinance", "2021-01-06 13:30:00"),
            ("2021-01-06", "yfinance", "2021-01-07 13:30:00"),
        ])
    ])
    return {
        "entity": entity,
        "entity_ticker": mapping(
            spark, (1, "ONE", "2000-01-01", None), (2, "TWO", "2022-01-01", None)
        ),
        "fundamental_fact": chain.fundamental_facts(staged, entity, source="edgar", lag_days=1),
        "price_fact": prices,
    }


def at(tables, text):
    return PointInTime(ts(text).replace(tzinfo=dt.UTC), **tables)


def values(df):
    return rows(df.select("ticker", F.col("value").cast("int")))


def test_reader_sees_the_version_of_its_instant(reader_tables):
    assert values(at(reader_tables, "2021-02-02 13:29:59").fundamentals(["revenue"])) == []
    # Inclusive start, exclusive end.
    assert values(at(reader_tables, "2021-02-02 13:30:00").fundamentals(["revenue"])) == [("ONE", 100)]
    assert values(at(reader_tables, "2021-06-02 13:29:59").fundamentals(["revenue"])) == [("ONE", 100)]
    assert values(at(reader_tables, "2021-06-02 13:30:00").fundamentals(["revenue"])) == [("ONE", 110)]


def test_reader_hides_facts_of_entities_not_yet_mapped(reader_tables):
    assert values(at(reader_tables, "2021-07-01 00:00:00").fundamentals(["revenue"])) == [("ONE", 110)]
    assert values(at(reader_tables, "2022-07-01 00:00:00").fundamentals(["revenue"])) == [
        ("ONE", 110), ("TWO", 7),
    ]
    assert len(values(at(reader_tables, "2021-07-01 00:00:00").latest().fundamentals(["revenue"]))) == 2


def test_reader_ticker_filter_and_fixed_schema(reader_tables):
    reader = at(reader_tables, "2022-07-01 00:00:00")
    assert values(reader.fundamentals(["revenue", "net_income"], ["ONE"])) == [("ONE", 110), ("ONE", 9)]
    empty = reader.fundamentals(["revenue"], [])
    assert empty.count() == 0
    assert [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in FUNDAMENTALS]


def test_reader_prices_by_range_and_source(reader_tables):
    reader = at(reader_tables, "2021-01-06 13:30:00")
    both = reader.prices(["ONE"], d("2021-01-01"), d("2021-01-05"))
    assert both.count() == 3
    one = reader.prices(["ONE"], d("2021-01-04"), d("2021-01-06"), "yfinance")
    assert rows(one.select("trade_date")) == [(d("2021-01-04"),), (d("2021-01-05"),)]
    assert [(f.name, f.dataType) for f in one.schema] == [(f.name, f.dataType) for f in PRICES]


def test_reader_needs_a_timezone(reader_tables):
    with pytest.raises(ValueError, match="timezone-aware"):
        PointInTime(ts("2021-01-01"), **reader_tables)


def test_reader_never_returns_a_later_filing(spark, reader_tables):
    rng = random.Random(5)
    for _ in range(8):
        instant = ts("2021-01-01") + dt.timedelta(days=rng.randint(0, 300), hours=rng.randint(0, 23))
        found = PointInTime(instant.replace(tzinfo=dt.UTC), **reader_tables).fundamentals(["revenue", "net_income"])
        assert found.where(F.col("filed_date") > F.lit(instant.date())).count() == 0


def test_reader_fails_on_a_leak(spark, reader_tables):
    leaking = reader_tables["fundamental_fact"].withColumn(
        "knowledge_from", F.lit("2000-01-01").cast("timestamp")
    )
    reader = at({**reader_tables, "fundamental_fact": leaking}, "2021-01-01 00:00:00")
    with pytest.raises(Exception, match="look-ahead"):
        reader.fundamentals(["revenue"]).collect()


def test_nearest_price_stops_at_the_first_row(spark):
    prices = spark.createDataFrame(
        [("A", d("2024-01-05"), 1.0), ("A", d("2024-01-03"), None), ("B", d("2024-01-11"), 2.0),
         ("C", d("2024-01-12"), 3.0), ("D", d("2024-01-01"), 4.0)],
        "ticker string, trade_date date, close double",
    )
    found = asof.nearest_on_or_after(prices, [d("2024-01-01")], by=["ticker"], value="close")
    # A's first row has no price, C is eleven days away.
    assert rows(found.select("ticker", "price_date", "price")) == [
        ("B", d("2024-01-11"), 2.0), ("D", d("2024-01-01"), 4.0),
    ]


def test_latest_on_or_before_breaks_ties(spark):
    facts = spark.createDataFrame(
        [("A", d("2024-01-01"), 1, 10), ("A", d("2024-01-01"), 2, 20), ("A", d("2024-03-01"), 1, 30)],
        "k string, day date, tie int, v int",
    )
    found = asof.latest_on_or_before(
        facts, [d("2023-12-31"), d("2024-02-01"), d("2024-03-01")], by=["k"], day="day",
        payload=["v"], tie=[F.col("tie")],
    )
    assert rows(found.select("date", "v")) == [(d("2024-02-01"), 20), (d("2024-03-01"), 30)]


# ---- Mapping ----


def merged(spark, before, current, when="2024-05-01"):
    now = spark.createDataFrame(current, "entity_id bigint, ticker string")
    out = scd2.merge_ticker_mapping(mapping(spark, *before), now, F.lit(when).cast("timestamp"))
    return rows(out)


def test_first_mapping_opens_at_the_sentinel_and_repeats_change_nothing(spark):
    first = merged(spark, [], [(1, "AAPL")])
    assert first == [(1, "AAPL", ts("2000-01-01"), OPEN)]
    assert merged(spark, [(1, "AAPL", "2000-01-01", None)], [(1, "AAPL")]) == first


def test_reassignment_closes_and_opens(spark):
    assert merged(spark, [(1, "AAPL", "2000-01-01", None)], [(1, "AAPLX")]) == [
        (1, "AAPL", ts("2000-01-01"), ts("2024-05-01")),
        (1, "AAPLX", ts("2024-05-01"), OPEN),
    ]


def test_ticker_moving_to_another_entity_never_overlaps(spark):
    from hindcast.operators.integrity import overlap_violations

    before = [(1, "META", "2000-01-01", None)]
    current = spark.createDataFrame([(1, "OTHER"), (2, "META")], "entity_id bigint, ticker string")
    out = scd2.merge_ticker_mapping(
        mapping(spark, *before), current, F.lit("2024-05-01").cast("timestamp")
    )
    assert overlap_violations(out, ["ticker"]).count() == 0
    assert (2, "META", ts("2024-05-01"), OPEN) in rows(out)


def test_unseen_entities_keep_their_mapping(spark):
    assert merged(spark, [(1, "A", "2000-01-01", None)], [(2, "B")]) == [
        (1, "A", ts("2000-01-01"), OPEN), (2, "B", ts("2000-01-01"), OPEN),
    ]


# ---- Scalars ----


def test_business_days_equal_a_loop(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(300):
        start = d("1965-01-01") + dt.timedelta(days=rng.randint(0, 30000))
        pairs.append((start, start + dt.timedelta(days=rng.randint(-5, 60))))

    def loop(start, end):
        days = (start + dt.timedelta(days=i) for i in range(1, (end - start).days + 1))
        return sum(day.weekday() < 5 for day in days)

    df = spark.createDataFrame(pairs, "a date, b date")
    got = df.select("a", "b", calendar.business_days_between(F.col("a"), F.col("b")).alias("n"))
    assert all(row.n == loop(row.a, row.b) for row in got.collect())


def test_quarter_calendar(spark):
    assert calendar.quarter_start_dates(d("2020-02-15"), d("2020-10-01")) == [
        d("2020-04-01"), d("2020-07-01"), d("2020-10-01"),
    ]
    df = spark.createDataFrame([(d("2020-02-15"), d("2020-10-01")), (d("2020-02-15"), d("2020-03-01"))], "a date, b date")
    got = [row[0] for row in df.select(calendar.quarter_starts(F.col("a"), F.col("b"))).collect()]
    assert got == [[d("2020-04-01"), d("2020-07-01"), d("2020-10-01")], []]


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.vendor_ticker(F.lit("brk.b")).alias("ticker"),
        scalar.padded_cik(F.lit(320193)).alias("cik"),
        scalar.padded_cik(F.lit("12345678901")).alias("long_cik"),
        scalar.relative_difference(F.lit(1.0), F.lit(0.0)).alias("by_zero"),
        calendar.local_date(F.lit("2024-01-02 23:30:00-05:00")).alias("day"),
        calendar.elapsed_days(
            F.lit("2024-01-02 11:00:00").cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp")
        ).alias("elapsed"),
        scalar.json_document(left=F.lit(100.0), right=F.lit(None).cast("double")).alias("doc"),
    ).first()
    assert tuple(row) == (
        "BRK-B", "0000320193", "12345678901", None, d("2024-01-02"), 0, '{"left":100.0,"right":null}',
    )


def nearest_by_hand(left, right, forward, tolerance):
    out = []
    for key, at, tag in left:
        found = []
        for r_key, r_at, value in right:
            apart = None if None in (at, r_at) else (r_at - at if forward else at - r_at).total_seconds()
            if key is not None and key == r_key and apart is not None and 0 <= apart <= tolerance:
                # Nearest first; at one instant the greatest value counts, NULL being the least.
                found.append((-apart, value is not None, value or 0, r_at, value))
        best = max(found)[3:] if found else (None, None)
        out.append((key, at, tag, *best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("tolerance", [None, 40])
@pytest.mark.parametrize("hot_key_rows", [None, 25])
def test_nearest_instant_like_brute_force(spark, direction, tolerance, hot_key_rows):
    random.seed(7)
    start = dt.datetime(2024, 1, 1)

    def side(n, values):
        # Half of the rows share one key; few instants, so that many are equal.
        return [
            (random.choice(["a", "a", "a", "b", "c", None]),
             random.choice([None, *[start + dt.timedelta(seconds=random.randrange(300), microseconds=5)] * 9]),
             random.choice(values))
            for _ in range(n)
        ]

    left, right = side(80, [1, 1, 2]), side(60, [1, 2, 3, None])
    found = asof.nearest_instant(
        spark.createDataFrame(left, "k string, at timestamp, tag int"),
        spark.createDataFrame(right, "k string, at timestamp, tag int"),
        by=["k"], left_time="at", right_time="at", payload=["tag"], direction=direction,
        tolerance_s=tolerance, hot_key_rows=hot_key_rows,
    )
    assert found.columns == ["k", "at", "tag", "matched_at", "matched_tag"]
    assert rows(found) == nearest_by_hand(left, right, direction == "forward", tolerance or 10**9)


def test_nearest_instant_of_empty_sides_and_its_plan(spark):
    one = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1)], "k string, at timestamp, v int")
    none = one.limit(0)
    options = dict(by=["k"], left_time="at", right_time="at", payload=["v"])
    assert rows(asof.nearest_instant(one, none, **options)) == [("a", dt.datetime(2024, 1, 1), 1, None, None)]
    assert asof.nearest_instant(none, one, **options).count() == 0
    plan = asof.nearest_instant(one, one, **options)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError, match="direction"):
        asof.nearest_instant(one, one, direction="sideways", **options)
