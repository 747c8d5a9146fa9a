from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from helpers import d, entities, rows, table, ts
from pyspark.sql import functions as F

from hindcast import config, schemas
from hindcast.operators import checks, exceptions, feeds

OPEN = ts("9999-12-31 23:59:59.999999")
RULES = config.reconciliation_rules(config.RECONCILIATION)


def prices(spark, items):
    return table(spark, schemas.PRICE_FACT, [
        {"fact_id": i, "entity_id": 1, "trade_date": d(day) if isinstance(day, str) else day,
         "close": value, "adj_close": value, "source": source, "knowledge_from": ts("2000-01-01"),
         "knowledge_to": OPEN, "payload_id": 1}
        for i, (day, source, value) in enumerate(items)
    ])


def facts(spark, items, metric="revenue", quarter="Q1"):
    return table(spark, schemas.FUNDAMENTAL_FACT, [
        {"fact_id": i, "entity_id": 1, "metric_code": metric, "period_end": end,
         "period_start": end - dt.timedelta(days=length), "value": Decimal(str(value)), "unit": "USD",
         "fiscal_period": quarter, "source": "edgar", "vendor_native_tag": tag, "filed_date": end,
         "knowledge_from": ts("2000-01-01"), "knowledge_to": OPEN, "payload_id": 1}
        for i, (end, value, length, tag) in enumerate(items)
    ])


def quarters(values, length=90, tag="Revenues"):
    start = d("2019-03-31")
    return [(start + dt.timedelta(days=91 * i), v, length, tag) for i, v in enumerate(values)]


def results(df):
    return sorted(df.collect(), key=lambda r: r.dimension_key)


def only_vacuous(df):
    found = results(df)
    return len(found) == 1 and found[0].status == "pass" and json.loads(found[0].observed) == {"compared_rows": 0}


def test_cross_vendor(spark):
    entity = entities(spark, 1)

    def run(items):
        return results(checks.check_cross_vendor_price(prices(spark, items), entity, RULES))

    both = lambda day, left, right: [(day, "yfinance", left), (day, "tiingo", right)]
    assert [r.status for r in run(both("2024-01-02", 100.0, 101.0))] == ["pass"]
    (shifted,) = run(both("2024-01-02", 100.0, 1000.0))
    assert (shifted.status, shifted.severity) == ("fail", "WARN")
    (missing,) = run(both("2024-01-02", 100.0, None))
    assert missing.status == "fail"
    assert json.loads(missing.observed) == {"left": 100.0, "right": None}
    (zero,) = run(both("2024-01-02", 100.0, 0.0))
    assert zero.status == "fail"
    streak = run([x for i in range(4) for x in both(d("2024-01-02") + dt.timedelta(days=i), 100.0, 200.0)])
    assert [r.severity for r in streak] == ["WARN", "WARN", "BREAK", "BREAK"]
    broken = run([x for i in range(5) for x in both(d("2024-01-02") + dt.timedelta(days=i), 100.0, 100.0 if i == 2 else 200.0)])
    assert {r.severity for r in broken} == {"WARN"}
    assert only_vacuous(checks.check_cross_vendor_price(prices(spark, [("2024-01-02", "tiingo", 1.0)]), entity, RULES))


def test_rules_are_validated():
    bad = json.loads(json.dumps(config.RECONCILIATION))
    bad[0]["left"]["field"] = "volume; drop"
    with pytest.raises(ValueError, match="cannot compare left field"):
        config.reconciliation_rules(bad)
    absolute = json.loads(json.dumps(config.RECONCILIATION))
    absolute[0]["tolerance"]["type"] = "absolute"
    with pytest.raises(ValueError, match="relative"):
        config.reconciliation_rules(absolute)


def test_revenue_against_trailing_median(spark):
    entity = entities(spark, 1)
    run = lambda items: results(checks.check_revenue_sanity(facts(spark, items), entity))
    assert only_vacuous(checks.check_revenue_sanity(facts(spark, quarters([100, 100, 100, 100])), entity))
    assert [r.status for r in run(quarters([100] * 5))] == ["pass"]
    assert [r.status for r in run(quarters([100] * 4 + [1000]))] == ["fail"]
    assert [r.status for r in run(quarters([100] * 4 + [-5]))] == ["fail"]
    regime = run(quarters([100] * 10 + [350] * 6))[-1]
    assert regime.status == "pass"
    assert json.loads(regime.observed)["trailing_median"] == 350.0
    # A nine-month figure is no quarter and does not move the median.
    mixed = quarters([100] * 5) + [(d("2020-05-01"), 300, 270, "Revenues")]
    (single,) = run(mixed)
    assert json.loads(single.observed)["trailing_median"] == 100.0


def test_period_gaps(spark):
    entity = entities(spark, 1)
    run = lambda items, **kw: [r.status for r in results(checks.check_period_coverage_gaps(facts(spark, items, **kw), entity))]
    ends = ["2022-03-31", "2022-06-30", "2022-09-30", "2022-12-31", "2023-03-31"]
    full = [(d(end), 1, 90, "t") for end in ends]
    assert run(full) == ["pass"] * 4
    assert sorted(run(full[:2] + full[3:])) == ["fail", "pass", "pass"]
    # A fiscal year closing where the fourth quarter would have bridges it.
    bridged = facts(spark, full[:3] + full[4:]).unionByName(facts(spark, full[3:4], quarter="FY"))
    assert {r.status for r in checks.check_period_coverage_gaps(bridged, entity).collect()} == {"pass"}


def test_price_staleness(spark):
    entity = entities(spark, 1)
    as_of = F.lit("2024-01-15 10:00:00").cast("timestamp")
    run = lambda day: results(checks.check_price_staleness(prices(spark, [(day, "yfinance", 1.0)]), entity, as_of))
    assert run("2024-01-08")[0].status == "pass"
    stale = run("2024-01-05")[0]
    assert stale.status == "fail"
    assert json.loads(stale.observed) == {"max_trade_date": "2024-01-05", "business_days_stale": 6}
    assert only_vacuous(checks.check_price_staleness(prices(spark, []), entity, as_of))


def test_return_outliers(spark):
    entity = entities(spark, 1)
    days = [d("2024-01-01") + dt.timedelta(days=i) for i in range(32)]
    calm = [(day, "yfinance", 100.0 + (i % 2)) for i, day in enumerate(days[:31])]
    assert {r.status for r in results(checks.check_return_outliers(prices(spark, calm), entity))} == {"pass"}
    jump = calm + [(days[31], "yfinance", 1000.0)]
    last = results(checks.check_return_outliers(prices(spark, jump), entity))[-1]
    assert (last.status, last.severity) == ("fail", "INFO")
    flat = [(day, "yfinance", 100.0) for day in days]
    assert only_vacuous(checks.check_return_outliers(prices(spark, flat), entity))


def payloads(spark, items):
    return spark.createDataFrame(
        [(i, source, "history", {"ticker": "A"} if source != "map" else {}, ts(at), 200, sha, bytearray(b""), "r")
         for i, (source, at, sha) in enumerate(items)],
        schemas.PAYLOAD,
    )


@pytest.mark.parametrize("hot_key_rows", [None, 1])
def test_payload_freshness(spark, hot_key_rows):
    log = payloads(spark, [
        ("yfinance", "2024-01-01 00:00:00", "a"), ("yfinance", "2024-01-03 23:00:00", "a"),
        ("yfinance", "2024-01-06 23:00:00", "a"), ("yfinance", "2024-01-20 00:00:00", "b"),
        ("map", "2024-01-01", "x"), ("map", "2024-06-01", "x"),
    ])
    found = results(checks.check_payload_freshness(log, hot_key_rows=hot_key_rows))
    assert [r.status for r in found] == ["pass", "fail", "pass"]
    assert json.loads(found[0].observed) == {"unchanged": True, "days_since_previous_fetch": 2}
    single = checks.check_payload_freshness(payloads(spark, [("edgar", "2024-01-01", "a")]))
    assert only_vacuous(single)


def test_tag_switches(spark):
    entity = entities(spark, 1)
    same = results(checks.check_tag_switches(facts(spark, quarters([1, 2])), entity))
    assert [r.status for r in same] == ["pass"]
    both = quarters([1], tag="B") + [(d("2021-01-01"), 1, 90, "A")]
    (switched,) = results(checks.check_tag_switches(facts(spark, both), entity))
    assert switched.status == "fail"
    assert json.loads(switched.observed) == {"tags_used": ["A", "B"]}


def test_balance_sheet(spark):
    entity = entities(spark, 1)
    assets = facts(spark, [(d("2023-12-31"), 1000, 90, "Assets")], metric="total_assets")

    def document(points):
        body = {"cik": 1, "entityName": "E", "facts": {"us-gaap": {
            checks.LIABILITIES_AND_EQUITY: {"units": {"USD": points}}}}}
        return spark.createDataFrame([(1, bytearray(json.dumps(body).encode()))], "payload_id bigint, body binary")

    def point(value, **more):
        return {"end": "2023-12-31", "val": value, "accn": "a", "form": "10-K", "filed": "2024-02-01", **more}

    def run(points):
        return checks.check_balance_sheet_identity(assets, entity, document(points))

    assert [r.status for r in results(run([point(1005)]))] == ["pass"]
    assert [r.status for r in results(run([point(1100)]))] == ["fail"]
    # The first point without a start decides.
    assert [r.status for r in results(run([point(5, start="2023-01-01"), point(1000), point(1)]))] == ["pass"]
    assert only_vacuous(run([]))


# ---- Exceptions ----


def outcome(spark, *items):
    return table(spark, schemas.CHECK_RESULT, [
        {"check_name": "c", "dataset": "x", "severity": severity, "status": status, "dimension_key": key,
         "ordinal": i}
        for i, (key, status, severity) in enumerate(items)
    ])


def day(n):
    return F.lit(f"2024-01-{n:02d}").cast("timestamp")


def test_exception_lifecycle(spark):
    state = exceptions.empty_exceptions(spark)
    state = exceptions.advance(state, outcome(spark, ("k", "fail", "WARN"), ("ok", "pass", "WARN")), day(1))
    opened = state.collect()
    assert [(r.dimension_key, r.status, r.severity) for r in opened] == [("k", "open", "WARN")]
    state = exceptions.advance(state, outcome(spark, ("k", "fail", "BREAK")), day(2))
    (same,) = state.collect()
    assert (same.exception_id, same.status, same.severity, same.last_severity, same.opened_at) == (
        opened[0].exception_id, "open", "WARN", "BREAK", ts("2024-01-01"),
    )
    state = exceptions.advance(state, outcome(spark, ("other", "pass", "WARN")), day(3))
    assert state.first().status == "open"
    state = exceptions.advance(state, outcome(spark, ("k", "pass", "WARN")), day(4))
    (closed,) = state.collect()
    assert (closed.status, closed.closed_at) == ("closed", ts("2024-01-04"))
    assert closed.resolution_note == exceptions.AUTO_RESOLVED
    state = exceptions.advance(state, outcome(spark, ("k", "fail", "WARN")), day(5))
    assert sorted(r.status for r in state.collect()) == ["closed", "open"]


def test_triage_and_resolve(spark):
    state = exceptions.advance(
        exceptions.empty_exceptions(spark),
        outcome(spark, ("a", "fail", "INFO"), ("b", "fail", "BREAK"), ("c", "fail", "WARN")), day(1),
    )
    ids = {r.dimension_key: r.exception_id for r in state.collect()}
    assert [r.severity for r in exceptions.open_exceptions(state).collect()] == ["BREAK", "WARN", "INFO"]
    state = exceptions.triage(state, [ids["a"]], "looking")
    with pytest.raises(ValueError, match="no open exception"):
        exceptions.triage(state, [ids["a"]], "again")
    # A pass closes an acknowledged exception as well.
    passed = exceptions.advance(state, outcome(spark, ("a", "pass", "INFO")), day(2))
    assert passed.where("dimension_key = 'a'").first().status == "closed"
    state = exceptions.resolve(state, [ids["a"], ids["b"]], "done", day(3))
    assert rows(state.select("dimension_key", "status")) == [("a", "closed"), ("b", "closed"), ("c", "open")]
    with pytest.raises(ValueError, match="no open/triage exception"):
        exceptions.resolve(state, [123], "?", day(4))


def test_last_result_of_a_key_decides(spark):
    state = exceptions.advance(
        exceptions.empty_exceptions(spark), outcome(spark, ("k", "fail", "WARN"), ("k", "pass", "WARN")), day(1)
    )
    assert state.count() == 0


# ---- Feeds ----


def test_feed_status(spark):
    log = payloads(spark, [("edgar", "2024-01-01", "a"), ("yfinance", "2024-03-28", "b"), ("tiingo", "2024-03-30 12:00:00", "c")])
    sla = spark.createDataFrame(
        [("edgar", 90, 120), ("yfinance", 1, 5), ("tiingo", 1, 5), ("new", 1, 2)],
        "source string, expected_refresh_days int, max_staleness_days int",
    )
    status = feeds.feed_status(log, sla, F.lit("2024-03-31").cast("timestamp"))
    assert rows(status.select("source", "status")) == [
        ("edgar", "ok"), ("new", "no_data"), ("tiingo", "ok"), ("yfinance", "stale"),
    ]
    assert status.where("source = 'tiingo'").first().staleness_days == 0.5
    edges = spark.createDataFrame(
        [("edgar", "facts"), ("facts", "report"), ("yfinance", "prices"), ("tiingo", "prices"),
         ("prices", "returns"), ("returns", "report")],
        "src string, dst string",
    )
    risk = {row.node for row in feeds.at_risk(status, edges).collect()}
    assert risk == {"prices", "returns", "report"}


def test_downstream_ends_on_cycles_and_dead_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("z",)], "root string")
    assert rows(feeds.downstream(edges, roots)) == [("a", "b"), ("a", "c")]
    assert feeds.downstream(edges, roots.where("root = 'z'")).count() == 0


def test_downstream_of_many_roots_like_a_walk_of_the_graph(spark):
    random.seed(3)
    pairs = {(random.randrange(120), random.randrange(120)) for _ in range(110)}
    pairs |= {(n, n + 1) for n in range(200, 230)} | {(230, 200)}
    starts = [*range(0, 100), 200, 215, 999]
    edges = [(str(a), str(b)) for a, b in pairs]

    def walk(root):
        seen, todo = set(), [root]
        while todo:
            node = todo.pop()
            new = {b for a, b in edges if a == node} - seen
            seen |= new
            todo += new
        return seen

    expected = {(str(root), node) for root in starts for node in walk(str(root))}
    graph = spark.createDataFrame([*edges, edges[0], (None, "1"), ("1", None)], "src string, dst string")
    roots = spark.createDataFrame([(str(r),) for r in [*starts, starts[0]]] + [(None,)], "root string")
    assert rows(feeds.downstream(graph, roots)) == sorted(expected, key=repr)
    status = roots.select(F.col("root").alias("source"), F.lit("breach").alias("status"))
    counted = {node: sum(node == n for _, n in expected) for _, node in expected}
    assert {r.node: r.n_feeds for r in feeds.at_risk(status, graph).collect()} == counted
    assert feeds.at_risk(status.limit(0), graph).count() == 0


def test_entities_dealt_to_tasks_give_the_same_results(spark, monkeypatch):
    monkeypatch.setattr(checks, "TASK_ROWS", 4)
    days = [f"2024-01-{k:02d}" for k in range(2, 20)]
    items = [(day, source, 1.0 + 0.01 * (k % 3)) for k, day in enumerate(days) for source in ("yfinance", "tiingo")]
    table, entity = prices(spark, items), entities(spark, 1)
    tasks = checks.tasks_for(table)
    assert tasks == 9
    for check in (lambda **o: checks.check_cross_vendor_price(table, entity, RULES, **o),
                  lambda **o: checks.check_return_outliers(table, entity, **o)):
        assert rows(check(tasks=tasks)) == rows(check())
