"""Landings: seen whole or not at all, only touched prefixes and buckets read, order of arrival no matter."""

from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.plans import lineage, load
from hindcast.plans.landing import Landings
from hindcast.sources import payloads
from hindcast.sources.lake import Lake

FETCHED = "endpoint string, request_params map<string,string>, fetched_at timestamp, http_status int, body binary"


def responses(spark, *items):
    """(ticker, cik, minute, status, body) as a batch of responses."""
    def params(ticker, cik):
        return {k: v for k, v in (("ticker", ticker), ("cik", cik)) if v is not None}

    return spark.createDataFrame(
        [("companyfacts", params(t, c), dt.datetime(2024, 1, 1, 0, m), s, None if b is None else b.encode())
         for t, c, m, s, b in items], FETCHED,
    )


@pytest.fixture
def landings(spark, tmp_path):
    return Landings(Lake(spark, str(tmp_path / "lake")), prefix_digits=1, buckets=4)


BATCHES = [
    [("A", "1", 10, 200, "x"), ("B", "2", 11, 200, "y"), ("A", "1", 12, 500, "z"), ("C", None, 5, 404, "")],
    [("A", "1", 3, 200, "late"), ("B", "3", 20, 200, "x"), (None, "3", 21, 200, "w"), ("B", "3", 20, 200, "v")],
    [("C", None, 30, 200, "x"), ("D", "4", 1, 500, "q")],
]


def landed(spark, landings):
    for i, batch in enumerate(BATCHES):
        assert landings.land(responses(spark, *batch), "edgar", f"b{i}")
    return landings


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    """The three batches landed, for tests that only read."""
    lake = Lake(spark, str(tmp_path_factory.mktemp("three") / "lake"))
    return landed(spark, Landings(lake, prefix_digits=1, buckets=4))


def test_flags_are_those_of_the_whole_log(spark, three, tmp_path):
    landings = three
    plain = Lake(spark, str(tmp_path / "plain"))
    for batch in BATCHES:
        load.land(plain, responses(spark, *batch), "edgar")
    columns = ["source", "payload_id", "content_unchanged"]
    assert rows(landings.flags().select(*columns)) == rows(load.read_landings(plain).select(*columns))
    same = [c for c in schemas.PAYLOAD.fieldNames() if c not in ("run_id", "request_params")]
    assert rows(landings.payloads().select(*same)) == rows(load.read_payloads(plain).select(*same))
    distinct = landings.payloads().select("source", "content_sha256").distinct()
    assert rows(landings.hashes()) == rows(distinct)


@pytest.mark.parametrize("ok_only", [True, False])
@pytest.mark.parametrize("by", [["ticker"], ["cik"], ["source", "endpoint", "ticker"]])
def test_newest_is_that_of_the_whole_log(three, by, ok_only):
    landings = three
    asked = {"ticker": payloads.ticker_of(), "cik": F.col("request_params")["cik"]}
    expected = payloads.latest(
        landings.payloads(), [asked.get(name, F.col(name)).alias(name) for name in by], ok_only=ok_only
    )
    columns = ["payload_id", "fetched_at", "body"]
    assert rows(landings.latest(by, ok_only=ok_only).select(*columns)) == rows(expected.select(*columns))


def test_only_landings_with_a_winner_are_opened(three):
    landings = three
    newest = landings.latest(["ticker"], where=F.col("ticker") == "A")
    assert len(newest.inputFiles()) > 0
    first = landings.folders("payload")[0].folder
    assert all(first in name for name in newest.inputFiles() if "/payload/" in name)
    assert [bytes(r.body) for r in newest.collect()] == [b"x"]


def test_a_batch_reads_the_prefixes_of_its_own_hashes(spark, landings, monkeypatch):
    landed(spark, landings)
    asked = []
    whole = landings.hashes
    monkeypatch.setattr(landings, "hashes", lambda prefixes=None: asked.append(prefixes) or whole(prefixes))
    before = {(r.kind, r.part): r.folder for r in landings.folders() if r.kind == "newest"}
    new = responses(spark, ("A", "1", 40, 200, "x"))
    landings.land(new, "edgar")
    (prefixes,) = asked
    assert prefixes == [new.select(F.substring(F.sha2("body", 256), 1, 1)).first()[0]]
    assert all(f"prefix={prefixes[0]}/" in name for name in whole(prefixes).inputFiles())
    after = {(r.kind, r.part): r.folder for r in landings.folders() if r.kind == "newest"}
    # One request, so one bucket: the others keep their files.
    assert sum(before.get(key) != folder for key, folder in after.items()) == 1


def test_a_batch_lands_once(spark, landings):
    batch = responses(spark, *BATCHES[0])
    assert landings.land(batch, "edgar", "b0")
    assert landings.land(batch, "edgar", "b0") is None
    assert landings.payloads().count() == len(BATCHES[0])


@pytest.mark.parametrize("step", ["_write_hashes", "_write_newest", "_publish"])
def test_a_landing_that_dies_leaves_nothing_and_may_be_retried(spark, landings, monkeypatch, step):
    landings.land(responses(spark, *BATCHES[0]), "edgar", "b0")
    states = [landings.payloads, landings.flags, landings.hashes, landings.newest]
    before = [rows(read().drop("request_params")) for read in states]

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(landings, step, die)
        with pytest.raises(RuntimeError):
            landings.land(responses(spark, *BATCHES[1]), "edgar", "b1")
    assert [rows(read().drop("request_params")) for read in states] == before
    assert landings.land(responses(spark, *BATCHES[1]), "edgar", "b1")
    assert landings.payloads().count() == len(BATCHES[0]) + len(BATCHES[1])
    assert sorted(r.status for r in lineage.runs(landings.lake).collect()) == ["failed", "success", "success"]


def test_compacted_hashes_are_the_same(spark, landings):
    landed(spark, landings)
    before = rows(landings.hashes())
    landings.compact_hashes()
    assert rows(landings.hashes()) == before
    parts = [r.part for r in landings.folders("hash")]
    assert len(parts) == len(set(parts))
    landings.land(responses(spark, ("Z", "9", 50, 200, "x")), "edgar")
    assert rows(landings.hashes()) == before


def test_an_empty_log_an_empty_batch_and_a_missing_body(spark, landings):
    assert landings.payloads().count() == landings.latest(["ticker"]).count() == 0
    landings.land(responses(spark, *BATCHES[0]).limit(0), "edgar", "none")
    assert landings.payloads().count() == landings.flags().count() == landings.hashes().count() == 0
    with pytest.raises(Exception, match="no body"):
        landings.land(responses(spark, ("A", "1", 1, 200, None)), "edgar")
    assert landings.payloads().count() == 0
