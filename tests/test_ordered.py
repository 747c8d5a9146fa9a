from __future__ import annotations

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hindcast.operators import ordered
from hindcast.operators.ordered import (
    ChunkedScan, Scan, earlier_max, following, previous, running_max, running_sum, split_by_heat, trailing_moments,
)


def sample(spark, n=3000):
    rng = random.Random(7)
    data = [
        (
            None if rng.random() < 0.1 else rng.choice(["hot"] * 6 + ["a", "b", "c"]),
            i,
            None if rng.random() < 0.2 else rng.randint(-50, 50),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(data, "key string, at int, v int").repartition(5)


def scanned(rows_, scan):
    out = scan(
        rows_,
        before=previous(F.col("v")),
        after=following(F.col("v")),
        total=running_sum(F.col("v")),
        top=running_max(F.col("v")),
        earlier=earlier_max(F.col("v")),
    )
    # A second scan over a filtered result: chunks may lose all their rows.
    return scan(out.where("v > 0 or v is null"), again=previous(F.col("total")))


COLUMNS = ["key", "at", "v", "before", "after", "total", "top", "earlier", "again"]


@pytest.mark.parametrize("chunk_rows", [7, 100, 2500])
def test_chunked_scan_equals_the_plain_window(spark, chunk_rows):
    df = sample(spark)
    plain = scanned(df, Scan(["key"], ["at"])).select(*COLUMNS)
    split = split_by_heat(
        df, ["key"], ["at"], scanned, hot_key_rows=300, chunk_rows=chunk_rows
    ).select(*COLUMNS)
    assert rows(split) == rows(plain)


def test_hot_keys_only_are_chunked(spark):
    kinds = []

    def body(df, scan):
        kinds.append(type(scan))
        return scan(df, before=previous(F.col("v")))

    split_by_heat(sample(spark), ["key"], ["at"], body, hot_key_rows=1000)
    assert kinds == [Scan, ChunkedScan]
    kinds.clear()
    split_by_heat(sample(spark), ["key"], ["at"], body, hot_key_rows=2500)
    assert kinds == [Scan]


@pytest.mark.parametrize("length, hot", [(1, None), (7, None), (50, None), (7, 300), (50, 300)])
def test_trailing_moments_equal_those_of_every_frame(spark, length, hot):
    df = sample(spark, 1_500).withColumn("v", F.col("v") + 1e7)

    def body(frame, scan):
        return trailing_moments(frame, scan, "v", length)

    got = split_by_heat(df, ["key"], ["at"], body, hot_key_rows=hot, chunk_rows=100).collect()
    series = {}
    for r in df.collect():
        series.setdefault(r.key, []).append((r["at"], r.v))
    expected = {}
    for key, own in series.items():
        own.sort()
        for i, (at, _) in enumerate(own):
            frame = [v for _, v in own[max(0, i - length) : i] if v is not None]
            mean = sum(frame) / len(frame) if frame else None
            expected[key, at] = (len(frame), mean, sum((v - mean) ** 2 for v in frame) if frame else None)
    assert len(got) == len(expected) == 1_500
    for r in got:
        n, mean, m2 = expected[r.key, r["at"]]
        assert r.trailing_count == n
        if not n:
            assert r.trailing_mean is None and r.trailing_m2 is None
        else:
            assert r.trailing_mean == pytest.approx(mean, rel=1e-12)
            assert r.trailing_m2 == pytest.approx(m2, rel=1e-9, abs=1e-6)


def test_only_rows_of_full_hashes_are_counted_by_key(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("k"))
    assert ordered.may_be_hot(rows, ["k"], 1_000) is None
    suspects = ordered.may_be_hot(rows, ["k"], 50)
    assert suspects.where("k = -1").count() == 100 and suspects.count() < 200
    assert [r.k for r in ordered.hot_keys(suspects, ["k"], 50).collect()] == [-1]
