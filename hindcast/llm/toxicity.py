"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its character n-grams (SIZES, lower case, white space as one blank), hashed.
Each n-gram's log-count ratio says how much more often toxic training documents have it. The
FEATURES n-grams that tell the classes apart best are kept, scaled by their ratio, and a logistic
regression is trained on them.

Learning uses about LEARNED_ROWS labelled rows, chosen by a hash of the id, and never more than about
twice as many, however many texts an id has; scoring reads whole texts of all documents. NULL counts as empty and gets the score of a text without features.
Without training rows of both classes every score is near 1 or near 0, as the only class says (near
0 without any row).
Equal texts of different ids count as often as they occur; repeated rows and repeated labels once.
Features that tell the classes apart equally well are taken in order of their hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.session import cut_lineage

SIZES = (4, 5, 6)
BUCKETS = 1 << 22
FEATURES = 4_096
LEARNED_ROWS = 8_000
SMOOTHING = 1.0
PENALTY = 1e-3
STEPS = 300
CHUNK = 32_768

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str | None) -> np.ndarray:
    """Code points of a text in lower case, white space as one blank, with a blank before and after."""
    # split() takes the same characters for white space as \s of a regular expression.
    spaced = " ".join((text or "").lower().split())
    return np.frombuffer(f" {spaced} ".encode("utf-32-le", "replace"), dtype="<u4")


def _hashed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets of the n-grams that begin at each place of `codes`)."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _FACTOR
    mixed ^= mixed >> np.uint64(29)
    for n in SIZES:
        places = max(0, len(codes) - n + 1)
        value = np.full(places, n, dtype=np.uint64)
        for k in range(n):
            value ^= mixed[k : places + k]
            value *= _FACTOR
            value ^= value >> np.uint64(32)
        # The remainder by BUCKETS, a power of two.
        yield n, (value & np.uint64(BUCKETS - 1)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    codes = _codes(text)
    found = np.zeros(0, dtype=np.int32)
    for at in range(0, len(codes), CHUNK):
        parts = [part for _, part in _hashed(codes[at : at + CHUNK + max(SIZES) - 1])]
        found = np.union1d(found, np.concatenate(parts))
    return found


def _grouped(texts: Iterable[str | None]) -> Iterator[list[np.ndarray]]:
    """The texts' code points in lists of at most CHUNK together, a longer text alone."""
    group, size = [], 0
    for codes in map(_codes, texts):
        if group and size + len(codes) > CHUNK:
            yield group
            group, size = [], 0
        group.append(codes)
        size += len(codes)
    if group:
        yield group


def kept_features(texts: Iterable[str | None], wanted: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct features of each text, by `wanted` (bucket -> feature or -1).

    Short texts are hashed together, as each call of numpy costs as much as some thousand characters.
    """
    for group in _grouped(texts):
        joined = np.concatenate(group)
        ends = np.cumsum([len(codes) for codes in group])
        has = np.zeros((len(group), FEATURES), dtype=bool)
        for at in range(0, len(joined), CHUNK):
            for n, buckets in _hashed(joined[at : at + CHUNK + max(SIZES) - 1]):
                found = wanted.take(buckets, mode="clip")
                kept = np.flatnonzero(found >= 0)
                own = np.searchsorted(ends, kept + at, side="right")
                # Without the n-grams that reach into the next text.
                inside = kept + at + n <= ends[own]
                has[own[inside], found[kept[inside]]] = True
        for own in has:
            yield np.flatnonzero(own).astype(np.int32)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def lookup(self) -> np.ndarray:
        # Features fit into two bytes; a small table keeps more of itself in the processor's cache.
        table = np.full(BUCKETS, -1, dtype=np.int16)
        table[self.buckets] = np.arange(len(self.buckets), dtype=np.int16)
        return table

    def score(self, own: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.weights[own].sum() + self.bias, -60.0, 60.0))))


def _trained(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the (unscaled) features and bias: accelerated gradient descent, classes balanced."""
    sizes = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), sizes)
    columns = np.concatenate(rows).astype(np.int64)
    values = ratios[columns]
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
    length = np.sqrt(max(1.0, float(np.bincount(at, values**2, len(rows)).max())))
    values = values / length
    w, b = np.zeros(len(ratios)), 0.0
    ahead_w, ahead_b, step = w, b, 2.0
    for k in range(STEPS):
        margin = np.bincount(at, values * ahead_w[columns], len(rows)) + ahead_b
        slope = cost * (1.0 / (1.0 + np.exp(-np.clip(margin, -60, 60))) - labels)
        grad = np.bincount(columns, values * slope[at], len(ratios)) + PENALTY / length * ahead_w
        next_w, next_b = ahead_w - step * grad, ahead_b - step * slope.sum()
        push = k / (k + 3.0)
        ahead_w, ahead_b = next_w + push * (next_w - w), next_b + push * (next_b - b)
        w, b = next_w, next_b
    return w * ratios / length, float(b)


def sampled(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """(t, y): texts and labels to learn from, about LEARNED_ROWS of distinct ids.

    Repeated rows count once. An id may have any number of texts: more than twice LEARNED_ROWS are
    thinned out by another draw, on id and text.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    usable = usable.select(key, F.col(label).cast("int").alias("y")).distinct()
    total = usable.count()
    draw = F.xxhash64(key, F.lit(2)).bitwiseAND(2**31 - 1) / 2.0**31
    # About LEARNED_ROWS rows of 12 bytes, whatever the size of the tables.
    ids = F.broadcast(usable.where(draw < LEARNED_ROWS / max(total, 1)))
    drawn = docs.select(key, F.col(text).alias("t")).join(ids, key)
    drawn = cut_lineage(drawn.select(F.col(key).alias("k"), "t", "y").distinct())
    most = 2 * LEARNED_ROWS
    again = F.xxhash64("k", "t", F.lit(3)).bitwiseAND(2**31 - 1) / 2.0**31
    return drawn.where(again < most / max(drawn.count(), most)).select("t", "y")


def fitted(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """The model learned from the rows of `docs` whose key has a label 0 or 1 in `labels`.

    The driver holds the kept features' counts and the sampled rows as lists of kept features:
    at most some 2 x LEARNED_ROWS lists of at most 4 x FEATURES bytes.
    """
    sample = sampled(docs, labels, key, text, label)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, BUCKETS), dtype=np.int32)
        for batch in batches:
            for own, y in zip(batch["t"], batch["y"], strict=True):
                totals[y, features(own)] += 1
        found = np.flatnonzero(totals.any(0))
        yield pd.DataFrame({"bucket": found, "n0": totals[0, found], "n1": totals[1, found]})

    sizes = {row["y"]: row["count"] for row in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        odds = 30.0 if n1 else -30.0
        return Model(np.zeros(0, np.int64), np.zeros(0), odds)
    counts = sample.mapInPandas(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    p1 = (F.col("n1") + SMOOTHING) / (n1 + 2 * SMOOTHING)
    p0 = (F.col("n0") + SMOOTHING) / (n0 + 2 * SMOOTHING)
    both = (F.col("n0") + F.col("n1") + 2 * SMOOTHING) / (n0 + n1 + 4 * SMOOTHING)
    apart = F.abs(p1 - p0) / F.sqrt(both * (1 - both))
    kept = (
        counts.where("n0 + n1 >= 3")
        .select("bucket", F.log(p1 / p0).alias("ratio"), apart.alias("apart"))
        .orderBy(F.desc("apart"), "bucket")
        .limit(FEATURES)
        .toPandas()
    )
    buckets, ratios = kept["bucket"].to_numpy(), kept["ratio"].to_numpy()
    model = Model(buckets, np.zeros(len(buckets)), 0.0)

    def own_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = model.lookup()
        for batch in batches:
            yield pd.DataFrame(
                {"y": batch["y"], "own": [own.tobytes() for own in kept_features(batch["t"], table)]}
            )

    learned = sample.mapInPandas(own_features, "y int, own binary").toPandas()
    # A fixed order, so that sums and the model don't depend on how rows were dealt out.
    learned = learned.sort_values(["y", "own"])
    rows = [np.frombuffer(own, dtype=np.int32) for own in learned["own"]]
    weights, bias = _trained(rows, learned["y"].to_numpy().astype(float), ratios)
    return Model(buckets, weights, bias)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        table = own.lookup()
        for texts in batches:
            yield pd.Series([own.score(found) for found in kept_features(texts, table)], dtype="float64")

    return docs.withColumn("score", judge(F.coalesce(F.col(text), F.lit("")))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
