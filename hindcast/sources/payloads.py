"""The append-only payload log: landing, lookups and shape checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions.scalar import require, stable_id
from hindcast.operators.frames import broadcast_if_small, null_safe_join
from hindcast.session import cut_lineage

PRICE_ENDPOINTS = ["history", "prices"]
OK = 200
# Ids and instants of eight bytes each: some tens of megabytes as a hashed relation.
BROADCAST_IDS = 1_000_000


def ticker_of(params: str = "request_params") -> Column:
    return F.col(params)["ticker"]


def identified(fetched: DataFrame, run_id: str) -> DataFrame:
    """Rows to append to the payload log for a batch of responses, changed or not.

    One projection, so bodies are hashed where they are and never shuffled. A response without a
    body fails the job: it must not vanish.
    """
    present = require(F.col("body").isNotNull(), F.col("body"), F.lit("a response has no body"))
    hashed = fetched.withColumn("body", present).withColumn("content_sha256", F.sha2("body", 256))
    identity = stable_id(
        "source",
        "endpoint",
        F.array_sort(F.map_entries("request_params")),
        "fetched_at",
        "content_sha256",
    )
    rows = hashed.withColumn("payload_id", identity).withColumn("run_id", F.lit(run_id))
    return rows.select(*schemas.PAYLOAD.fieldNames())


def mark_seen(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Adds `content_unchanged` to a batch, given the log before it.

    It tells whether the same body had already landed from that source, in the log or earlier in
    the batch. Only source, hash, time and id are needed: give rows without their bodies.
    """
    content = ["source", "content_sha256"]
    first = rows.groupBy(*content).agg(
        F.min(F.struct("fetched_at", "payload_id")).alias("__first")
    )
    # Only hashes of the batch matter: as the smaller side they prune the log while it is read.
    landed = (
        log.select(*content)
        .join(first.select(*content), content, "left_semi")
        .distinct()
        .withColumn("__landed", F.lit(True))
    )
    known = first.join(landed, content, "left")
    return (
        rows.join(known, content)
        .withColumn(
            "content_unchanged",
            F.col("__landed").isNotNull() | (F.col("__first.payload_id") != F.col("payload_id")),
        )
        .drop("__first", "__landed")
    )


def latest(payload: DataFrame, by: Iterable[str | Column], *, ok_only: bool = True) -> DataFrame:
    """The most recent payload per group, ties going to the higher payload id.

    Winners are found on the narrow columns, pre-aggregated, and stored as a list of ids. The list
    is broadcast up to a fixed length, so that bodies are filtered where they are read and never
    shuffled. A longer list is joined like any other table. `ok_only=False` lets an error response
    be the latest.
    """
    rows = payload.where(F.col("http_status") == OK) if ok_only else payload
    newest = rows.groupBy(*by).agg(F.max(F.struct("fetched_at", "payload_id")).alias("__newest"))
    # The instant goes with the id, so that ids that agree by chance don't let an older payload through.
    winners = cut_lineage(newest.select("__newest.fetched_at", "__newest.payload_id"))
    return null_safe_join(
        rows, broadcast_if_small(winners, winners.count(), BROADCAST_IDS), ["payload_id", "fetched_at"], "left_semi"
    )


def price_payloads(payload: DataFrame, source: str) -> DataFrame:
    """Successful price responses of a source, for every ticker named in the request."""
    return payload.where(
        (F.col("source") == source)
        & F.col("endpoint").isin(PRICE_ENDPOINTS)
        & (F.col("http_status") == OK)
        & ticker_of().isNotNull()
    )


def tickers_in_log(payload: DataFrame) -> DataFrame:
    """Distinct (source, ticker) with a price payload, whatever its status."""
    return (
        payload.where(F.col("endpoint").isin(PRICE_ENDPOINTS))
        .select("source", ticker_of().alias("ticker"))
        .where(F.col("ticker").isNotNull())
        .distinct()
    )


def missing_keys(required: Sequence[str], present: Column) -> Column:
    """Required keys that a document lacks, in the order of their names."""
    return F.array_except(F.lit(sorted(required)), present)


def checked_shape(body: Column, element: Column, required: Sequence[str], what: str) -> Column:
    """`body`, or a failed job where the JSON `element` lacks a required key.

    An absent element, as in an empty list, passes.
    """
    missing = missing_keys(required, F.json_object_keys(element))
    message = F.concat(
        F.lit(f"{what} lacks keys it always had: "), F.array_join(missing, ", ")
    )
    return require(element.isNull() | (F.size(missing) == 0), body, message)


def shape_drift(payload: DataFrame, element: Column, required: Sequence[str]) -> DataFrame:
    """Payloads whose JSON `element` lacks required keys, with the keys missing."""
    return (
        payload.withColumn("missing", missing_keys(required, F.json_object_keys(element)))
        .where(F.size("missing") > 0)
        .select("payload_id", "missing")
    )
