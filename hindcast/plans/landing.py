"""Landings that are seen whole or not at all, and whose cost doesn't grow with the log.

A landing writes four things to folders of its own: the payloads, a flag for each, the hashes of bodies
that were new, dealt to prefixes of the hash, and the newest payloads of the requests it names. Then one
small table that lists the folders in use is replaced, so a reader or a retry after a crash finds all of
a landing or none of it.

Only the prefixes of the batch's own hashes are read to tell which bodies were seen, and only the buckets
of its own requests to bring the newest payloads up to date. The newest payload of a request is told by a
maximum of structs, which needs no order of arrival: a response that lands late replaces nothing newer.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schemas
from hindcast.operators.frames import broadcast_if_small, null_safe_join
from hindcast.plans.lineage import tracked_run
from hindcast.session import cut_lineage
from hindcast.sources import payloads
from hindcast.sources.lake import Lake

LANDED = "raw.landed"
# One row per folder in use: a landing's payloads and flags (part: the run), its new hashes (part: a
# prefix) and the newest payloads of a bucket of requests (part: the bucket, one folder each).
FOLDERS = schemas.table("kind string, part string, folder string, run_id string, batch string")
PREFIX_DIGITS = 2
BUCKETS = 64

REQUEST = ["source", "endpoint", "ticker", "cik"]
_NEWEST = "struct<fetched_at: timestamp, payload_id: bigint, run_id: string>"
_HASHES = T.StructType([*schemas.table("source string, content_sha256 string").fields])
_FLAGS = T.StructType(
    [*schemas.table("source string, payload_id bigint").fields,
     T.StructField("content_unchanged", T.BooleanType()), T.StructField("run_id", T.StringType())]
)
_STATE = T.StructType(
    [*[T.StructField(name, T.StringType()) for name in REQUEST],
     *[T.StructField(name, T.StructType([
         T.StructField("fetched_at", T.TimestampType()), T.StructField("payload_id", T.LongType()),
         T.StructField("run_id", T.StringType())])) for name in ("newest", "newest_ok")]]
)


class Landings:
    """The payload log of `lake` as a list of landings. It has one writer at a time.

    Hashes are dealt to 16 ** `prefix_digits` prefixes and requests to `buckets`. Both are fixed when a log
    is begun: at the defaults, 10^10 bodies are some 4 GB of hashes a prefix, and 10^8 requests 100 MB a
    bucket.
    """

    def __init__(self, lake: Lake, prefix_digits: int = PREFIX_DIGITS, buckets: int = BUCKETS) -> None:
        self.lake, self.prefix_digits, self.buckets = lake, prefix_digits, buckets
        self._root = f"{lake.path(LANDED)}/data"

    def _prefix(self) -> Column:
        return F.substring("content_sha256", 1, self.prefix_digits)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*REQUEST), F.lit(self.buckets)).cast("string")

    def folders(self, kind: str | None = None, parts: Sequence[str] | None = None) -> list:
        """Rows of FOLDERS: three per landing and up to one per prefix, so some hundreds each."""
        rows = self.lake.read(f"{LANDED}.folders", FOLDERS)
        if kind is not None:
            rows = rows.where(F.col("kind") == kind)
        if parts is not None:
            rows = rows.where(F.col("part").isin(list(parts)))
        return rows.collect()

    def _read(self, kind: str, schema: T.StructType, parts: Sequence[str] | None = None) -> DataFrame:
        folders = [row.folder for row in self.folders(kind, parts)]
        if not folders:
            return self.lake.spark.createDataFrame([], schema)
        return self.lake.spark.read.schema(schema).parquet(*folders)

    def payloads(self, runs: Sequence[str] | None = None) -> DataFrame:
        """Everything landed, or what some landings brought."""
        return self._read("payload", schemas.PAYLOAD, runs)

    def flags(self) -> DataFrame:
        """(source, payload_id, content_unchanged, run_id) of everything landed."""
        return self._read("flag", _FLAGS)

    def hashes(self, prefixes: Sequence[str] | None = None) -> DataFrame:
        """(source, content_sha256) of the bodies landed, each once, or those of some prefixes."""
        return self._read("hash", _HASHES, prefixes)

    def newest(self, buckets: Sequence[str] | None = None) -> DataFrame:
        """The newest payload, and the newest with status 200, of every request landed."""
        return self._read("newest", _STATE, buckets)

    def land(self, fetched: DataFrame, source: str, batch: str | None = None) -> str | None:
        """Add a batch of responses of one source; returns the id of its run.

        A `batch` that has landed does nothing and returns None, so a caller may retry one whose end it
        didn't see. A body counts as seen if it landed before from that source or comes earlier in the
        batch, by fetch time.
        """
        before = self.folders()
        if batch is not None and any(row.batch == batch for row in before):
            return None
        with tracked_run(self.lake, f"ingest:{source}") as run:
            here = f"{self._root}/{uuid.uuid4().hex}"
            rows = payloads.identified(run.reading(fetched.withColumn("source", F.lit(source))), run.run_id)
            run.counting(rows).write.parquet(f"{here}/payload")
            landed = self.lake.spark.read.schema(schemas.PAYLOAD).parquet(f"{here}/payload")

            narrow = landed.select("source", "content_sha256", "fetched_at", "payload_id")
            # At most 16 ** prefix_digits values.
            prefixes = [row[0] for row in narrow.select(self._prefix()).distinct().collect()]
            earlier = self.hashes(prefixes)
            flagged = payloads.mark_seen(narrow, earlier).withColumn("run_id", F.lit(run.run_id))
            flagged.select(*_FLAGS.fieldNames()).write.parquet(f"{here}/flag")
            self._write_hashes(narrow, earlier, f"{here}/hash")
            buckets = self._write_newest(landed, f"{here}/newest")

            added = [("payload", run.run_id), ("flag", run.run_id)]
            content = [(kind, part, f"{here}/{kind}") for kind, part in added]
            content += [("hash", p, f"{here}/hash/prefix={p}") for p in self._parts(f"{here}/hash", "prefix")]
            content += [("newest", b, f"{here}/newest/bucket={b}") for b in buckets]
            kept = [tuple(row) for row in before if row.kind != "newest" or row.part not in set(buckets)]
            self._publish([*kept, *[(*row, run.run_id, batch) for row in content]])
            return run.run_id

    def _write_hashes(self, batch: DataFrame, earlier: DataFrame, folder: str) -> None:
        content = ["source", "content_sha256"]
        fresh = batch.select(*content).distinct().join(earlier, content, "left_anti")
        dealt = fresh.withColumn("prefix", self._prefix()).hint("rebalance", "prefix")
        dealt.sortWithinPartitions("prefix", "content_sha256").write.partitionBy("prefix").parquet(folder)

    def _write_newest(self, landed: DataFrame, folder: str) -> list[str]:
        """The buckets of the batch's requests with its payloads merged in; returns which they are."""
        this = F.struct("fetched_at", "payload_id", "run_id").cast(_NEWEST)
        state = landed.select(
            "source", "endpoint", payloads.ticker_of().alias("ticker"), F.col("request_params")["cik"].alias("cik"),
            this.alias("newest"), F.when(F.col("http_status") == payloads.OK, this).alias("newest_ok"),
        )
        # Combined before the shuffle: a request repeated any number of times is one row a task.
        fresh = cut_lineage(_merged(state, REQUEST).withColumn("bucket", self._bucket()))
        buckets = [row[0] for row in fresh.select("bucket").distinct().collect()]
        both = fresh.drop("bucket").unionByName(self.newest(buckets))
        merged = _merged(both, REQUEST).withColumn("bucket", self._bucket())
        merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        return buckets

    def _parts(self, folder: str, column: str) -> list[str]:
        """Values of the partition column of what was written: its folders, which are few."""
        jvm = self.lake.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{column}=*")
        fs = path.getFileSystem(self.lake.spark._jsc.hadoopConfiguration())
        return sorted(status.getPath().getName().split("=", 1)[1] for status in fs.globStatus(path) or [])

    def _publish(self, rows: list[tuple]) -> None:
        table = self.lake.spark.createDataFrame(rows, FOLDERS)
        self.lake.replace(f"{LANDED}.folders", table.coalesce(1))

    def compact_hashes(self) -> None:
        """Put the hashes of a prefix, one folder a landing, into one folder again.

        Lookups list as many folders as a prefix has had landings with new bodies, so this is worth doing
        every few hundred of them. Payloads, flags and readers are left alone.
        """
        before = self.folders()
        here = f"{self._root}/{uuid.uuid4().hex}/hash"
        dealt = self.hashes().withColumn("prefix", self._prefix()).hint("rebalance", "prefix")
        dealt.sortWithinPartitions("prefix", "content_sha256").write.partitionBy("prefix").parquet(here)
        kept = [tuple(row) for row in before if row.kind != "hash"]
        parts = [("hash", p, f"{here}/prefix={p}", None, None) for p in self._parts(here, "prefix")]
        self._publish([*kept, *parts])

    def latest_ids(self, by: Sequence[str], *, ok_only: bool = True, where: Column | None = None) -> DataFrame:
        """(by, payload_id, fetched_at, run_id) of the newest payload for each group of requests.

        `by` names some of REQUEST; requests that agree in them are one group. Only the maintained state
        is read, one row a request.
        """
        column = "newest_ok" if ok_only else "newest"
        state = self.newest() if where is None else self.newest().where(where)
        groups = state.groupBy(*by).agg(F.max(column).alias("best")).where(F.col("best").isNotNull())
        return groups.select(*by, "best.payload_id", "best.fetched_at", "best.run_id")

    def latest(self, by: Sequence[str], *, ok_only: bool = True, where: Column | None = None) -> DataFrame:
        """Those payloads with their bodies; only the landings that hold one are opened."""
        winners = cut_lineage(self.latest_ids(by, ok_only=ok_only, where=where).select("run_id", "payload_id"))
        # As many as there are landings at most.
        runs = [row[0] for row in winners.select("run_id").distinct().collect()]
        if not runs:
            return self.lake.spark.createDataFrame([], schemas.PAYLOAD)
        ids = broadcast_if_small(winners, winners.count(), payloads.BROADCAST_IDS)
        return null_safe_join(self.payloads(runs), ids, ["run_id", "payload_id"], "left_semi")


def _merged(state: DataFrame, by: Sequence[str]) -> DataFrame:
    return state.groupBy(*by).agg(F.max("newest").alias("newest"), F.max("newest_ok").alias("newest_ok"))
