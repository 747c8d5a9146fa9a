"""Tables dealt to hash buckets of a key, of which a load replaces only the buckets it touched.

A load writes the new content of its buckets to a folder of its own, as ordinary partitioned Parquet:
`load=<id>/bucket=<b>/is_open=<true|false>`. Then a small table with one row per bucket, which says
where its current content lies, is replaced as a whole. So readers see all of a load or nothing of
it, a load that is given up leaves nothing visible, and files of other buckets stay as they are.

That table also holds the count of rows and keys and a digest of every bucket: two loads of the same
content are known to be equal without reading either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schemas
from hindcast.sources.lake import CODEC, Lake

CONTENT = schemas.table(
    "bucket int, folder string, rows bigint, keys bigint, digest bigint, batch bigint"
)


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


class BucketTable:
    """A versioned fact table in `lake`, in `buckets` buckets of the column `by`.

    `keys` is the natural key of a chain. Rows still believed lie apart from those that have ended,
    so a read of current versions never opens a file of history. The number of buckets is fixed when a
    table is first written: about 1 GB each at its largest. A table has one writer at a time.
    """

    def __init__(
        self, lake: Lake, table: str, schema: T.StructType, keys: Sequence[str], by: str, buckets: int
    ) -> None:
        self.lake, self.table, self.schema = lake, table, schema
        self.keys, self.by, self.buckets = list(keys), by, buckets
        self._data = f"{lake.path(table)}/data"

    def content(self) -> list:
        """Rows of CONTENT, at most one per bucket; empty buckets have none."""
        return self.lake.read(f"{self.table}.content", CONTENT).collect()

    def last_batch(self) -> int | None:
        """The number of the last batch published with one."""
        return max((row.batch for row in self.content() if row.batch is not None), default=None)

    def bucket(self) -> Column:
        return bucket_of(F.col(self.by), self.buckets)

    def at(self, folders: list[str]) -> DataFrame:
        """Rows below some folders of this table, with load, bucket and is_open."""
        spark = self.lake.spark
        if not folders:
            return spark.createDataFrame([], self.schema)
        extra = [T.StructField("load", T.StringType()), T.StructField("bucket", T.IntegerType()),
                 T.StructField("is_open", T.BooleanType())]
        rows = spark.read.schema(T.StructType([*self.schema.fields, *extra])).option("basePath", self._data)
        return rows.parquet(*folders)

    def read(self, buckets: Iterable[int] | None = None, *, current: bool = False) -> DataFrame:
        """All rows, or those of some buckets; `current` leaves the folders of ended rows out."""
        wanted = None if buckets is None else set(buckets)
        folders = [r.folder for r in self.content() if wanted is None or r.bucket in wanted]
        rows = self.at(folders)
        if current and folders:
            rows = rows.where("is_open")
        elif current:
            rows = rows.where(F.col("knowledge_to") == schemas.open_end())
        return rows.select(*self.schema.fieldNames())

    def stage(self, rows: DataFrame, layout: Sequence[str]) -> str:
        """Write rows that no reader sees yet, sorted by `layout` inside a file; returns their folder."""
        folder = f"{self._data}/load={uuid.uuid4().hex}"
        names = self.schema.fieldNames()
        dealt = rows.select(
            *names, self.bucket().alias("bucket"), (F.col("knowledge_to") == schemas.open_end()).alias("is_open")
        )
        # Rows of a bucket come together, so that it gets few files; adaptive execution splits large ones.
        (
            dealt.hint("rebalance", "bucket", "is_open")
            .sortWithinPartitions("bucket", "is_open", *layout)
            .write.partitionBy("bucket", "is_open")
            .parquet(folder, compression=CODEC)
        )
        return folder

    def staged(self, folder: str) -> DataFrame:
        return self.at([folder]).select(*self.schema.fieldNames())

    def summary(self, folder: str) -> list:
        """(bucket, folder, rows, keys, digest) of what was staged."""
        names = self.schema.fieldNames()
        # Rows of a key share a bucket, so first versions count the keys. XOR forgets pairs of equal
        # rows, which the row count and the unique versions of a fact table rule out.
        first = F.count_if(F.col("nth") == 1)
        rows = self.at([folder]).groupBy("bucket", *self.keys).agg(
            F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*names)).alias("digest")
        ).withColumn("nth", F.lit(1))
        per_bucket = rows.groupBy("bucket").agg(
            F.sum("rows").alias("rows"), first.alias("keys"), F.bit_xor("digest").alias("digest")
        )
        return [
            (r.bucket, f"{folder}/bucket={r.bucket}", r.rows, r.keys, r.digest) for r in per_bucket.collect()
        ]

    def publish(self, folder: str, touched: Iterable[int] | None, batch: int | None = None) -> list:
        """Make the staged rows the content of the `touched` buckets (None: of all); returns what changed.

        The result lists (bucket, old row or None, new row or None) of touched buckets whose content
        differs from before.
        """
        before = {r.bucket: r for r in self.content()}
        gone = set(before) if touched is None else set(touched)
        last = batch if batch is not None else max((r.batch for r in before.values() if r.batch is not None), default=None)
        fresh = {row[0]: row for row in self.summary(folder)}
        kept = [tuple(r)[:5] for b, r in before.items() if b not in gone and b not in fresh]
        content = [(*row, last) for row in [*kept, *fresh.values()]]
        self.lake.replace(f"{self.table}.content", self.lake.spark.createDataFrame(content, CONTENT).coalesce(1))
        return [
            (b, before.get(b), fresh.get(b))
            for b in sorted(gone | set(fresh))
            if b not in before or b not in fresh
            or (before[b].rows, before[b].keys, before[b].digest) != fresh[b][2:5]
        ]
