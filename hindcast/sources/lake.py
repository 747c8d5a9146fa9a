"""Where the tables live: an append-only log, and snapshots that are replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


PUBLISHED = "_PUBLISHED"
MEMBER = "_MEMBER-"
GROUPS = "_groups"
# Hex digests, numbers and bodies take about half the bytes that the default codec leaves.
CODEC = "zstd"


class Lake:
    """Parquet tables under one root folder, named like `core.price_fact`.

    Replacing a table stages a new version folder next to the old one and then publishes it: an
    empty marker file, put there last. Readers take the newest version that has it. So a table can
    be rebuilt from itself, a failed write changes nothing, and a staged version can be checked and
    given up while readers keep the old one. Versions of several tables may be published together:
    each names a group, and the group's file, put down last, publishes them all. A table has one
    writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def _found(self, pattern: str) -> list:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [status.getPath() for status in fs.globStatus(path) or []]

    def _versions(self, table: str) -> list[str]:
        versions = f"{self.path(table)}/version=*"
        alone = [str(path.getParent().toString()) for path in self._found(f"{versions}/{PUBLISHED}")]
        members = self._found(f"{versions}/{MEMBER}*")
        groups = {path.getName() for path in self._found(f"{self.root}/{GROUPS}/*")} if members else set()
        together = [str(p.getParent().toString()) for p in members if p.getName()[len(MEMBER):] in groups]
        return sorted({*alone, *together})

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The newest snapshot, or an empty table."""
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(versions[-1])

    def holds(self, table: str) -> bool:
        """Whether any snapshot has been published."""
        return bool(self._versions(table))

    def stage(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> str:
        """Write a version that no reader sees yet; returns its path."""
        versions = self._versions(table)
        last = int(versions[-1].rsplit("version=", 1)[1].split("-")[0]) if versions else 0
        target = f"{self.path(table)}/version={last + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy(*partition_by).parquet(target, compression=CODEC)
        return target

    def _mark(self, file: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(file)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.create(path, False).close()

    def publish(self, *staged: str) -> None:
        """Make staged versions the current ones, all of them by one file if they are several."""
        if len(staged) == 1:
            self._mark(f"{staged[0]}/{PUBLISHED}")
            return
        group = uuid.uuid4().hex
        for version in staged:
            self._mark(f"{version}/{MEMBER}{group}")
        self._mark(f"{self.root}/{GROUPS}/{group}")

    def discard(self, staged: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def replace(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        self.publish(self.stage(table, rows, partition_by))

    def drop_old_versions(self, table: str, keep: int = 2) -> int:
        """Delete all but the newest `keep` complete snapshots; returns how many went.

        Queries still reading an older one fail, so call it when none is running.
        """
        if keep < 1:
            raise ValueError("at least the newest snapshot has to stay")
        jvm = self.spark._jvm
        old = self._versions(table)[:-keep]
        for version in old:
            path = jvm.org.apache.hadoop.fs.Path(version)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(old)

    def append(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        rows.write.mode("append").partitionBy(*partition_by).parquet(f"{self.path(table)}/log", compression=CODEC)

    def read_log(self, table: str, schema: T.StructType) -> DataFrame:
        """Everything ever appended, or an empty table."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/log")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(folder.toString())
        return rows.select(*schema.fieldNames())
