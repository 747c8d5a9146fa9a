"""Session defaults and the one place that decides where checkpoints go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "hindcast", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Timestamps are compared as UTC instants, so the session time zone is pinned. Everything about
    cluster size (executors, memory, shuffle partitions) stays with spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that intermediate tables are written to.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, as in tests, may fall
    back to a temporary folder: on a cluster such a folder would not outlive its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder and read back.

    Like a reliable checkpoint it survives lost executors and fixes columns that another execution
    might compute differently. As a Parquet table it is computed once, and later reads are pruned
    to the columns they use.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
