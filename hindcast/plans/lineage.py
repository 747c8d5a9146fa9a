"""One row per run of a pipeline step: when, how it ended, rows in and out."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.sources.lake import Lake

RUNS = "ops.pipeline_run"


class Run:
    """Counters of a run. `counting` attaches a counter to the rows a step writes, `reading` to those
    it reads."""

    def __init__(self, run_id: str) -> None:
        self.run_id = run_id
        self.rows_in = 0
        self.rows_out = 0
        self._observed: list[Observation] = []
        self._read: list[Observation] = []

    def reading(self, df: DataFrame) -> DataFrame:
        """`df`, whose rows are counted as input by the one write that uses it."""
        observation = Observation()
        self._read.append(observation)
        return df.observe(observation, F.count(F.lit(1)).alias("rows"))

    def counting(self, df: DataFrame) -> DataFrame:
        """`df`, whose rows are counted as output while it is being written: no extra pass.

        It must be written before the run ends, as the run waits for the count.
        """
        observation = Observation()
        self._observed.append(observation)
        return df.observe(observation, F.count(F.lit(1)).alias("rows"))

    def settle(self) -> None:
        """Add the counts of everything that was written."""
        self.rows_out += sum(observation.get["rows"] for observation in self._observed)
        self.rows_in += sum(observation.get["rows"] for observation in self._read)
        self._observed, self._read = [], []


@contextmanager
def tracked_run(lake: Lake, pipeline: str) -> Iterator[Run]:
    """Record a run as running, then as success or failed; an error is recorded and raised again."""
    run = Run(uuid.uuid4().hex)
    started = dt.datetime.now(dt.UTC)

    def record(status: str, error: str | None = None) -> None:
        ended = None if status == "running" else dt.datetime.now(dt.UTC)
        row = (
            run.run_id, pipeline, started, ended, status,
            None if status == "running" else run.rows_in,
            None if status == "running" else run.rows_out,
            error,
        )
        lake.append(RUNS, lake.spark.createDataFrame([row], schemas.PIPELINE_RUN).coalesce(1))

    record("running")
    try:
        yield run
        run.settle()
    except Exception as error:
        record("failed", json.dumps({"type": type(error).__name__, "message": str(error)}))
        raise
    record("success")


def runs(lake: Lake) -> DataFrame:
    """The last recorded state of every run."""
    log = lake.read_log(RUNS, schemas.PIPELINE_RUN)
    rest = [name for name in log.columns if name != "run_id"]
    # A final state has an end; a running one sorts before it.
    last = F.max_by(F.struct(*rest), F.struct(F.col("ended_at").isNotNull(), "ended_at"))
    return log.groupBy("run_id").agg(last.alias("__r")).select("run_id", "__r.*")
