"""Ordered per-key computations that stay parallel when one key holds a large share of the rows.

A window partitioned by key sorts each key inside one task. That is the best plan while keys are
small, and the wrong one for a key with billions of versions. `split_by_heat` runs the same code
over both kinds of key:

* ordinary keys take the plain window: one exchange, one sort;
* keys above `hot_key_rows` are range-partitioned on (key, order) into chunks of similar size.
  Each chunk is scanned on its own; one summary row per (key, chunk) carries the last value, first
  value, running sum and running maximum across chunk borders. The result is the same.

Chunk numbers come from a range partitioning, whose sampled bounds may differ between executions,
so the chunked rows are checkpointed before anything is derived from the numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators.frames import broadcast_if_small, null_safe_join
from hindcast.session import cut_lineage

HOT_KEY_ROWS = 2_000_000
CHUNK_ROWS = 500_000
# Rows are counted by so many hashes of the key before any key is counted.
KEY_HASHES = 16_384

_CHUNK = "__chunk"


@dataclass(frozen=True)
class Step:
    """One output column of a scan over the rows of a key in order."""

    kind: str
    column: Column


def previous(column: Column) -> Step:
    """Value on the row before; NULL on the first row."""
    return Step("previous", column)


def following(column: Column) -> Step:
    """Value on the row after; NULL on the last row."""
    return Step("following", column)


def running_sum(column: Column) -> Step:
    """Sum up to and including the row."""
    return Step("running_sum", column)


def running_max(column: Column) -> Step:
    """Maximum up to and including the row."""
    return Step("running_max", column)


def earlier_max(column: Column) -> Step:
    """Maximum over the rows strictly before; NULL on the first row."""
    return Step("earlier_max", column)


def _over(step: Step, value: Column, window) -> Column:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    match step.kind:
        case "previous":
            return F.lag(value).over(window)
        case "following":
            return F.lead(value).over(window)
        case "running_sum":
            return F.sum(value).over(upto)
        case "running_max":
            return F.max(value).over(upto)
        case "earlier_max":
            return F.max(value).over(before)
    raise ValueError(f"unknown step {step.kind!r}")


class Scan:
    """Applies steps with a plain window over the keys."""

    def __init__(self, keys: Sequence[str], order: Sequence[str]) -> None:
        self.keys = list(keys)
        self.order = list(order)

    def __call__(self, df: DataFrame, **steps: Step) -> DataFrame:
        window = Window.partitionBy(*self.keys).orderBy(*self.order)
        return df.withColumns(
            {name: _over(step, step.column, window) for name, step in steps.items()}
        )


    def back(self, df: DataFrame, block: str, place: str, rows: int, column: str) -> DataFrame:
        """`column` replaced by its value `rows` rows before; `block` and `place` number the rows."""
        window = Window.partitionBy(*self.keys).orderBy(block, place)
        return df.withColumn(column, F.lag(column, rows).over(window))


class ChunkedScan(Scan):
    """Applies steps chunk by chunk and carries a summary row over each chunk border."""

    def __call__(self, df: DataFrame, **steps: Step) -> DataFrame:
        grain = [*self.keys, _CHUNK]
        order = F.struct(*self.order)
        rows = cut_lineage(
            df.withColumns({f"__in_{name}": step.column for name, step in steps.items()})
        )

        def inputs(name: str) -> Column:
            return F.col(f"__in_{name}")

        summarise = {
            # Wrapped in a struct, as a NULL value at the border is a value and not an absent row.
            "previous": lambda value: F.max_by(F.struct(value.alias("v")), order),
            "following": lambda value: F.min_by(F.struct(value.alias("v")), order),
            "running_sum": F.sum,
            "running_max": F.max,
            "earlier_max": F.max,
        }
        summary = rows.groupBy(*grain).agg(
            *[
                summarise[step.kind](inputs(name)).alias(f"__chunk_{name}")
                for name, step in steps.items()
            ]
        )
        # One row per (key, chunk); a key has at most as many chunks as the range partitioning.
        chunks = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
        carried_in = {
            "previous": lambda value: F.lag(value).over(chunks)["v"],
            "following": lambda value: F.lead(value).over(chunks)["v"],
            "running_sum": lambda value: F.sum(value).over(earlier),
            "running_max": lambda value: F.max(value).over(earlier),
            "earlier_max": lambda value: F.max(value).over(earlier),
        }
        carry = summary.select(
            *grain,
            *[
                carried_in[step.kind](F.col(f"__chunk_{name}")).alias(f"__carry_{name}")
                for name, step in steps.items()
            ],
        )

        inside = Window.partitionBy(*grain).orderBy(*self.order)
        scanned = rows.withColumns(
            {
                **{f"__in_chunk_{name}": _over(step, inputs(name), inside)
                   for name, step in steps.items()},
                "__first": F.lag(F.lit(True)).over(inside).isNull(),
                "__last": F.lead(F.lit(True)).over(inside).isNull(),
            }
        )
        joined = null_safe_join(scanned, carry, grain, "left")

        def combined(name: str, step: Step) -> Column:
            local, carry_in = F.col(f"__in_chunk_{name}"), F.col(f"__carry_{name}")
            match step.kind:
                case "previous":
                    return F.when(F.col("__first"), carry_in).otherwise(local)
                case "following":
                    return F.when(F.col("__last"), carry_in).otherwise(local)
                case "running_sum":
                    return F.coalesce(local + carry_in, local, carry_in)
                case _:
                    return F.greatest(local, carry_in)

        return joined.select(
            *[F.col(name) for name in df.columns if name not in steps],
            *[combined(name, step).alias(name) for name, step in steps.items()],
        )


    def back(self, df: DataFrame, block: str, place: str, rows: int, column: str) -> DataFrame:
        """The row before lies at the same place of the block before: an equi-join, no ordering."""
        stored = cut_lineage(df)
        earlier = stored.select(*self.keys, (F.col(block) + 1).alias(block), place, column)
        return null_safe_join(stored.drop(column), earlier, [*self.keys, block, place], "left")


def trailing_moments(df: DataFrame, scan: Scan, value: str, rows: int, prefix: str = "trailing") -> DataFrame:
    """`df` with count, mean and m2 (sum of squared deviations) of `value` over the `rows` rows before.

    A key's rows are cut into blocks of `rows`. The frame of the row at place p of a block is the end of
    the block before from place p on, and the block's own rows before p. Both parts are running
    aggregates, one in order and one against it, and moments of parts can be merged. So a row costs a
    few operations whatever the frame's length, groups have `rows` rows whatever a key's share, and no
    difference of large sums is taken, which would cancel.

    NULL values fill a place in the frame but don't count. Rows are in the scan's order.
    """
    block, place, ending = "__block", "__place", "__ending"
    numbered = scan(df, __number=running_sum(F.lit(1).cast("bigint"))).withColumns(
        {block: F.expr(f"(__number - 1) div {int(rows)}"), place: F.expr(f"(__number - 1) % {int(rows)}")}
    ).drop("__number")

    def moments(window) -> Column:
        count = F.count(value).over(window)
        return F.struct(
            count.alias("n"),
            F.coalesce(F.avg(value).over(window), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop(value).over(window) * count, F.lit(0.0)).alias("m2"),
        )

    inside = Window.partitionBy(*scan.keys, block)
    upto_end = inside.orderBy(F.col(place).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    shifted = scan.back(numbered.withColumn(ending, moments(upto_end)), block, place, rows, ending)
    both = shifted.withColumn("__own", moments(before))
    n, own_n = F.coalesce(F.col(f"{ending}.n"), F.lit(0)), F.col("__own.n")
    total = n + own_n
    apart = F.col("__own.mean") - F.col(f"{ending}.mean")
    mean = F.when(n == 0, F.col("__own.mean")).when(own_n == 0, F.col(f"{ending}.mean")).otherwise(
        F.col(f"{ending}.mean") + apart * own_n / total
    )
    m2 = F.when(n == 0, F.col("__own.m2")).when(own_n == 0, F.col(f"{ending}.m2")).otherwise(
        F.col(f"{ending}.m2") + F.col("__own.m2") + apart * apart * n * own_n / total
    )
    return both.withColumns(
        {
            f"{prefix}_count": total,
            f"{prefix}_mean": F.when(total > 0, mean),
            f"{prefix}_m2": F.when(total > 0, m2),
        }
    ).drop(block, place, ending, "__own")


Body = Callable[[DataFrame, Scan], DataFrame]
Reduce = Callable[[DataFrame], DataFrame]


def may_be_hot(df: DataFrame, keys: Sequence[str], hot_key_rows: int) -> DataFrame | None:
    """The rows whose key shares its hash with more than `hot_key_rows` rows, None if there are none.

    Counts by hash are few, so they are combined before the shuffle, which counts of keys are not.
    """
    key_hash = F.pmod(F.xxhash64(*keys), F.lit(KEY_HASHES)).cast("int")
    counts = df.groupBy(key_hash.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # At most KEY_HASHES numbers.
    full = [row.h for row in counts.where(F.col("n") > hot_key_rows).select("h").collect()]
    if not full:
        return None
    return df.where(key_hash.isin(full)) if len(full) < KEY_HASHES // 16 else df


def hot_keys(df: DataFrame, keys: Sequence[str], hot_key_rows: int) -> DataFrame:
    """Keys with more than `hot_key_rows` rows, with their row count `n`."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_key_rows)
    )


def split_by_heat(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    body: Body,
    *,
    reduce_cold: Reduce = lambda rows: rows,
    reduce_hot: Reduce = lambda rows: rows,
    total: DataFrame | None = None,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """`body(rows, scan)` over every key, with hot keys scanned in chunks.

    `order` must order the reduced rows of a key totally. The reductions run first: `reduce_cold`
    may keep a key in one task, `reduce_hot` must combine before it shuffles.

    Looking for hot keys costs little where there can be none: `total`, a table with at least as
    many rows as `df` (its input, say), is counted first, which Parquet answers from its footers.
    Only when it exceeds `hot_key_rows` are rows counted by a hash of the key, and by key where a hash
    has too many. `hot_key_rows=None` skips all that, for keys whose size is known to be bounded.
    """

    def ordinary(rows: DataFrame) -> DataFrame:
        return body(reduce_cold(rows), Scan(keys, order))

    if hot_key_rows is None or (df if total is None else total).count() <= hot_key_rows:
        return ordinary(df)
    suspects = may_be_hot(df, keys, hot_key_rows)
    if suspects is None:
        return ordinary(df)
    hot = cut_lineage(hot_keys(suspects, keys, hot_key_rows))
    n_keys, n_rows = hot.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_keys:
        return ordinary(df)

    hot = broadcast_if_small(hot.select(*keys), n_keys)
    cold = ordinary(null_safe_join(df, hot, keys, "left_anti"))
    chunked = (
        reduce_hot(null_safe_join(df, hot, keys, "left_semi"))
        .repartitionByRange(max(2, math.ceil(n_rows / chunk_rows)), *keys, *order)
        .withColumn(_CHUNK, F.spark_partition_id())
    )
    scanned = body(cut_lineage(chunked), ChunkedScan(keys, order))
    return cold.unionByName(scanned.select(*cold.columns))
