"""Shuffled shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 (hashed-key order), and the number goes through a keyed permutation of
0 to N-1: a Feistel network over the next even power of two, walked until it lands below N. The
permuted number p gives shard p mod S and slot p div S, so shards differ by one row at most, slots
have no gaps, and both can be computed for any row number, and inverted, without a table.

Rows that have an order already, such as that of a mix, keep it: `sharded_in_order` permutes inside
windows of consecutive rows only, each with keys of its own, so the first slots of all shards together
hold the first rows.

A NULL text has no bytes (size 16, crc of nothing). Repeated rows get numbers of their own. An empty
table gives an empty result. Added columns replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import numbered

SHARDS = 40
SEED = 20_240_917
ROUNDS = 6
OVERHEAD_BYTES = 16

_LOW = np.uint64(0xFFFFFFFF)


def half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [(seed * 2_654_435_761 + i * 2_246_822_519 + 97) % 2**32 for i in range(1, rounds + 1)]


def _mix(right: np.ndarray, key: int) -> np.ndarray:
    x = (right + np.uint64(key)) & _LOW
    x = (x * np.uint64(2_654_435_761)) & _LOW
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(2_246_822_519)) & _LOW
    return x ^ (x >> np.uint64(13))


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, applied to `numbers`."""
    half = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = round_keys(seed)

    def forward(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        return (left << half) | right

    def backward(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in reversed(keys):
            left, right = right ^ (_mix(left, key) & mask), left
        return (left << half) | right

    step = backward if inverse else forward
    out = step(np.asarray(numbers).astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def permuted_in_windows(numbers: np.ndarray, n: int, window: int, seed: int = SEED) -> np.ndarray:
    """0..n-1 permuted inside windows of `window` numbers, the last one shorter."""
    numbers = np.asarray(numbers).astype(np.int64)
    out = np.empty_like(numbers)
    which = numbers // window
    order = np.argsort(which, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
        if len(part):
            start = int(which[part[0]]) * window
            own = permuted(numbers[part] - start, min(window, n - start), seed + 1 + int(which[part[0]]))
            out[part] = start + own
    return out


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "size": F.octet_length(whole).cast("long") + OVERHEAD_BYTES,
            "text_crc32": F.crc32(F.encode(whole, "UTF-8")).cast("long"),
        }
    )


def sharded(
    docs: DataFrame, key: str = "doc_id", ties: list[str] | None = None,
    shards: int = SHARDS, seed: int = SEED,
) -> DataFrame:
    """`docs` with shard and slot. `ties` order rows of one key (see `numbered`)."""
    n = docs.count()

    @F.pandas_udf("long")
    def permute(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    return (
        numbered(docs, "_number", F.col(key), ties or [key])
        .withColumn("_p", permute("_number"))
        .withColumns(
            {
                "shard": (F.col("_p") % shards).cast("int"),
                "slot": F.expr(f"_p div {int(shards)}"),
            }
        )
        .drop("_number", "_p")
    )


def sharded_in_order(
    docs: DataFrame, number: str, shards: int = SHARDS, blocks: int = 64, seed: int = SEED
) -> DataFrame:
    """`docs` with shard and slot, numbered 0 to N-1 by the column `number`, which is dropped.

    The permutation stays inside windows of shards x blocks rows: slots below a multiple of `blocks`, over
    all shards, hold exactly the rows with the smallest numbers. No exchange.
    """
    n = docs.count()
    window = shards * blocks

    @F.pandas_udf("long")
    def permute(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted_in_windows(numbers.to_numpy(), n, window, seed))

    return (
        docs.withColumn(number, permute(number))
        .withColumns({"shard": (F.col(number) % shards).cast("int"), "slot": F.expr(f"{number} div {int(shards)}")})
        .drop(number)
    )
