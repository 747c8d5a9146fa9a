"""Restatement chains: from repeated observations of a fact to its versions in knowledge time.

Every version gets a half-open window [knowledge_from, knowledge_to) during which it was believed.
The windows of a key are contiguous and the last one is open. Chains are recomputed from the full
history, so observations that arrive late are spliced in and a second run over the same input
changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.functions.calendar import knowledge_from
from hindcast.functions.scalar import stable_id
from hindcast.operators.frames import broadcast_if_small, null_safe_join
from hindcast.operators.integrity import CHAIN_RULES, chain_flags, duplicate_keys
from hindcast.operators.ordered import (
    HOT_KEY_ROWS,
    Scan,
    following,
    hot_keys,
    may_be_hot,
    previous,
    running_max,
    running_sum,
    split_by_heat,
)
from hindcast.session import cut_lineage

_PERIOD = ["metric_code", "period_start", "period_end"]


def with_entity(facts: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of known entities with `entity_id`, facts whose cik no entity has)."""
    ids = entity.select("entity_id", "cik")
    return facts.join(ids, "cik"), facts.join(ids.select("cik"), "cik", "left_anti")


def loadable(stg: DataFrame) -> DataFrame:
    """Staged rows with every column a chain needs."""
    return stg.dropna(subset=["cik", "metric_code", "period_end", "accession_no", "filed_date"])


def dedupe_accessions(
    rows: DataFrame, keys: Sequence[str], accession: str = "accession_no"
) -> DataFrame:
    """One row per (key, accession): the earliest filing, then the lowest payload id and value.

    A grouped aggregate, so rows are combined before the shuffle however often one repeats.
    """
    grain = [*keys, accession]
    rest = [name for name in rows.columns if name not in grain]
    first = F.min_by(F.struct(*rest), F.struct("filed_date", "payload_id", "value"))
    return rows.groupBy(*grain).agg(first.alias("__first")).select(*grain, "__first.*")


def dedupe_in_place(
    rows: DataFrame, keys: Sequence[str], accession: str = "accession_no"
) -> DataFrame:
    """`dedupe_accessions` for keys of bounded size: rows move once, to where the chain needs them.

    Both windows are satisfied by a partitioning on the keys alone, so there is no second exchange.
    """
    window = Window.partitionBy(*keys, accession).orderBy("filed_date", "payload_id", "value")
    return (
        rows.repartition(*keys)
        .withColumn("__nth", F.row_number().over(window))
        .where(F.col("__nth") == 1)
        .drop("__nth")
    )


def changed(scan: Scan, rows: DataFrame, state: Sequence[str]) -> DataFrame:
    """Rows whose `state` columns differ from the row before; `__first` marks a key's first row.

    Equal neighbours form runs, so comparing with the row before is the same as comparing with the
    last row kept. A value that returns after a change is kept again.
    """
    compared = scan(
        rows,
        __seen=previous(F.lit(True)),
        **{f"__prior_{name}": previous(F.col(name)) for name in state},
    ).withColumn("__first", F.col("__seen").isNull())
    differs = F.col("__first")
    for name in state:
        differs = differs | ~F.col(name).eqNullSafe(F.col(f"__prior_{name}"))
    return compared.where(differs).drop("__seen", *[f"__prior_{name}" for name in state])


def version_chain(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    lag_days: Column | int,
    version: str = "accession_no",
    state: Sequence[str] = ("value", "unit"),
    hot_key_rows: int | None = HOT_KEY_ROWS,
    total: DataFrame | None = None,
) -> DataFrame:
    """Versions of each key, one observation per `version` (the accession) being used.

    Rows are ordered by (filed_date, version). Repeats of the value already believed are dropped.
    Each survivor becomes known at `knowledge_from(filed_date)`, or one second after its
    predecessor where that is not later, because filing dates carry no time and weekends share an
    opening. With c the computed instant and i the position in the chain, that recurrence is
    k[i] = i + max(c[j] - j for j <= i), a running maximum.

    Adds knowledge_from, knowledge_to and `prior_version`, the version it supersedes.
    """

    def body(frame: DataFrame, scan: Scan) -> DataFrame:
        links = scan(
            changed(scan, frame, state), __pos=running_sum(F.lit(1).cast("bigint"))
        )
        opens = F.unix_seconds(knowledge_from(F.col("filed_date"), lag_days))
        links = scan(links, __peak=running_max(opens - F.col("__pos")))
        links = links.withColumn(
            "knowledge_from", F.timestamp_seconds(F.col("__peak") + F.col("__pos"))
        )
        links = scan(
            links,
            __next=following(F.col("knowledge_from")),
            prior_version=previous(F.col(version)),
        )
        return links.withColumn(
            "knowledge_to", F.coalesce("__next", schemas.open_end())
        ).drop("__first", "__pos", "__peak", "__next")

    return split_by_heat(
        rows,
        keys,
        ["filed_date", version],
        body,
        reduce_cold=lambda frame: dedupe_in_place(frame, keys, version),
        reduce_hot=lambda frame: dedupe_accessions(frame, keys, version),
        total=total,
        hot_key_rows=hot_key_rows,
    )


def fundamental_facts(
    stg: DataFrame,
    entity: DataFrame,
    *,
    source: str,
    lag_days: int,
    hot_key_rows: int | None = HOT_KEY_ROWS,
) -> DataFrame:
    """The versioned fundamental fact table for the staged rows of known entities."""
    known, _ = with_entity(loadable(stg), entity)
    known = known.drop("cik", "entity_name")
    keys = ["entity_id", *_PERIOD]
    chain = version_chain(
        known, keys, lag_days=lag_days, hot_key_rows=hot_key_rows, total=stg
    ).withColumn("source", F.lit(source))

    def fact_id(version: str) -> Column:
        return stable_id(*schemas.FACT_KEY, F.col(version))

    chain = chain.withColumn("fact_id", fact_id("accession_no")).withColumn(
        "supersedes", F.when(F.col("prior_version").isNotNull(), fact_id("prior_version"))
    )
    return chain.select(*schemas.FUNDAMENTAL_FACT.fieldNames())


def price_chain(
    observations: DataFrame,
    *,
    lag_days: Column | int,
    keys: Sequence[str] = tuple(schemas.PRICE_KEY),
    order: Sequence[str] = ("fetched_at", "payload_id", "row_pos"),
    hot_key_rows: int | None = HOT_KEY_ROWS,
    total: DataFrame | None = None,
) -> DataFrame:
    """Versions of each (entity, source, trade_date) price over successive fetches.

    Only close and adj_close make a new version. The first one is dated back to when the price was
    knowable; a later one opens at the fetch that revealed it. Two fetches on the same day as the
    back-dated opening can give an inverted window: see `integrity.window_violations`.
    """

    def body(frame: DataFrame, scan: Scan) -> DataFrame:
        versions = changed(scan, frame, ["close", "adj_close"])
        versions = versions.withColumn(
            "knowledge_from",
            F.when(
                F.col("__first"), knowledge_from(F.col("trade_date"), lag_days)
            ).otherwise(F.col("fetched_at")),
        )
        versions = scan(versions, __next=following(F.col("knowledge_from")))
        return versions.withColumn(
            "knowledge_to", F.coalesce("__next", schemas.open_end())
        ).drop("__first", "__next")

    return split_by_heat(
        observations, list(keys), list(order), body, total=total, hot_key_rows=hot_key_rows
    )


def _hot_tickers(prices: DataFrame, hot_key_rows: int | None) -> DataFrame | None:
    """Tickers with more than `hot_key_rows` rows, to be broadcast if they are few; None without any."""
    if hot_key_rows is None:
        return None
    suspects = may_be_hot(prices, ["ticker"], hot_key_rows)
    if suspects is None:
        return None
    hot = cut_lineage(hot_keys(suspects, ["ticker"], hot_key_rows).select("ticker"))
    n_tickers = hot.count()
    return broadcast_if_small(hot, n_tickers) if n_tickers else None


def price_facts(
    prices: DataFrame,
    entity_ticker: DataFrame,
    *,
    lag_days: int,
    hot_key_rows: int | None = HOT_KEY_ROWS,
    keep: Sequence[str] = (),
    flags: bool = False,
) -> DataFrame:
    """The versioned price fact table for parsed price rows of currently mapped tickers.

    While no entity has several open tickers, a key's rows are all of one ticker. Then rows move once,
    by ticker, which serves the join with a mapping of any size and the chain. Tickers with more than
    `hot_key_rows` rows are joined first and dealt by the whole key.

    `keep` names columns of `prices` to carry along, such as a partition column. `flags` adds those of
    `integrity.chain_flags`, found where the chains are made.
    """
    names = [*schemas.PRICE_FACT.fieldNames(), *keep, *(CHAIN_RULES if flags else [])]
    current = entity_ticker.where(F.col("knowledge_to") == schemas.open_end()).select("ticker", "entity_id")

    def facts(versions: DataFrame) -> DataFrame:
        return versions.withColumn("fact_id", stable_id(*schemas.PRICE_KEY, F.col("knowledge_from")))

    def by_key(rows: DataFrame, mapping: DataFrame) -> DataFrame:
        observed = rows.join(mapping, "ticker")
        made = facts(price_chain(observed, lag_days=lag_days, hot_key_rows=hot_key_rows))
        if flags:
            made = chain_flags(cut_lineage(made), schemas.PRICE_KEY, hot_key_rows=hot_key_rows)
        return made.select(*names)

    def by_ticker(rows: DataFrame) -> DataFrame:
        keys = ["ticker", *schemas.PRICE_KEY]
        observed = rows.join(current, "ticker").repartition("ticker")
        made = facts(price_chain(observed, lag_days=lag_days, keys=keys, hot_key_rows=None))
        if flags:
            made = chain_flags(made, keys, hot_key_rows=None)
        return made.select(*names)

    if not duplicate_keys(current, ["entity_id"]).isEmpty():
        return by_key(prices, current)
    hot = _hot_tickers(prices, hot_key_rows)
    if hot is None:
        return by_ticker(prices)
    cold = by_ticker(null_safe_join(prices, hot, ["ticker"], "left_anti"))
    hot_rows = null_safe_join(prices, hot, ["ticker"], "left_semi")
    hot_mapping = null_safe_join(current, hot, ["ticker"], "left_semi")
    return cold.unionByName(by_key(hot_rows, hot_mapping))


def unmapped_tickers(prices: DataFrame, entity_ticker: DataFrame) -> DataFrame:
    """Tickers with price payloads but no open mapping; their rows are left out of the load."""
    current = entity_ticker.where(F.col("knowledge_to") == schemas.open_end())
    return (
        prices.select("ticker")
        .where(F.col("ticker").isNotNull())
        .distinct()
        .join(current, "ticker", "left_anti")
    )


def best_tag_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of the best (lowest) `priority` that has any point for the key.

    The best priority is a pre-aggregated minimum that is joined back, so a key holding a large
    share of the rows is neither sorted nor collected in one task (adaptive skew join splits it).
    """
    best = points.groupBy(*keys).agg(F.min("priority").alias("__best"))
    return (
        null_safe_join(points, best, keys)
        .where(F.col("priority") == F.col("__best"))
        .drop("__best")
    )


def version_diff(
    existing: DataFrame,
    recomputed: DataFrame,
    *,
    keys: Sequence[str],
    version: str,
) -> DataFrame:
    """How each version of a recomputed table relates to the stored one.

    `action` is insert (new), relink (stored already; `moved` tells whether its window changed) or
    orphan (stored, but no longer part of the chain).
    """
    grain = [*keys, version]
    old = existing.select(
        *grain, F.col("knowledge_to").alias("old_knowledge_to"), F.lit(True).alias("__old")
    )
    new = recomputed.select(
        *grain, F.col("knowledge_to").alias("new_knowledge_to"), F.lit(True).alias("__new")
    )
    for name in grain:
        old = old.withColumnRenamed(name, f"__old_{name}")
    condition = [F.col(f"__old_{name}").eqNullSafe(F.col(name)) for name in grain]
    joined = new.join(old, condition, "full_outer")
    return joined.select(
        *[F.coalesce(name, f"__old_{name}").alias(name) for name in grain],
        F.when(F.col("__old").isNull(), "insert")
        .when(F.col("__new").isNull(), "orphan")
        .otherwise("relink")
        .alias("action"),
        "old_knowledge_to",
        "new_knowledge_to",
        (
            F.col("__old").isNotNull()
            & F.col("__new").isNotNull()
            & (F.col("old_knowledge_to") != F.col("new_knowledge_to"))
        ).alias("moved"),
    )


def load_summary(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys_processed, rows_inserted, rows_relinked, rows_orphaned."""
    per_key = diff.groupBy(*keys).agg(
        *[
            F.count_if(F.col("action") == action).alias(action)
            for action in ("insert", "relink", "orphan")
        ]
    )
    return per_key.agg(
        F.count_if(F.col("insert") + F.col("relink") > 0).alias("keys_processed"),
        F.coalesce(F.sum("insert"), F.lit(0)).alias("rows_inserted"),
        F.coalesce(F.sum("relink"), F.lit(0)).alias("rows_relinked"),
        F.coalesce(F.sum("orphan"), F.lit(0)).alias("rows_orphaned"),
    )
