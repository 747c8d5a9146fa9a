"""Invariants of the versioned tables as queries for the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.operators.frames import null_safe_join
from hindcast.operators.ordered import HOT_KEY_ROWS, Scan, earlier_max, running_sum, split_by_heat


def overlap_violations(
    facts: DataFrame,
    keys: Sequence[str],
    *,
    tie: Sequence[str] = ("knowledge_to",),
    hot_key_rows: int | None = HOT_KEY_ROWS,
) -> DataFrame:
    """Rows whose window starts before an earlier window of the same key has ended.

    Compared with the greatest end so far, not only with the neighbour's, so a window inside a
    longer one is found too. Rows with an empty or inverted window overlap nothing.
    """

    def body(rows: DataFrame, scan: Scan) -> DataFrame:
        scanned = scan(rows, held_until=earlier_max(F.col("knowledge_to")))
        return scanned.where(F.col("held_until") > F.col("knowledge_from"))

    proper = facts.where(F.col("knowledge_from") < F.col("knowledge_to"))
    return split_by_heat(
        proper,
        list(keys),
        ["knowledge_from", *tie],
        body,
        total=facts,
        hot_key_rows=hot_key_rows,
    )


def open_row_violations(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row believed until further notice."""
    return (
        facts.where(F.col("knowledge_to") == schemas.open_end())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("open_rows"))
        .where(F.col("open_rows") > 1)
    )


def early_knowledge_violations(facts: DataFrame, basis_date: str) -> DataFrame:
    """Rows known before the start of the day they were filed or traded on."""
    return facts.where(F.col("knowledge_from") < F.col(basis_date).cast("timestamp"))


def window_violations(facts: DataFrame) -> DataFrame:
    """Rows with an empty or inverted knowledge window."""
    return facts.where(F.col("knowledge_from") >= F.col("knowledge_to"))


def orphans(
    rows: DataFrame, column: str, parents: DataFrame, parent_column: str, within: Sequence[str] = ()
) -> DataFrame:
    """Rows whose non-NULL `column` has no parent row, among the parents equal in `within`.

    An id is a hash of a natural key. Parts of that key in `within` (NULLs are equal) keep another
    key's id, equal by chance, from passing as the parent. Parents are hardly ever repeated, so making
    them distinct would only move them once more.
    """
    known = parents.select(*within, F.col(parent_column).alias(column))
    return null_safe_join(rows.where(F.col(column).isNotNull()), known, [column, *within], "left_anti")


def lineage_violations(facts: DataFrame, payload: DataFrame) -> DataFrame:
    """Facts without a payload id, or with one the log does not hold."""
    missing = facts.where(F.col("payload_id").isNull())
    return missing.unionByName(
        orphans(facts, "payload_id", payload, "payload_id").select(*facts.columns)
    )


def domain_violations(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not one of `allowed`; NULL is not in any domain."""
    return rows.where(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)
    )


def log_mutations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of the payload log that vanished or changed, with the reason."""
    lost = (
        before.select("payload_id", "content_sha256")
        .join(after.select("payload_id", "content_sha256"), ["payload_id", "content_sha256"], "left_anti")
        .select("payload_id", F.lit("row changed or removed").alias("reason"))
    )
    altered = after.where(F.sha2("body", 256) != F.col("content_sha256")).select(
        "payload_id", F.lit("body does not match its hash").alias("reason")
    )
    return lost.unionByName(altered)


def report(**violations: DataFrame) -> DataFrame:
    """(invariant, violations): one count per named query, zero included."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(name).alias("invariant"), "violations"
        )
        for name, df in violations.items()
    ]
    total = counts[0]
    for part in counts[1:]:
        total = total.unionByName(part)
    return total


CHAIN_RULES = ["no_overlap", "one_open_row", "unique_version", "unique_id"]


def chain_flags(
    facts: DataFrame, keys: Sequence[str], *, hot_key_rows: int | None = HOT_KEY_ROWS
) -> DataFrame:
    """`facts` with a column for each of CHAIN_RULES, true on a row that breaks the rule.

    The true rows are as many as `overlap_violations`, `open_row_violations` and twice `duplicate_keys`,
    on knowledge_from and on fact_id, find. Rows that already lie by `keys`, or some of them, don't move.
    """
    start, end = F.col("knowledge_from"), F.col("knowledge_to")

    def second(name: str, order: str):
        return F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) == 2

    def body(rows: DataFrame, scan: Scan) -> DataFrame:
        is_open = (end == schemas.open_end()).cast("bigint")
        scanned = scan(
            rows, __held=earlier_max(F.when(start < end, end)), __opened=running_sum(is_open)
        )
        return scanned.select(
            *rows.columns,
            ((start < end) & (F.col("__held") > start)).alias("no_overlap"),
            # True on the row that makes a key, a version or an id break the rule: once for each.
            ((end == schemas.open_end()) & (F.col("__opened") == 2)).alias("one_open_row"),
            second("knowledge_from", "knowledge_to").alias("unique_version"),
            second("fact_id", "knowledge_from").alias("unique_id"),
        )

    return split_by_heat(
        facts, list(keys), ["knowledge_from", "knowledge_to", "fact_id"], body, hot_key_rows=hot_key_rows
    )


def chain_report(
    facts: DataFrame, keys: Sequence[str], *, hot_key_rows: int | None = HOT_KEY_ROWS
) -> DataFrame:
    """(invariant, violations) of the four invariants inside a key, counted in one pass.

    Rows move once, with the columns of all four.
    """
    narrow = facts.select(*keys, "knowledge_from", "knowledge_to", "fact_id")
    broken = chain_flags(narrow, keys, hot_key_rows=hot_key_rows)
    counts = broken.agg(*[F.count_if(F.col(name)).alias(name) for name in CHAIN_RULES])
    named = [F.struct(F.lit(name).alias("invariant"), F.col(name).alias("violations")) for name in CHAIN_RULES]
    return counts.select(F.inline(F.array(*named)))


def fundamental_invariants(
    facts: DataFrame, payload: DataFrame, entity: DataFrame
) -> DataFrame:
    """All invariants of the fundamental fact table in one report."""
    return report(
        not_known_early=early_knowledge_violations(facts, "filed_date"),
        window_order=window_violations(facts),
        payload_lineage=lineage_violations(facts, payload),
        known_entity=orphans(facts, "entity_id", entity, "entity_id"),
        supersedes_exists=orphans(
            facts, "supersedes", facts, "fact_id", within=["metric_code", "period_start", "period_end"]
        ),
        # Ids tell the versions of one key apart: hashes that agree across keys do no harm.
    ).unionByName(chain_report(facts, schemas.FACT_KEY))


def price_row_invariants(facts: DataFrame, payload: DataFrame, entity: DataFrame) -> DataFrame:
    """The invariants of the price fact table that a row breaks by itself."""
    return report(
        not_known_early=early_knowledge_violations(facts, "trade_date"),
        window_order=window_violations(facts),
        payload_lineage=lineage_violations(facts, payload),
        known_entity=orphans(facts, "entity_id", entity, "entity_id"),
    )


def price_invariants(facts: DataFrame, payload: DataFrame, entity: DataFrame) -> DataFrame:
    """All invariants of the price fact table in one report."""
    return price_row_invariants(facts, payload, entity).unionByName(chain_report(facts, schemas.PRICE_KEY))


def entity_invariants(entity: DataFrame, mapping: DataFrame) -> DataFrame:
    """All invariants of the entity and ticker tables in one report."""
    return report(
        unique_cik=duplicate_keys(entity, ["cik"]),
        unique_entity=duplicate_keys(entity, ["entity_id"]),
        one_open_ticker=open_row_violations(mapping, ["entity_id"]),
        one_open_holder=open_row_violations(mapping, ["ticker"]),
        no_overlap=overlap_violations(mapping, ["entity_id"]),
        window_order=window_violations(mapping),
        known_entity=orphans(mapping, "entity_id", entity, "entity_id"),
    )

