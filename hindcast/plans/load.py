"""From landed payloads to the versioned tables, one snapshot per table and run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schemas
from hindcast.config import MetricMap
from hindcast.functions.scalar import padded_cik, vendor_ticker
from hindcast.operators import chain, integrity, scd2
from hindcast.operators.frames import broadcast_if_small
from hindcast.plans.lineage import tracked_run
from hindcast.session import cut_lineage
from hindcast.sources import payloads, vendor
from hindcast.sources.lake import Lake

PAYLOAD = "raw.payload"
LANDING = "raw.landing"
LANDING_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("payload_id", T.LongType()),
        T.StructField("content_unchanged", T.BooleanType()),
        T.StructField("run_id", T.StringType()),
    ]
)
STG = "stg.fundamental_fact"
ENTITY = "core.entity"
TICKER = "core.entity_ticker"
FUNDAMENTAL = "core.fundamental_fact"
PRICE = "core.price_fact"
FUNDAMENTAL_SOURCE = "edgar"


@dataclass(frozen=True)
class LoadSummary:
    """keys_processed counts fact keys for fundamentals and entities (one open ticker each) for
    prices."""

    keys_processed: int
    rows_inserted: int
    rows_relinked: int
    rows_orphaned: int


def read_payloads(lake: Lake) -> DataFrame:
    return lake.read_log(PAYLOAD, schemas.PAYLOAD)


def land(lake: Lake, fetched: DataFrame, source: str) -> None:
    """Append a batch of responses of one source to the payload log."""
    with tracked_run(lake, f"ingest:{source}") as run:
        rows = payloads.identified(
            run.reading(fetched.withColumn("source", F.lit(source))), run.run_id
        )
        lake.append(PAYLOAD, run.counting(rows), ("source",))
        # What was just written, against everything before it, without the bodies of either.
        log = read_payloads(lake).select("source", "content_sha256", "fetched_at", "payload_id", "run_id")
        batch = log.where(F.col("run_id") == run.run_id)
        flagged = payloads.mark_seen(batch, log.where(F.col("run_id") != run.run_id))
        lake.append(LANDING, flagged.select("source", "payload_id", "content_unchanged", "run_id"))


def read_landings(lake: Lake) -> DataFrame:
    """(source, payload_id, content_unchanged, run_id) of everything landed."""
    return lake.read_log(LANDING, LANDING_SCHEMA)


def universe_documents(
    universe: DataFrame, ciks: DataFrame, companyfacts: DataFrame
) -> DataFrame:
    """(ticker, ordinal, cik, payload_id) of universe tickers; the last two are NULL where missing.

    The ordinal is the universe's column of that name; without one, tickers count in their order.
    """
    ordinal = F.col("ordinal") if "ordinal" in universe.columns else F.lit(0)
    resolved = universe.select("ticker", ordinal.alias("ordinal"), vendor_ticker(F.col("ticker")).alias("__vendor")).join(
        ciks.select(F.col("ticker").alias("__vendor"), "cik"), "__vendor", "left"
    )
    return resolved.join(companyfacts.select("ticker", "payload_id"), "ticker", "left").select(
        "ticker", "ordinal", "cik", "payload_id"
    )


def universe_rejects(universe: DataFrame, ciks: DataFrame, companyfacts: DataFrame) -> DataFrame:
    """(ticker, reason) of universe tickers without a cik or without a document."""
    resolved = universe_documents(universe, ciks, companyfacts)
    return resolved.where(F.col("cik").isNull() | F.col("payload_id").isNull()).select(
        "ticker",
        F.when(F.col("cik").isNull(), "no cik").otherwise("no companyfacts").alias("reason"),
    )


def parse_facts(
    log: DataFrame, universe: DataFrame, metric_map: MetricMap, *, ok_only: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(staged facts, `seen(cik, name, ticker)`, rejects) of the universe's latest documents."""
    source = log.where(F.col("source") == FUNDAMENTAL_SOURCE)
    maps = payloads.latest(
        source.where(F.col("endpoint") == "ticker_map"), ["endpoint"], ok_only=ok_only
    )
    documents = payloads.latest(
        source.where(F.col("endpoint") == "companyfacts"),
        [payloads.ticker_of().alias("ticker")],
        ok_only=ok_only,
    ).withColumn("ticker", payloads.ticker_of())
    ciks = vendor.ticker_map(maps)
    chosen = universe_documents(universe, ciks, documents).dropna()
    # Ids only, counted, so that bodies are filtered where they are read.
    ids = cut_lineage(chosen.select("ticker", "payload_id").distinct())
    ids = broadcast_if_small(ids, ids.count(), payloads.BROADCAST_IDS)
    wanted = documents.join(ids, ["ticker", "payload_id"], "left_semi")
    names = wanted.select(
        "ticker", "payload_id", F.get_json_object(F.col("body").cast("string"), "$.entityName").alias("name")
    )
    seen = scd2.one_per_cik(chosen.join(names, ["ticker", "payload_id"]))
    return (
        vendor.parse_companyfacts(wanted, metric_map),
        seen,
        universe_rejects(universe, ciks, documents),
    )


def run_parse(lake: Lake, universe: DataFrame, metric_map: MetricMap) -> DataFrame:
    """Stage the latest documents and refresh entities and ticker mapping; returns the rejects."""
    log = read_payloads(lake)
    map_fetches = payloads.latest(
        log.where(
            (F.col("source") == FUNDAMENTAL_SOURCE) & (F.col("endpoint") == "ticker_map")
        ),
        ["endpoint"],
    ).select("fetched_at").take(1)
    if not map_fetches:
        raise RuntimeError("no ticker map in the payload log: land one first")
    with tracked_run(lake, "parse") as run:
        staged, seen, rejects = parse_facts(log, universe, metric_map)
        seen = cut_lineage(seen)
        run.rows_in = seen.count()
        entity_path = lake.stage(
            ENTITY, scd2.merge_entities(lake.read(ENTITY, schemas.ENTITY), seen)
        )
        entity = lake.spark.read.schema(schemas.ENTITY).parquet(entity_path)
        current = seen.join(entity.select("cik", "entity_id"), "cik").select("entity_id", "ticker")
        mapping_path = lake.stage(
            TICKER,
            scd2.merge_ticker_mapping(
                lake.read(TICKER, schemas.ENTITY_TICKER), current, F.lit(map_fetches[0][0])
            ),
        )
        mapping = lake.spark.read.schema(schemas.ENTITY_TICKER).parquet(mapping_path)
        _refuse(lake, "entities", integrity.entity_invariants(entity, mapping), entity_path, mapping_path)
        staged_path = lake.stage(STG, run.counting(staged))
        # By one marker: facts, entities and tickers of a run are seen together or not at all.
        lake.publish(staged_path, entity_path, mapping_path)
    return rejects


def _refuse(lake: Lake, what: str, report: DataFrame, *staged: str) -> None:
    """Give up the staged versions and raise if an invariant is broken."""
    broken = {row.invariant: row.violations for row in report.where("violations > 0").collect()}
    if broken:
        for path in staged:
            lake.discard(path)
        raise ValueError(f"{what} refused, rows that break an invariant: {broken}")


def _replace_facts(
    lake: Lake, table: str, facts: DataFrame, schema, key: list[str], version: str,
    counted: list[str], invariants, layout: list[str],
) -> LoadSummary:
    """Stage a recomputed table, check every invariant of it, publish it, report what changed.

    A table that breaks an invariant is never published: readers keep the one before. Files are
    sorted by `layout`, so that reads by those columns skip row groups. The summary compares the two
    snapshots as written, so the chain is computed once; it counts `counted` as keys processed.
    """
    first_load = not lake.holds(table)
    before = lake.read(table, schema)
    staged = lake.stage(table, facts.sortWithinPartitions(*layout))
    after = lake.spark.read.schema(schema).parquet(staged)
    report = invariants(after, read_payloads(lake), lake.read(ENTITY, schemas.ENTITY))
    _refuse(lake, table, report, staged)
    lake.publish(staged)
    if first_load:
        diff = after.withColumn("action", F.lit("insert"))
    else:
        diff = chain.version_diff(before, after, keys=key, version=version)
    return LoadSummary(**chain.load_summary(diff, counted).first().asDict())


def load_fundamentals(lake: Lake, lag_days: int) -> LoadSummary:
    """Rebuild the fundamental fact table from the staged facts of known entities."""
    with tracked_run(lake, "load-fundamentals") as run:
        stg = lake.read(STG, schemas.STG_FACT)
        run.rows_in = stg.count()
        facts = chain.fundamental_facts(
            stg, lake.read(ENTITY, schemas.ENTITY), source=FUNDAMENTAL_SOURCE, lag_days=lag_days
        )
        return _replace_facts(
            lake, FUNDAMENTAL, run.counting(facts), schemas.FUNDAMENTAL_FACT, schemas.FACT_KEY,
            "accession_no", schemas.FACT_KEY, integrity.fundamental_invariants,
            ["metric_code", "entity_id", "period_end", "knowledge_from"],
        )


def load_prices(lake: Lake, source: str, lag_days: int) -> LoadSummary:
    """Rebuild one source's part of the price fact table from its payloads."""
    with tracked_run(lake, f"load-prices:{source}") as run:
        # Not stored: the exchange of the chain holds the rows once, and counts don't parse cells.
        parsed = vendor.parse_prices(
            payloads.price_payloads(read_payloads(lake), source), source
        )
        run.rows_in = parsed.count()
        flagged = chain.price_facts(
            parsed, lake.read(TICKER, schemas.ENTITY_TICKER), lag_days=lag_days, flags=True
        )
        rules = integrity.CHAIN_RULES
        broken = Observation()
        counts = [F.count_if(F.col(rule)).alias(rule) for rule in rules]
        facts = flagged.observe(broken, *counts).drop(*rules)

        def invariants(after: DataFrame, payload: DataFrame, entity: DataFrame) -> DataFrame:
            # Rules inside a key were counted on the rows as they were written.
            chains = lake.spark.createDataFrame(list(broken.get.items()), "invariant string, violations bigint")
            return integrity.price_row_invariants(after, payload, entity).unionByName(chains)

        return _replace_facts(
            lake, f"{PRICE}.{source}", run.counting(facts), schemas.PRICE_FACT,
            schemas.PRICE_KEY, "knowledge_from", ["entity_id"], invariants,
            ["entity_id", "trade_date", "knowledge_from"],
        )


def read_prices(lake: Lake, sources: list[str]) -> DataFrame:
    parts = [lake.read(f"{PRICE}.{source}", schemas.PRICE_FACT) for source in sources]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def cik_request(params: str = "request_params"):
    """The padded cik a company-facts request named."""
    return padded_cik(F.col(params)["cik"])
