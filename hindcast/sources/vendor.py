"""Scans of vendor bodies: company-facts JSON, ticker-map JSON, price CSV and price JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast import schemas
from hindcast.config import MetricMap
from hindcast.functions.calendar import local_date
from hindcast.functions.scalar import padded_cik, require
from hindcast.sources.payloads import checked_shape, ticker_of

# Fixed keys of the vendor documents.
TICKER_MAP_KEYS = ["cik_str", "ticker", "title"]
PRICE_POINT_KEYS = [
    "date", "close", "high", "low", "open", "volume", "adjClose", "adjHigh", "adjLow",
    "adjOpen", "adjVolume", "divCash", "splitFactor",
]
CSV_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Volume", "Adj Close"]

_POINT = (
    "struct<start:string,end:string,val:decimal(38,6),accn:string,fy:int,fp:string,"
    "form:string,filed:string>"
)


# Parsed arrays are exploded with the outer variant and filtered afterwards: for the inner one the
# optimizer adds a filter on the array's size below the parsing step, which parses every body twice.


def _text(body: str = "body") -> Column:
    return F.col(body).cast("string")


def _companyfacts_type(units_by_tag: dict[str, set[str]]) -> str:
    """Type naming only the wanted tags and units, so the JSON reader skips all the others."""
    tags = ",".join(
        f"`{tag}`:struct<units:struct<"
        + ",".join(f"`{unit}`:array<{_POINT}>" for unit in sorted(units))
        + ">>"
        for tag, units in sorted(units_by_tag.items())
    )
    return f"struct<cik:string,entityName:string,facts:struct<`us-gaap`:struct<{tags}>>>"


def _points_of(tag: str, unit: str) -> Column:
    return F.col("doc")["facts"]["us-gaap"][tag]["units"][unit]


def _period_of(point: Column) -> Column:
    return F.concat(F.coalesce(point["start"], F.lit("")), F.lit(" "), F.coalesce(point["end"], F.lit("")))


def companyfacts(payload: DataFrame, metric_map: MetricMap, *, best_only: bool = False) -> DataFrame:
    """One row per reported data point of a mapped tag.

    With `best_only`, tag priority is applied: of the tags that report a period the best one counts.
    A document is one row, so this happens inside it and nothing is shuffled.
    """
    units_by_tag: dict[str, set[str]] = {}
    for row in metric_map:
        units_by_tag.setdefault(row.tag, set()).add(row.unit)
    none = F.array().cast("array<string>")

    def points_of(row) -> Column:
        """Points of periods that no better tag of the metric reports."""
        points = _points_of(row.tag, row.unit)
        better = [
            _points_of(other.tag, other.unit)
            for other in metric_map
            if best_only and other.metric_code == row.metric_code and other.priority < row.priority
        ]
        if not better:
            return points
        taken = F.concat(*[F.coalesce(F.transform(p, _period_of), none) for p in better])
        return F.filter(points, lambda point: ~F.array_contains(taken, _period_of(point)))

    groups = F.array(
        *[
            F.struct(
                F.lit(row.metric_code).alias("metric_code"),
                F.lit(row.priority).alias("priority"),
                F.lit(row.tag).alias("vendor_native_tag"),
                F.lit(row.unit).alias("unit"),
                points_of(row).alias("points"),
            )
            for row in metric_map
        ]
    )
    documents = payload.select(
        "payload_id", F.from_json(_text(), _companyfacts_type(units_by_tag)).alias("doc")
    )
    tagged = documents.select(
        "payload_id",
        padded_cik(F.col("doc.cik")).alias("cik"),
        F.col("doc.entityName").alias("entity_name"),
        F.inline(groups),
    )
    points = tagged.select("*", F.explode("points").alias("point"))

    def needed(name: str) -> Column:
        value = F.col(f"point.{name}")
        return require(
            value.isNotNull(),
            value,
            F.concat(F.lit(f"data point without {name} in payload "), F.col("payload_id")),
        )

    return points.select(
        "cik",
        "entity_name",
        "metric_code",
        F.to_date("point.start").alias("period_start"),
        F.to_date(needed("end")).alias("period_end"),
        F.col("point.fy").alias("fiscal_year"),
        F.col("point.fp").alias("fiscal_period"),
        needed("val").alias("value"),
        "unit",
        "vendor_native_tag",
        needed("form").alias("form_type"),
        needed("accn").alias("accession_no"),
        F.to_date(needed("filed")).alias("filed_date"),
        "payload_id",
        "priority",
    )


def parse_companyfacts(payload: DataFrame, metric_map: MetricMap) -> DataFrame:
    """Staged facts: for every reporting period the best tag that reports it, all its points."""
    return companyfacts(payload, metric_map, best_only=True).select(*schemas.STG_FACT.fieldNames())


def entity_names(payload: DataFrame) -> DataFrame:
    """(cik, name) per company-facts document, also for one without any usable fact."""
    return payload.select(
        padded_cik(F.get_json_object(_text(), "$.cik")).alias("cik"),
        F.get_json_object(_text(), "$.entityName").alias("name"),
    )


def instant_values(payload: DataFrame, tag: str, unit: str = "USD") -> DataFrame:
    """(cik, period_end, value): the first point of `tag` per date that has no start."""
    documents = payload.select(
        F.from_json(_text(), _companyfacts_type({tag: {unit}})).alias("doc")
    )
    points = documents.select(
        F.col("doc.cik").alias("cik"),
        # Outer, and the key padded after the aggregate: no filter on the parsed document is pushed
        # below the parse, which would parse it again.
        F.posexplode_outer(_points_of(tag, unit)).alias("pos", "point"),
    ).where(F.col("point").isNotNull() & F.col("point.start").isNull())
    first = points.groupBy("cik", F.to_date("point.end").alias("period_end")).agg(
        F.min(F.struct("pos", "point.val"))["val"].alias("value")
    )
    return first.select(padded_cik(F.col("cik")).alias("cik"), "period_end", "value")


def ticker_map(payload: DataFrame) -> DataFrame:
    """(ticker, cik) of a ticker-map document; the last entry of a repeated ticker wins."""
    entries = payload.select(
        F.posexplode(
            F.map_values(F.from_json(_text(), "map<string,map<string,string>>"))
        ).alias("pos", "entry")
    )
    has_all = F.forall(
        F.lit(TICKER_MAP_KEYS), lambda key: F.array_contains(F.map_keys("entry"), key)
    )
    ticker = require(
        has_all,
        F.upper(F.col("entry")["ticker"]),
        F.concat(
            F.lit("a ticker map entry lacks its fields, it has: "),
            F.array_join(F.map_keys("entry"), ", "),
        ),
    )
    return (
        entries.select("pos", ticker.alias("ticker"), padded_cik(F.col("entry")["cik_str"]).alias("cik"))
        .groupBy("ticker")
        .agg(F.max(F.struct("pos", "cik"))["cik"].alias("cik"))
    )


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("double")


def price_csv(payload: DataFrame) -> DataFrame:
    """Price rows of CSV bodies. Columns are found by header name, whatever their order."""
    lines = payload.select(
        ticker_of().alias("ticker"),
        "source",
        "payload_id",
        "fetched_at",
        F.split(F.replace(_text(), F.lit("\r"), F.lit("")), "\n").alias("lines"),
    )
    rows = lines.select(
        "*",
        F.split(F.col("lines")[0], ",").alias("header"),
        F.posexplode_outer("lines").alias("row_pos", "line"),
    ).where((F.col("row_pos") > 0) & (F.col("line") != ""))
    cells = rows.withColumn("cells", F.split("line", ","))

    def cell(name: str) -> Column:
        at = F.array_position("header", name).cast("int")
        return require(
            at > 0, F.get("cells", at - 1), F.lit(f"price CSV has no column {name!r}")
        )

    return cells.select(
        "ticker",
        "source",
        "payload_id",
        "fetched_at",
        "row_pos",
        local_date(cell("Date")).alias("trade_date"),
        _number(cell("Open")).alias("open"),
        _number(cell("High")).alias("high"),
        _number(cell("Low")).alias("low"),
        _number(cell("Close")).alias("close"),
        _number(cell("Volume")).cast("bigint").alias("volume"),
        _number(cell("Adj Close")).alias("adj_close"),
    )


def price_json(payload: DataFrame) -> DataFrame:
    """Price rows of JSON bodies; the first point is checked for the documented keys."""
    about = ["ticker", "source", "payload_id", "fetched_at"]
    documents = payload.withColumn("ticker", ticker_of()).select(
        *about, _text().alias("text"), F.get_json_object(_text(), "$[0]").alias("first")
    )
    body = checked_shape(F.col("text"), F.col("first"), PRICE_POINT_KEYS, "price response")
    parsed = documents.select(
        *about,
        F.from_json(
            body,
            "array<struct<date:string,open:double,high:double,low:double,close:double,"
            "volume:bigint,adjClose:double>>",
        ).alias("points"),
    )
    points = parsed.select(
        *about, F.posexplode_outer("points").alias("row_pos", "point")
    ).where(F.col("row_pos").isNotNull())
    return points.select(
        "ticker",
        "source",
        "payload_id",
        "fetched_at",
        "row_pos",
        local_date(F.col("point.date")).alias("trade_date"),
        *[F.col(f"point.{name}") for name in ("open", "high", "low", "close", "volume")],
        F.col("point.adjClose").alias("adj_close"),
    )


PRICE_PARSERS = {"yfinance": price_csv, "tiingo": price_json}


def parse_prices(payload: DataFrame, source: str) -> DataFrame:
    if source not in PRICE_PARSERS:
        raise ValueError(f"unknown price source {source!r}, expected one of: {list(PRICE_PARSERS)}")
    return PRICE_PARSERS[source](payload)
