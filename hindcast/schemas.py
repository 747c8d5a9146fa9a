"""Table schemas, the open end of a knowledge window and the allowed enum values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark timestamps have no infinity. A row that is still believed ends at this instant.
OPEN_END = "9999-12-31 23:59:59.999999"

# A new entity's first ticker mapping opens here: vendors publish only the current mapping, so the
# first one seen is taken to have always held.
FIRST_MAPPING_START = "2000-01-01 00:00:00"

VALUE_TYPE = T.DecimalType(38, 6)


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp")


def first_mapping_start() -> Column:
    return F.lit(FIRST_MAPPING_START).cast("timestamp")


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "value": VALUE_TYPE,
    "params": T.MapType(T.StringType(), T.StringType()),
}


def table(columns: str) -> T.StructType:
    """Schema from "name type, ..."; unlike a DDL string it needs no running session."""
    pairs = (item.split() for item in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PAYLOAD = table(
    "payload_id bigint, source string, endpoint string, request_params params, "
    "fetched_at timestamp, http_status int, content_sha256 string, body binary, run_id string"
)
STG_FACT = table(
    "cik string, entity_name string, metric_code string, period_start date, period_end date, "
    "fiscal_year int, fiscal_period string, value value, unit string, "
    "vendor_native_tag string, form_type string, accession_no string, filed_date date, "
    "payload_id bigint"
)
PRICE_ROW = table(
    "ticker string, source string, payload_id bigint, fetched_at timestamp, row_pos int, "
    "trade_date date, open double, high double, low double, close double, volume bigint, "
    "adj_close double"
)
ENTITY = table("entity_id bigint, cik string, name string")
ENTITY_TICKER = table(
    "entity_id bigint, ticker string, knowledge_from timestamp, knowledge_to timestamp"
)
FUNDAMENTAL_FACT = table(
    "fact_id bigint, entity_id bigint, metric_code string, period_start date, period_end date, "
    "fiscal_year int, fiscal_period string, value value, unit string, source string, "
    "vendor_native_tag string, form_type string, accession_no string, filed_date date, "
    "knowledge_from timestamp, knowledge_to timestamp, supersedes bigint, payload_id bigint"
)
PRICE_FACT = table(
    "fact_id bigint, entity_id bigint, trade_date date, open double, high double, low double, "
    "close double, volume bigint, adj_close double, source string, knowledge_from timestamp, "
    "knowledge_to timestamp, payload_id bigint"
)
CHECK_RESULT = table(
    "check_name string, dataset string, severity string, status string, observed string, "
    "expected string, entity_id bigint, dimension_key string, ordinal bigint"
)
EXCEPTION = table(
    "exception_id bigint, check_name string, entity_id bigint, dimension_key string, "
    "severity string, last_severity string, status string, opened_at timestamp, "
    "closed_at timestamp, resolution_note string"
)
PIPELINE_RUN = table(
    "run_id string, pipeline string, started_at timestamp, ended_at timestamp, status string, "
    "rows_in bigint, rows_out bigint, error string"
)

# Natural keys of the versioned tables.
FACT_KEY = ["entity_id", "metric_code", "period_start", "period_end", "source"]
PRICE_KEY = ["entity_id", "source", "trade_date"]
TICKER_KEY = ["ticker"]

# Fixed enum values.
SEVERITIES = ["INFO", "WARN", "BREAK"]
CHECK_STATUSES = ["pass", "fail"]
EXCEPTION_STATUSES = ["open", "triage", "closed"]
RUN_STATUSES = ["running", "success", "failed"]
