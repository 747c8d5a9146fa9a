"""Small text, number and identity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vendor_ticker(ticker: Column) -> Column:
    """Upper case, share-class dot written as a hyphen."""
    return F.upper(F.translate(ticker, ".", "-"))


def padded_cik(cik: Column) -> Column:
    """Left-pad with zeros to ten characters; longer input is kept whole."""
    text = cik.cast("string")
    return F.when(F.length(text) < 10, F.lpad(text, 10, "0")).otherwise(text)


def relative_difference(value: Column, reference: Column) -> Column:
    """abs(value - reference) / abs(reference); NULL when the reference is 0 or either is NULL."""
    return F.abs(value - reference) / F.nullif(F.abs(reference), F.lit(0.0))


def stable_id(*parts: Column | str) -> Column:
    """Identifier of a natural key: the same in every run, unlike a sequence.

    Each part is preceded by a null marker so that a NULL never hashes like a neighbour's value.
    """
    columns = [F.col(part) if isinstance(part, str) else part for part in parts]
    marked = [item for column in columns for item in (column.isNull(), column)]
    return F.xxhash64(*marked)


def json_document(**fields: Column) -> Column:
    """JSON object that writes NULL fields out instead of leaving them away."""
    document = F.struct(*[column.alias(name) for name, column in fields.items()])
    return F.to_json(document, {"ignoreNullFields": "false"})


def require(condition: Column, value: Column, message: Column) -> Column:
    """`value` where `condition` holds; the job fails with `message` where it does not."""
    return F.when(condition, value).otherwise(F.raise_error(message))
