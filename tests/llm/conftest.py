"""Tables made by hand."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from brute import HARD_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    """NULL ids and texts, empty and very long texts, repeated rows, columns of clashing names."""
    rows = [(i, text, "src0" if i % 3 else None) for i, text in enumerate(HARD_TEXTS)]
    rows += [(None, "no id here at all", None), (3, "\n\n\t", "src1"), (3, "\n\n\t", "src1")]
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, schema)
    return docs.selectExpr(
        "*", "'en' as lang", "1L as n_chars", "7 as shard", "'x' as kept", "'y' as score", "1 as h",
        "2 as k", "'g' as `group`", "array(1) as row", "0 as position", "'z' as host",
    )


@pytest.fixture(scope="session")
def no_rows(hard):
    return hard.limit(0)
