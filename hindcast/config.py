"""Configuration: fixed defaults, and loaders that reject an empty or misshapen mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

RECONCILABLE_FIELDS = ["open", "high", "low", "close", "adj_close"]


@dataclass(frozen=True)
class MetricTag:
    metric_code: str
    unit: str
    priority: int
    tag: str


MetricMap = Sequence[MetricTag]


@dataclass(frozen=True)
class ReconciliationRule:
    name: str
    left_source: str
    left_field: str
    right_source: str
    right_field: str
    tolerance: float
    severity: str
    escalate_after: int | None = None
    escalated_severity: str | None = None

    def __post_init__(self) -> None:
        for side, field in (("left", self.left_field), ("right", self.right_field)):
            if field not in RECONCILABLE_FIELDS:
                raise ValueError(f"rule {self.name!r}: cannot compare {side} field {field!r}")


@dataclass(frozen=True)
class Sla:
    source: str
    expected_refresh_days: int
    max_staleness_days: int


def metric_map(data: Any) -> list[MetricTag]:
    if not isinstance(data, dict) or not data:
        raise ValueError("expected metrics with their unit and tags")
    return [
        MetricTag(metric, body["unit"], priority, tag)
        for metric, body in data.items()
        for priority, tag in enumerate(body["tags"])
    ]


def source_lags(data: Any) -> dict[str, int]:
    if not isinstance(data, dict) or not data:
        raise ValueError("expected a lag for each source")
    return {source: int(body["availability_lag_days"]) for source, body in data.items()}


def reconciliation_rules(data: Any) -> list[ReconciliationRule]:
    if not isinstance(data, list):
        raise ValueError("expected a list of comparison rules")
    rules = []
    for item in data:
        if item["tolerance"].get("type", "relative") != "relative":
            raise ValueError(f"rule {item['name']!r}: its tolerance is not relative, the one kind there is")
        escalate = item.get("escalate_if") or {}
        rules.append(
            ReconciliationRule(
                name=item["name"],
                left_source=item["left"]["source"],
                left_field=item["left"]["field"],
                right_source=item["right"]["source"],
                right_field=item["right"]["field"],
                tolerance=float(item["tolerance"]["value"]),
                severity=item["severity"],
                escalate_after=escalate.get("consecutive_days"),
                escalated_severity=escalate.get("severity"),
            )
        )
    return rules


def slas(data: Any) -> list[Sla]:
    if not isinstance(data, list) or not data:
        raise ValueError("expected at least one feed with its limits")
    return [
        Sla(item["source"], item["expected_refresh_days"], item["max_staleness_days"])
        for item in data
    ]


# ---- Fixed values: metric map (unit, then tags from best to last) ----
METRICS = {
    "revenue": {
        "unit": "USD",
        "tags": [
            "RevenueFromContractWithCustomerExcludingAssessedTax",
            "RevenueFromContractWithCustomerIncludingAssessedTax",
            "Revenues",
            "SalesRevenueNet",
            "SalesRevenueGoodsNet",
            "SalesRevenueServicesNet",
        ],
    },
    "net_income": {
        "unit": "USD",
        "tags": [
            "NetIncomeLoss",
            "ProfitLoss",
            "NetIncomeLossAvailableToCommonStockholdersBasic",
        ],
    },
    "total_assets": {"unit": "USD", "tags": ["Assets"]},
    "total_equity": {
        "unit": "USD",
        "tags": [
            "StockholdersEquity",
            "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
        ],
    },
    "shares_outstanding_diluted": {
        "unit": "shares",
        "tags": [
            "WeightedAverageNumberOfDilutedSharesOutstanding",
            "WeightedAverageNumberOfSharesOutstandingBasic",
        ],
    },
    "operating_cash_flow": {
        "unit": "USD",
        "tags": [
            "NetCashProvidedByUsedInOperatingActivities",
            "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
        ],
    },
}

# ---- Fixed values: cross-vendor reconciliation rule ----
RECONCILIATION = [
    {
        "name": "price_close_cross_vendor",
        "left": {"source": "yfinance", "field": "adj_close"},
        "right": {"source": "tiingo", "field": "adj_close"},
        "tolerance": {"type": "relative", "value": 0.015},
        "severity": "WARN",
        "escalate_if": {"consecutive_days": 3, "severity": "BREAK"},
    }
]

# ---- Fixed values: days after which an unchanged payload is suspicious ----
EXPECTED_CHANGE_DAYS = {"edgar": 100, "yfinance": 3, "tiingo": 3}
DEFAULT_CHANGE_DAYS = 7
