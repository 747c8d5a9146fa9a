"""Bitemporal, point-in-time-correct analytics as lazy Spark DataFrame operators."""

from hindcast.plans.reader import PointInTime
from hindcast.schemas import OPEN_END, open_end

__all__ = ["OPEN_END", "PointInTime", "open_end"]
