"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_long(value: Column | str) -> Column:
    """Text to bigint, null for text that is no whole number."""
    column = F.col(value) if isinstance(value, str) else value
    return column.try_cast("bigint")


def half_up_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` rounded half up to two decimals in whole numbers; null when whole is 0."""
    safe = F.nullif(whole, F.lit(0))
    return F.call_function("div", part * 200 + safe, safe * 2) / F.lit(100)


def format_double(value: Column | str, scale: int) -> Column:
    """Round half up to ``scale`` decimals, judged by the decimal form of the number."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, scale)
