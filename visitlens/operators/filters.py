"""Optional predicates: an unset parameter passes every row, a missing value fails a set one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def between(value: Column | str, start: int | None, end: int | None) -> Column | None:
    """Inclusive range, only when both bounds are set."""
    if start is None or end is None:
        return None
    return _col(value).between(start, end)


def one_of(value: Column | str, allowed: Sequence[str] | None) -> Column | None:
    """A scalar column is among the allowed values."""
    if allowed is None:
        return None
    return F.coalesce(_col(value).isin(list(allowed)), F.lit(False))


def any_of(values: Column | str, allowed: Sequence[str] | None, element: str = "string") -> Column | None:
    """An array column shares an element with the allowed values."""
    if allowed is None:
        return None
    wanted = F.array(*[F.lit(v).try_cast(element) for v in allowed]).cast(f"array<{element}>")
    return F.coalesce(F.arrays_overlap(_col(values), wanted), F.lit(False))


def equal_to(value: Column | str, wanted: str | None) -> Column | None:
    if wanted is None:
        return None
    return F.coalesce(_col(value) == wanted, F.lit(False))


def all_set(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are set; true when none is."""
    result = None
    for condition in conditions:
        if condition is not None:
            result = condition if result is None else result & condition
    return F.lit(True) if result is None else result
