"""String helpers as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_empty(value: Column | str) -> Column:
    """True for null and for the empty string."""
    return F.coalesce(_col(value) == "", F.lit(True))


def is_not_empty(value: Column | str) -> Column:
    return ~is_empty(value)


def trim_comma(value: Column | str) -> Column:
    """Drop one leading and one trailing comma."""
    return F.regexp_replace(_col(value), "^,|,$", "")


def pad_two(value: Column | str) -> Column:
    """Text of two characters as it is, anything else with a leading zero."""
    column = _col(value)
    return F.when(F.length(column) == 2, column).otherwise(F.concat(F.lit("0"), column))


def split_csv(value: Column | str) -> Column:
    """Comma-separated text to an array of strings."""
    return F.split(_col(value), ",")


def string_field(value: Column | str, name: str) -> Column:
    """Value of ``name`` in ``k=v|k=v`` text; null when absent, empty or containing ``=``."""
    pattern = rf"(?:^|\|)\Q{name}\E=([^=|]+)=*(?:\||$)"
    return F.nullif(F.regexp_extract(_col(value), pattern, 1), F.lit(""))


def json_field(value: Column | str, name: str) -> Column:
    """Top-level field of a JSON object as text; null for absent fields and invalid JSON."""
    return F.get_json_object(_col(value), f"$.{name}")


def concat_long_string(number: Column | str, text: Column | str, sep: str) -> Column:
    """``number``, ``sep`` and ``text`` joined; a null prints as the word ``null``."""
    return F.concat(
        F.coalesce(_col(number).cast("string"), F.lit("null")),
        F.lit(sep),
        F.coalesce(_col(text), F.lit("null")),
    )


def group_concat_distinct(value: Column | str, sep: str = ",") -> Column:
    """Aggregate: the distinct non-null values in ascending order, joined by ``sep``."""
    return F.array_join(F.array_sort(F.collect_set(_col(value))), sep)


def salt_of(columns: list[Column | str], buckets: int) -> Column:
    """Deterministic salt 0..buckets-1, so that a recomputed task salts its rows the same way."""
    return F.pmod(F.xxhash64(*[_col(c) for c in columns]), F.lit(buckets)).cast("int")


def random_prefix(value: Column | str, buckets: int, salt_on: list[Column | str]) -> Column:
    """``<salt>_<value>``, spreading equal values over ``buckets`` by a hash of ``salt_on``."""
    return F.concat(salt_of(salt_on, buckets).cast("string"), F.lit("_"), _col(value))


def remove_random_prefix(value: Column | str) -> Column:
    """Undo ``random_prefix``; later underscores are part of the value."""
    return F.regexp_replace(_col(value), "^[0-9]+_", "")
