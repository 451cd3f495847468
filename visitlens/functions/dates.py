"""Date and time helpers. The session time zone is the zone of all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of dates and times.
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_KEY_FORMAT = "yyyyMMdd"
MINUTE_KEY_FORMAT = "yyyyMMddHHmm"
DATE_HOUR_FORMAT = "yyyy-MM-dd_HH"
# Reads both padded and unpadded hours.
TIME_PARSE_FORMAT = "yyyy-MM-dd H:mm:ss"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_time(value: Column | str) -> Column:
    """Text to timestamp; null when it cannot be read."""
    return F.try_to_timestamp(_col(value), F.lit(TIME_PARSE_FORMAT))


def parse_date_key(value: Column | str) -> Column:
    """``yyyyMMdd`` text to date; null when it cannot be read."""
    return F.try_to_timestamp(_col(value), F.lit(DATE_KEY_FORMAT)).cast("date")


def format_date(value: Column | str) -> Column:
    return F.date_format(_col(value), DATE_FORMAT)


def format_time(value: Column | str) -> Column:
    return F.date_format(_col(value), TIME_FORMAT)


def format_date_key(value: Column | str) -> Column:
    return F.date_format(_col(value), DATE_KEY_FORMAT)


def format_minute_key(value: Column | str) -> Column:
    return F.date_format(_col(value), MINUTE_KEY_FORMAT)


def date_hour(value: Column | str) -> Column:
    return F.date_format(_col(value), DATE_HOUR_FORMAT)


def before(left: Column | str, right: Column | str) -> Column:
    return _col(left) < _col(right)


def after(left: Column | str, right: Column | str) -> Column:
    return _col(left) > _col(right)


def minus_seconds(left: Column | str, right: Column | str) -> Column:
    """Difference of the whole seconds of two timestamps."""
    return F.unix_seconds(_col(left).cast("timestamp")) - F.unix_seconds(_col(right).cast("timestamp"))


# Fixed value: a timestamp counts microseconds in 64 bits.
MOST_MILLIS = (2**63 - 1) // 1000


def timestamp_of_epoch_millis(value: Column | str) -> Column:
    """Epoch milliseconds as text or number to timestamp; null when unreadable or beyond what a timestamp holds."""
    millis = _col(value).try_cast("bigint")
    return F.timestamp_millis(F.when(millis.between(-MOST_MILLIS, MOST_MILLIS), millis))


def date_of_epoch_millis(value: Column | str) -> Column:
    return timestamp_of_epoch_millis(value).cast("date")


def today() -> Column:
    return F.current_date()


def yesterday() -> Column:
    return F.date_sub(F.current_date(), 1)
