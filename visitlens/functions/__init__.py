from visitlens.functions.dates import (
    after,
    before,
    date_hour,
    date_of_epoch_millis,
    format_date,
    format_date_key,
    format_minute_key,
    format_time,
    minus_seconds,
    parse_date_key,
    parse_time,
    timestamp_of_epoch_millis,
    today,
    yesterday,
)
from visitlens.functions.numbers import format_double, half_up_ratio, to_long
from visitlens.functions.text import (
    concat_long_string,
    group_concat_distinct,
    is_empty,
    is_not_empty,
    json_field,
    pad_two,
    random_prefix,
    remove_random_prefix,
    split_csv,
    string_field,
    trim_comma,
)

__all__ = [
    "after",
    "before",
    "concat_long_string",
    "date_hour",
    "date_of_epoch_millis",
    "format_date",
    "format_date_key",
    "format_double",
    "format_minute_key",
    "format_time",
    "group_concat_distinct",
    "half_up_ratio",
    "is_empty",
    "is_not_empty",
    "json_field",
    "minus_seconds",
    "pad_two",
    "parse_date_key",
    "parse_time",
    "random_prefix",
    "remove_random_prefix",
    "split_csv",
    "string_field",
    "timestamp_of_epoch_millis",
    "to_long",
    "today",
    "trim_comma",
    "yesterday",
]
