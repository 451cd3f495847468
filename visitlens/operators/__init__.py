from visitlens.operators.aggregates import count_buckets, observed_count, salted_group_count
from visitlens.operators.bitmaps import common_bitmaps, id_bitmaps, id_counts, merged_bitmaps
from visitlens.operators.filters import any_of, between, equal_to, one_of
from visitlens.operators.joins import (
    bounded_broadcast,
    hot_keys,
    materialized,
    salted_join,
    skew_join,
    without_keys,
)
from visitlens.operators.numbering import numbered_rows
from visitlens.operators.topk import top_per_group, top_rows

__all__ = [
    "any_of",
    "between",
    "bounded_broadcast",
    "common_bitmaps",
    "count_buckets",
    "equal_to",
    "hot_keys",
    "id_bitmaps",
    "id_counts",
    "materialized",
    "merged_bitmaps",
    "numbered_rows",
    "observed_count",
    "one_of",
    "salted_group_count",
    "salted_join",
    "skew_join",
    "top_per_group",
    "top_rows",
    "without_keys",
]
