"""Exact distinct counts by bitmaps that can be merged: of days into weeks, of ads into campaigns, of batch into batch.

A key's ids are the bits of bitmaps of 32,768 ids each, so what is kept and shuffled is a few kilobytes per key and
range of ids instead of a list of ids, whatever the number of rows; a range without ids has no bitmap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET, BITMAP = "id_bucket", "id_bitmap"


def id_bitmaps(df: DataFrame, keys: Sequence[str | Column], id_col: str) -> DataFrame:
    """The ids of each key: the key, the number of a range of ids and the bitmap of those that occur. Null ids are left
    out; negative ids have ranges of their own."""
    known = df.where(F.col(id_col).isNotNull())
    bucket = F.bitmap_bucket_number(F.col(id_col)).alias(BUCKET)
    return known.groupBy(*keys, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col))).alias(BITMAP))


def merged_bitmaps(bitmaps: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of a coarser key: an id is in it if it is in any of those merged."""
    return bitmaps.groupBy(*keys, BUCKET).agg(F.bitmap_or_agg(F.col(BITMAP)).alias(BITMAP))


def common_bitmaps(bitmaps: DataFrame, keys: Sequence[str | Column], of: int) -> DataFrame:
    """Bitmaps of the ids that are in all ``of`` bitmaps that a key has to have; ranges that one of them lacks have none."""
    both = bitmaps.groupBy(*keys, BUCKET).agg(F.bitmap_and_agg(F.col(BITMAP)).alias(BITMAP), F.count(F.lit(1)).alias("held"))
    return both.where(F.col("held") == of).drop("held")


def id_counts(bitmaps: DataFrame, keys: Sequence[str | Column], name: str = "ids") -> DataFrame:
    """How many different ids each key has."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count(F.col(BITMAP))).alias(name))
