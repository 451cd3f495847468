"""Aggregation helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from visitlens.functions.text import salt_of
from visitlens.operators.joins import SALT

Bucket = tuple[str, int, int | None]


def count_buckets(value: Column | str, buckets: Sequence[Bucket]) -> list[Column]:
    """One conditional count per ``(name, low, high)``, both inclusive; no high means open."""
    column = F.col(value) if isinstance(value, str) else value
    counts = []
    for name, low, high in buckets:
        inside = column >= low if high is None else column.between(low, high)
        counts.append(F.count_if(inside).alias(name))
    return counts


def salted_group_count(
    df: DataFrame, keys: Sequence[str], buckets: int, salt_on: Sequence[str], name: str = "count"
) -> DataFrame:
    """Rows per key in two steps: counts per (key, salt), then their sum.

    Spark already combines rows before the shuffle, so this only helps where that is off.
    """
    partial = df.withColumn(SALT, salt_of(list(salt_on), buckets)).groupBy(*keys, SALT).agg(
        F.count(F.lit(1)).alias(name)
    )
    return partial.groupBy(*keys).agg(F.sum(name).alias(name))


def observed_count(df: DataFrame, label: str) -> tuple[DataFrame, Observation]:
    """The same rows, plus their number once an action has run, without a job of its own."""
    observation = Observation(label)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
