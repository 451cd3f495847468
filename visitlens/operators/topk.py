"""Top rows overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.text import salt_of
from visitlens.operators.joins import SALT

# Below this n Spark itself keeps only n rows per group and task before the shuffle
# (default of spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in the given order; each task keeps n rows, no full sort."""
    return df.orderBy(*order).limit(n)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    unique: str | None = None,
    buckets: int = 256,
) -> DataFrame:
    """Rows with ``row_number() <= n`` within ``keys``; ``order`` must leave no ties.

    For large ``n`` a first pass ranks within (keys, hash of ``unique``), so that no task sorts
    a whole group; a row of the final top n is in the top n of its hash bucket as well.
    """
    if n >= GROUP_LIMIT and unique is not None:
        salted = Window.partitionBy(*keys, SALT).orderBy(*order)
        df = (
            df.withColumn(SALT, salt_of([unique], buckets))
            .withColumn(rank, F.row_number().over(salted))
            .where(F.col(rank) <= n)
            .drop(SALT, rank)
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
