"""Numbers for the rows of each key in order, without a task that sees all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.operators.joins import materialized

_PART_BITS = 33  # of a monotonically increasing id, the row's place within its partition


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """``df`` with the number of each row, from 0 without gaps, among the rows of its key in the given order.

    Rows are dealt into ranges of key and order and sorted there; how many rows of a key the ranges before hold
    gives the rest. So a key may own most rows. Rows that are equal in the order are numbered as they come, once and for
    all: the numbered rows are written to the scratch folder. Null keys are a key of their own.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorting = [*[F.asc(k) for k in keys], *order]
    # What the order leaves open is settled by the row itself, so that equal rows can be cut between ranges.
    told = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(parts, *sorting, "__tie").sortWithinPartitions(*sorting, "__tie").drop("__tie")
    placed = materialized(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _PART_BITS).alias("__part")
    held = placed.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = held.select(*[F.col(k).alias(f"__{k}") for k in keys], "__part", (before - F.col("__first")).alias("__shift"))
    rows = placed.withColumn("__of", part)
    same = F.col("__of") == F.col("__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(begins, same).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))
