"""Join helpers for bounded and for skewed sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DatetimeType, NumericType

from visitlens.functions.text import salt_of
from visitlens.settings import scratch_dir

# Rows of one key column, up to this number (some tens of MB), may be sent to every executor.
BROADCAST_ROWS = 500_000

# Column names reserved for salting.
SALT = "__salt"
_KEY = "__key"
_SALTS = "__salts"


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if the caller's proven row bound is small, else leave the choice to Spark."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def materialized(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: computed once, its size known."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shared_frames(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a frame to scratch once and reads it back; all of it is removed at the end."""
    root = scratch_dir(spark, "shared")
    number = count()

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(number)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _key_hash(on: Sequence[str | Column]) -> Column:
    return F.xxhash64(*on)


def _comparable(left: DataFrame, right: DataFrame, on: Sequence[str]) -> list[DataType]:
    """The types in which a plain join compares the keys: the wider of two numbers, the finer of two times.

    Equal values of different types have different hashes, so the hash needs one type. Other pairs of types
    are refused, because the plain join would read one side's text as the other's values.
    """
    types = []
    for name in on:
        pair = (left.schema[name].dataType, right.schema[name].dataType)
        alike = pair[0] == pair[1] or any(all(isinstance(t, kind) for t in pair) for kind in (NumericType, DatetimeType))
        if not alike:
            raise TypeError(f"{name} is {pair[0].simpleString()} on one side and {pair[1].simpleString()} on the other")
        types.append(pair[0] if pair[0] == pair[1] else left.select(name).union(right.select(name)).schema[0].dataType)
    return types


def hot_keys(df: DataFrame, on: Sequence[str | Column], parts: int = 1000) -> DataFrame:
    """Keys owning more than 1/``parts`` of all rows, with the number of salts that cuts them to that.

    A heavy-hitter sketch finds them in one pass without shuffling rows; by definition there are
    fewer than ``parts``. A key the sketch misses costs time, never rows.
    """
    top = F.call_function("approx_top_k", F.col(_KEY), F.lit(parts), F.lit(16 * parts))
    sketch = df.select(_key_hash(on).alias(_KEY)).agg(top.alias("top"), F.count(F.lit(1)).alias("rows"))
    share = F.col("hot.count") * parts / F.col("rows")
    return (
        sketch.select("rows", F.explode("top").alias("hot"))
        .where(share > 1)
        .select(F.col("hot.item").alias(_KEY), F.ceil(share).cast("int").alias(_SALTS))
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    parts: int = 1000,
) -> DataFrame:
    """Equi-join whose left side may hold very many rows of one key.

    Only rows of hot keys are salted: a hot left row gets a salt from a hash of its values and its
    input partition (the same again when a task is repeated), the right rows of that key are
    repeated once per salt, and all other rows keep salt 0. The rows are those of the plain join
    for any ``how`` that keeps matched or left rows. The left side is read twice, the first time, at
    once, for its key columns only.
    """
    if how not in ("inner", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot repeat the right side of a {how} join")
    types = _comparable(left, right, on)
    keys = [F.col(name).cast(kind) for name, kind in zip(on, types, strict=True)]
    # Fewer than parts rows; written once, so that both sides see the same numbers of salts.
    hot = F.broadcast(materialized(hot_keys(left, keys, parts), "hot-keys"))

    def with_salts(df: DataFrame) -> DataFrame:
        return df.withColumn(_KEY, _key_hash(keys)).join(hot, _KEY, "left_outer").drop(_KEY)

    values = [f.name for f in left.schema if f.dataType.typeName() not in ("map", "variant")]
    spread = F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.col(_SALTS)).cast("int")
    salted = with_salts(left).withColumn(SALT, F.coalesce(spread, F.lit(0))).drop(_SALTS)
    every = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    repeated = with_salts(right).withColumn(SALT, F.explode(every)).drop(_SALTS)
    return salted.join(repeated, [*on, SALT], how).drop(SALT)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    buckets: int = 10,
    salt_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join with every left key spread over ``buckets`` and the whole right side repeated.

    The blunt form, for a small right side of which every key is hot. Spark's size of a side does not count how often
    its rows are repeated, so both sides are shuffled by request: the copies never go through the driver.
    """
    if how not in ("inner", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot repeat the right side of a {how} join")
    salted = left.withColumn(SALT, salt_of(list(salt_on or left.columns), buckets))
    repeated = right.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return salted.join(repeated.hint("merge"), [*on, SALT], how).drop(SALT)


def without_keys(left: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows whose key is not in ``keys``.

    Few keys become a broadcast at run time, by their measured size; otherwise both sides are shuffled and
    adaptive execution splits a hot key of the left side.
    """
    return left.join(keys.select(*on).distinct(), list(on), "left_anti")
