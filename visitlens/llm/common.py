"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.settings import scratch_dir

#: Rows in one Arrow batch: documents may be long, so a batch stays small.
BATCH_ROWS = "512"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: it is computed once, survives lost
    executors, and values that depend on the partition (row numbers) are fixed from here on."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Remove the files of a frame that ``saved`` gave and nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text: equal texts share them."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def columns_of(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under internal names; whatever else ``df`` holds cannot clash."""
    return df.select(*[F.col(f"`{given}`").alias(own) for own, given in names.items()])
