"""Ad click log: Kafka or file stream of ``<epoch ms> <province> <city> <user id> <ad id>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.dates import timestamp_of_epoch_millis
from visitlens.functions.numbers import to_long


def kafka_options(brokers: str, topics: str, starting: str = "latest") -> dict[str, str]:
    """Options of the Kafka source; ``topics`` is a comma-separated list."""
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(t.strip() for t in topics.split(",") if t.strip()),
        "startingOffsets": starting,
    }


def read_kafka_log(spark: SparkSession, brokers: str, topics: str, starting: str = "latest") -> DataFrame:
    """Streaming frame (key, value) of text. Needs the Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").options(**kafka_options(brokers, topics, starting)).load()
    return stream.select(F.col("key").cast("string"), F.col("value").cast("string"))


def read_log_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Streaming frame (value) over text files, the stand-in where there is no Kafka."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parsed_log(log: DataFrame, column: str) -> DataFrame:
    """The log with its lines as ``click``, whose fields are null where a line is not readable."""
    parts = F.split(F.col(column), " ")

    def part(index: int) -> Column:
        return F.get(parts, F.lit(index))

    return log.withColumn(
        "click",
        F.struct(
            timestamp_of_epoch_millis(part(0)).alias("ts"),
            part(1).alias("province"),
            part(2).alias("city"),
            to_long(part(3)).alias("user_id"),
            to_long(part(4)).alias("ad_id"),
        ),
    )


def readable() -> Column:
    """Whether all fields of ``click`` are there."""
    names = ("ts", "province", "city", "user_id", "ad_id")
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col(f"click.{name}").isNotNull()
    return whole


def parse_ad_log(log: DataFrame, column: str = "value") -> DataFrame:
    """Clicks (ts, province, city, user_id, ad_id) of the readable lines; batch or streaming."""
    return parsed_log(log, column).where(readable()).select("click.*")


def rejected_ad_log(log: DataFrame, column: str = "value") -> DataFrame:
    """The lines ``parse_ad_log`` leaves out."""
    return parsed_log(log, column).where(~readable()).select(column)
