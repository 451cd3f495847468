"""The job's input tables as views over star-schema and event parquet files."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.params import TaskParams

# Area levels for the region names of the parquet files.
REGION_LEVELS = {"A Level": ("ASIA", "EUROPE"), "B Level": ("AMERICA",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint").alias("k")


def _midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def events_between(spark: SparkSession, sf_dir: str, params: TaskParams | None) -> DataFrame:
    """Events of the date range, bounded on ``ts`` itself so that the bound reaches the scan."""
    events = table(spark, sf_dir, "events")
    if params is not None and params.start_date is not None:
        events = events.where(F.col("ts") >= _midnight(params.start_date))
    if params is not None and params.end_date is not None:
        events = events.where(F.col("ts") < _midnight(params.end_date + timedelta(days=1)))
    return events


def user_visit_action(spark: SparkSession, sf_dir: str, params: TaskParams | None = None) -> DataFrame:
    events = events_between(spark, sf_dir, params).select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", _k()
    )
    k = F.col("k")

    def only(event_type: str, value: Column) -> Column:
        return F.when(F.col("event_type") == event_type, value)

    def pair(first: Column, second: Column) -> Column:
        return F.concat_ws(",", first.cast("string"), second.cast("string"))

    return events.select(
        F.col("ts").cast("date").alias("date"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        (k % 10).alias("page_id"),
        F.col("ts").alias("action_time"),
        only("view", F.concat(F.lit("kw"), (k % 10).cast("string"))).alias("search_keyword"),
        only("click", k % 20).alias("click_category_id"),
        only("click", k).alias("click_product_id"),
        only("signup", pair(k % 20, (k + 7) % 20)).alias("order_category_ids"),
        only("signup", pair(k, (k + 7) % 100)).alias("order_product_ids"),
        only("purchase", (k % 20).cast("string")).alias("pay_category_ids"),
        only("purchase", k.cast("string")).alias("pay_product_ids"),
        (F.col("user_id") % 25).alias("city_id"),
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("name"),
        (F.lit(18) + key % 43).cast("int").alias("age"),
        F.col("c_mktsegment").alias("professional"),
        F.col("n_name").alias("city"),
        F.when(key % 2 == 0, "male").otherwise("female").alias("sex"),
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("city_id"),
        F.col("n_name").alias("city_name"),
        F.col("r_name").alias("area"),
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.concat(F.lit('{"product_status": '), (key % 2).cast("string"), F.lit("}")).alias("extend_info"),
    )


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per customer, its parameters derived from the customer's row."""
    key = F.col("c_custkey")

    def entry(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}": ["'), value, F.lit('"]'))

    text = F.concat(
        F.lit("{"),
        F.concat_ws(
            ", ",
            entry("startAge", (F.lit(18) + key % 20).cast("string")),
            entry("endAge", (F.lit(40) + key % 20).cast("string")),
            entry("professionals", F.col("c_mktsegment")),
            F.when(key % 2 == 0, entry("sex", F.lit("male"))),
            F.when(key % 3 == 0, F.lit('"keywords": []')),
        ),
        F.lit("}"),
    )
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("task_id"),
        F.col("c_name").alias("task_name"),
        none.alias("create_time"),
        none.alias("start_time"),
        none.alias("finish_time"),
        none.alias("task_type"),
        none.alias("task_status"),
        text.alias("task_param"),
    )


def as_ad_clicks(events: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks and views of an events frame (batch or stream) as ad clicks."""
    clicks = events.where(F.col("event_type").isin("click", "view")).select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", _k(), (F.col("user_id") % 25).alias("city_id")
    )
    return clicks.join(cities, "city_id").select(
        "ts",
        F.col("area").alias("province"),
        F.col("city_name").alias("city"),
        "user_id",
        (F.col("k") % 10).alias("ad_id"),
    )


def ad_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ad_clicks(table(spark, sf_dir, "events"), city_info(spark, sf_dir))


def event_parts(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """The events in ``parts`` stretches of days of the month, the last one the longest."""
    number = F.least(F.floor((F.dayofmonth("ts") - 1) / (30 // parts)), F.lit(parts - 1))
    events = table(spark, sf_dir, "events")
    return [events.where(number == i) for i in range(parts)]


def ad_click_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A stream over event files that are put into ``folder``."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(folder)
    return as_ad_clicks(events, city_info(spark, sf_dir))


def ad_log(clicks: DataFrame, *others: str) -> DataFrame:
    """Ad clicks as log lines, with other columns that are to stay."""
    return clicks.select(
        *others,
        F.concat_ws(
            " ",
            F.unix_millis("ts").cast("string"),
            F.translate("province", " ", "_"),
            F.translate("city", " ", "_"),
            F.col("user_id").cast("string"),
            F.col("ad_id").cast("string"),
        ).alias("value")
    )
