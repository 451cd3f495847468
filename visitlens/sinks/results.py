"""The result tables: their columns, how new rows meet old ones, and how they are written and read.

A job's rows of a task have a folder of their own, so a job that runs again replaces them.

A stream's rows replace those of the same key. What a micro-batch makes of the days it touches is first written as a
whole beside the table, in one of two places in turn; from the moment it is complete readers take these days from
there, so a batch becomes visible at once. Then Spark overwrites the partitions of these days in the table. A
batch that was killed anywhere between is simply handled again: the rows are totals, so putting them once more
changes nothing, and a half-written table is covered by the complete days beside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The number under which a batch's days are written beside a table.
SEQUENCE = "sequence"


@dataclass(frozen=True)
class ResultTable:
    """Columns in order, and for streamed tables the key by which new rows replace old ones."""

    columns: tuple[str, ...]
    key: tuple[str, ...] = ()


_RATIOS = tuple(
    f"{name}_ratio"
    for name in (
        "1s_3s", "4s_6s", "7s_9s", "10s_30s", "30s_60s", "1m_3m", "3m_10m", "10m_30m", "30m",
        "1_3", "4_6", "7_9", "10_30", "30_60", "60",
    )
)

# Result tables and their column order.
RESULT_TABLES = {
    "session_aggr_stat": ResultTable(("task_id", "session_count", *_RATIOS)),
    "session_random_extract": ResultTable(
        ("task_id", "session_id", "start_time", "search_keywords", "click_category_ids")
    ),
    "session_detail": ResultTable(
        (
            "task_id", "user_id", "session_id", "page_id", "action_time", "search_keyword",
            "click_category_id", "click_product_id", "order_category_ids", "order_product_ids",
            "pay_category_ids", "pay_product_ids",
        )
    ),
    "top10_category": ResultTable(("task_id", "category_id", "click_count", "order_count", "pay_count")),
    "top10_session": ResultTable(("task_id", "category_id", "session_id", "click_count")),
    "page_split_convert_rate": ResultTable(("task_id", "convert_rate")),
    "area_top3_product": ResultTable(
        (
            "task_id", "area", "area_level", "product_id", "city_infos", "click_count",
            "product_name", "product_status",
        )
    ),
    "ad_user_click_count": ResultTable(("date", "user_id", "ad_id", "click_count"), ("date", "user_id", "ad_id")),
    "ad_blacklist": ResultTable(("user_id",), ("user_id",)),
    "ad_stat": ResultTable(("date", "province", "city", "ad_id", "click_count"), ("date", "province", "city", "ad_id")),
    "ad_province_top3": ResultTable(("date", "province", "ad_id", "click_count"), ("date", "province", "ad_id")),
    "ad_click_trend": ResultTable(
        ("date", "hour", "minute", "ad_id", "click_count"), ("date", "hour", "minute", "ad_id")
    ),
    # Clicks per step of time, of which sliding windows are made on reading; no table of the given ones.
    "ad_click_step": ResultTable(("date", "step", "ad_id", "click_count"), ("date", "step", "ad_id")),
}

_TYPES = {
    "date": "date", "user_id": "bigint", "ad_id": "bigint", "click_count": "bigint", "step": "timestamp",
    "province": "string", "city": "string", "hour": "string", "minute": "string",
}


def _laid_out(df: DataFrame, name: str, task_id: int | None) -> DataFrame:
    table = RESULT_TABLES[name]
    if "task_id" in table.columns and task_id is not None:
        df = df.withColumn("task_id", F.lit(task_id).cast("bigint"))
    return df.select(*table.columns)


def write_result(df: DataFrame, name: str, root: str, task_id: int) -> None:
    """Write a job's rows of one task below ``root``; the same task written again replaces itself."""
    _laid_out(df, name, task_id).drop("task_id").write.mode("overwrite").parquet(f"{root}/{name}/task_id={task_id}")


def write_jdbc(df: DataFrame, name: str, options: dict[str, str], task_id: int | None = None) -> None:
    """Append a job's rows to a database table, one connection and batched inserts per partition."""
    _laid_out(df, name, task_id).write.format("jdbc").options(**options).mode("append").save()


# Streamed tables


def _schema(name: str) -> str:
    return ", ".join(f"{c} {_TYPES[c]}" for c in RESULT_TABLES[name].columns)


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _beside(spark: SparkSession, name: str, root: str) -> tuple[int, str]:
    """Number and folder of the newest complete days beside a table; number 0 if there are none yet."""
    newest = 0, ""
    for place in ("a", "b"):
        path = f"{root}/_days/{name}/{place}"
        names = _listed(spark, path)
        numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{SEQUENCE}=")]
        if "_SUCCESS" in names and numbers:
            newest = max(newest, (numbers[0], place))
    return newest


def _read_beside(spark: SparkSession, name: str, path: str) -> DataFrame:
    rows = spark.read.schema(f"{_schema(name)}, {SEQUENCE} bigint").parquet(path)
    return rows.select(*RESULT_TABLES[name].columns)


def days_of(df: DataFrame) -> list:
    """The days of a batch's rows, of which a micro-batch has few."""
    return sorted(r["date"] for r in df.select("date").where("date is not null").distinct().collect())


def read_days(spark: SparkSession, name: str, root: str, days: list | None = None) -> DataFrame:
    """The rows of a streamed table, of all days or of some; only the folders of these are read."""
    if _listed(spark, f"{root}/{name}"):
        rows = spark.read.schema(_schema(name)).parquet(f"{root}/{name}").select(*RESULT_TABLES[name].columns)
    else:
        rows = spark.createDataFrame([], _schema(name))
    number, place = _beside(spark, name, root)
    if number:
        path = f"{root}/_days/{name}/{place}"
        folders = _listed(spark, f"{path}/{SEQUENCE}={number}")
        complete = [date.fromisoformat(f.split("=")[1]) for f in folders if f.startswith("date=")]
        rows = rows.where(~F.col("date").isin(complete)).unionByName(_read_beside(spark, name, path))
    return rows if days is None else rows.where(F.col("date").isin(days))


def _dealt(df: DataFrame, name: str, days: int) -> DataFrame:
    """Rows dealt by day and key into as many parts as a shuffle has, so that a day has few files if there are many days,
    and a single large day is no single task's."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    slice_of_day = F.pmod(F.xxhash64(*RESULT_TABLES[name].key), F.lit(max(parts // max(days, 1), 1)))
    return df.repartition(parts, "date", slice_of_day)


def replace_days(df: DataFrame, name: str, root: str, days: int = 1) -> DataFrame:
    """Replace all rows of the days that ``df`` has rows of, and give these rows as they are stored. ``days`` says how
    many days these are, roughly: a day is written in more files if they are few."""
    spark = df.sparkSession
    number, place = _beside(spark, name, root)
    path = f"{root}/_days/{name}/{'b' if place == 'a' else 'a'}"
    placed = _dealt(_laid_out(df, name, None), name, days).withColumn(SEQUENCE, F.lit(number + 1))
    placed.write.mode("overwrite").partitionBy(SEQUENCE, "date").parquet(path)
    rows = _read_beside(spark, name, path)
    writer = rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    writer.partitionBy("date").parquet(f"{root}/{name}")
    return rows


def put_rows(df: DataFrame, name: str, root: str) -> tuple[DataFrame, int] | None:
    """Put rows into a streamed table, each in place of the row of its key; other days are neither read nor written.

    ``df`` has one row per key. Gives all rows of the days it touches, and how many days these are; None without any.
    """
    fresh = _laid_out(df, name, None).persist()
    try:
        days = days_of(fresh)
        if not days:
            return None
        stored = read_days(df.sparkSession, name, root, days)
        same = reduce(Column.__and__, (stored[c].eqNullSafe(fresh[c]) for c in RESULT_TABLES[name].key))
        kept = stored.join(fresh, same, "left_anti")
        return replace_days(kept.unionByName(fresh), name, root, len(days)), len(days)
    finally:
        fresh.unpersist()


def read_result(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The rows of a result table, in the table's column order."""
    if name == "ad_blacklist":
        return read_listed(spark, root)
    if RESULT_TABLES[name].key:
        return read_days(spark, name, root)
    rows = spark.read.parquet(f"{root}/{name}")
    return rows.withColumn("task_id", F.col("task_id").cast("bigint")).select(*RESULT_TABLES[name].columns)


#: What the blacklist's state gives out per batch: the stream that all tables of accepted clicks are made of.
ACCEPTED_TABLE = "ad_accepted"
ACCEPTED_SCHEMA = (
    "user_id bigint, date date, province string, city string, ad_id bigint, click_count bigint, kind string"
)


def read_listed(spark: SparkSession, root: str) -> DataFrame:
    """The listed users: each was written once, with the batch that listed it."""
    if not _listed(spark, f"{root}/{ACCEPTED_TABLE}/_spark_metadata"):
        return spark.createDataFrame([], "user_id bigint")
    rows = spark.read.schema(ACCEPTED_SCHEMA).parquet(f"{root}/{ACCEPTED_TABLE}")
    return rows.where("kind = 'listed'").select("user_id")
