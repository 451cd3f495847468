"""Table scans: dates, clicks and JDBC dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.dates import parse_time
from visitlens.operators.filters import all_set
from visitlens.params import TaskParams
from visitlens.schemas import USER_VISIT_ACTION


def _in_dates(df: DataFrame, column: str, start: date | None, end: date | None) -> Column:
    # A text date is compared as text, so that the condition reaches the scan or the partitions.
    as_text = dict(df.dtypes)[column] == "string"

    def bound(day: date) -> Column:
        return F.lit(day.isoformat() if as_text else day)

    return all_set(
        None if start is None else F.col(column) >= bound(start),
        None if end is None else F.col(column) <= bound(end),
    )


def actions_in_range(actions: DataFrame, params: TaskParams) -> DataFrame:
    """Actions with start date <= date <= end date; a missing bound is open."""
    return actions.where(_in_dates(actions, "date", params.start_date, params.end_date))


def clicks_in_range(actions: DataFrame, params: TaskParams) -> DataFrame:
    """City and product of the product clicks in the date range."""
    clicks = actions_in_range(actions, params).where(F.col("click_product_id").isNotNull())
    return clicks.select("city_id", F.col("click_product_id").alias("product_id"))


def typed_actions(actions: DataFrame) -> DataFrame:
    """Actions with text dates and times (hour padded or not) turned into the typed layout.

    A time that cannot be read becomes null. Apply after the date range, which works on either.
    """
    kinds = dict(actions.dtypes)
    columns = []
    for field in USER_VISIT_ACTION:
        column = F.col(field.name)
        if field.name == "action_time" and kinds[field.name] == "string":
            column = parse_time(column)
        elif kinds[field.name] != field.dataType.simpleString():
            column = column.try_cast(field.dataType)
        columns.append(column.alias(field.name))
    return actions.select(*columns)


def jdbc_options(
    url: str,
    table: str,
    user: str,
    password: str,
    partition: tuple[str, int, int, int] | None = None,
    batch_size: int = 10_000,
) -> dict[str, str]:
    """Options of the JDBC source and sink.

    ``partition`` is (column, lower, upper, number): the read is then split into that many ranges.
    """
    options = {
        "url": url,
        "dbtable": table,
        "user": user,
        "password": password,
        "batchsize": str(batch_size),
        "fetchsize": str(batch_size),
    }
    if partition is not None:
        column, lower, upper, number = partition
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(number),
        }
    return options


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
