"""Streaming totals, top ads per province and click trends.

The counts live in Spark's state store: each query is a windowed aggregation in update mode, so a micro-batch gives the
new totals of the keys it has clicks of, without a stored table being read to add to. A watermark bounds the state: a
click that is more than ``lateness`` behind the newest one is dropped, and counts of windows before that are
forgotten. The totals are put into the result tables of ``visitlens.sinks``.

Each ``start_*`` call starts one query that keeps its place and its state in the given checkpoint folder. ``once``
handles what is there now and stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlens.plans.ads import minute_windows_of_steps, province_top_ads, trend_columns, window_runs
from visitlens.sinks.results import put_rows, read_result, replace_days

# Fixed value: time between micro-batches.
BATCH_INTERVAL = "5 seconds"
# Width and step of the sliding window.
WINDOW_WIDTH, WINDOW_SLIDE = "60 minutes", "10 seconds"
#: How far a click may be behind the newest one: for counts per day, and for counts of a minute or less.
DAY_LATENESS, MINUTE_LATENESS = "1 day", "60 minutes"


def batch_trigger(once: bool) -> dict[str, object]:
    return {"availableNow": True} if once else {"processingTime": BATCH_INTERVAL}


def start(
    frame: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
    once: bool = False,
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``handle``."""
    return (
        frame.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**batch_trigger(once))
        .start()
    )


def windowed_totals(
    clicks: DataFrame, width: str, keys: list[str], lateness: str, amount: Column | None = None
) -> DataFrame:
    """The stateful step: clicks (``amount`` of a row, or one) per window of ``width`` of ``ts`` and ``keys``."""
    counted = F.count(F.lit(1)) if amount is None else F.sum(amount)
    timed = clicks.withWatermark("ts", lateness)
    totals = timed.groupBy(F.window("ts", width).alias("w"), *keys).agg(counted.alias("click_count"))
    return totals.select(F.col("w.start").alias("since"), *keys, "click_count")


def running_totals(clicks: DataFrame, lateness: str = DAY_LATENESS, amount: Column | None = None) -> DataFrame:
    """Running totals per day, province, city and ad."""
    totals = windowed_totals(clicks, "1 day", ["province", "city", "ad_id"], lateness, amount)
    return totals.select(F.to_date("since").alias("date"), "province", "city", "ad_id", "click_count")


def put_stat(stat: DataFrame, root: str, n: int | None = None) -> None:
    """Put totals into ``ad_stat``, and with ``n`` rank the ads of the days they belong to anew."""
    touched = put_rows(stat, "ad_stat", root)
    if n is not None and touched is not None:
        rows, days = touched
        replace_days(province_top_ads(rows, n), "ad_province_top3", root, days)


def start_ad_stat(
    clicks: DataFrame, root: str, checkpoint: str, once: bool = False, lateness: str = DAY_LATENESS
) -> StreamingQuery:
    """Keep ``ad_stat`` up to date."""
    return start(running_totals(clicks, lateness), lambda df, _: put_stat(df, root), checkpoint, once=once)


def start_province_top3(
    clicks: DataFrame, root: str, checkpoint: str, n: int = 3, once: bool = False, lateness: str = DAY_LATENESS
) -> StreamingQuery:
    """Keep ``ad_stat`` and ``ad_province_top3`` up to date."""
    return start(running_totals(clicks, lateness), lambda df, _: put_stat(df, root, n), checkpoint, once=once)


def start_click_trend(
    clicks: DataFrame, root: str, checkpoint: str, once: bool = False, lateness: str = MINUTE_LATENESS
) -> StreamingQuery:
    """Keep ``ad_click_trend``, clicks per minute and ad, up to date."""

    def handle(df: DataFrame, _: int) -> None:
        put_rows(trend_columns(df.withColumnRenamed("since", "minute")), "ad_click_trend", root)

    return start(windowed_totals(clicks, "1 minute", ["ad_id"], lateness), handle, checkpoint, once=once)


def start_click_steps(
    clicks: DataFrame,
    root: str,
    checkpoint: str,
    slide: str = WINDOW_SLIDE,
    once: bool = False,
    lateness: str = MINUTE_LATENESS,
) -> StreamingQuery:
    """Keep ``ad_click_step``, clicks per step of the sliding window, up to date. A click is one count in the state,
    however many windows it falls into; steps older than the lateness leave the state."""

    def handle(df: DataFrame, _: int) -> None:
        steps = df.withColumnRenamed("since", "step")
        put_rows(steps.withColumn("date", F.to_date("step")), "ad_click_step", root)

    return start(windowed_totals(clicks, slide, ["ad_id"], lateness), handle, checkpoint, once=once)


def read_sliding(
    spark: SparkSession, root: str, width: str = WINDOW_WIDTH, slide: str = WINDOW_SLIDE
) -> DataFrame:
    """Clicks per sliding window, minute and ad from the steps."""
    return minute_windows_of_steps(read_result(spark, "ad_click_step", root), width, slide)


def read_window_runs(
    spark: SparkSession, root: str, width: str = WINDOW_WIDTH, slide: str = WINDOW_SLIDE
) -> DataFrame:
    """Clicks per sliding window and ad as runs of successive windows with equal counts."""
    return window_runs(read_result(spark, "ad_click_step", root), ["ad_id"], width, slide)


def read_minutes(spark: SparkSession, root: str) -> DataFrame:
    """The click trend from the steps, which a minute is made of."""
    minute = F.date_trunc("minute", "step").alias("minute")
    steps = read_result(spark, "ad_click_step", root)
    return trend_columns(steps.groupBy(minute, "ad_id").agg(F.sum("click_count").alias("click_count")))
