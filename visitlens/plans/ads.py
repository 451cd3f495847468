"""Ad clicks, batch form: blacklist, totals, top ads per province and click trend."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.operators.bitmaps import common_bitmaps, id_bitmaps, id_counts
from visitlens.operators.joins import without_keys
from visitlens.operators.topk import top_per_group

BLACKLIST_CLICKS = 100


def with_date(clicks: DataFrame) -> DataFrame:
    return clicks.withColumn("date", F.to_date("ts"))


def user_ad_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks per day, user and ad."""
    return with_date(clicks).groupBy("date", "user_id", "ad_id").agg(F.count(F.lit(1)).alias("click_count"))


def blacklist(clicks: DataFrame, threshold: int = BLACKLIST_CLICKS) -> DataFrame:
    """Users with at least ``threshold`` clicks on one ad in one day."""
    return user_ad_clicks(clicks).where(F.col("click_count") >= threshold).select("user_id").distinct()


def daily_users(clicks: DataFrame) -> DataFrame:
    """The users of each day and ad, as bitmaps that add up to those of any days and ads."""
    return id_bitmaps(with_date(clicks), ["date", "ad_id"], "user_id")


def returning_users(users: DataFrame, first: date, second: date) -> DataFrame:
    """How many users each ad had on both of two days; ads without any are left out."""
    days = users.where(F.col("date").isin(first, second))
    return id_counts(common_bitmaps(days, ["ad_id"], 2), ["ad_id"], "users").where("users > 0")


def filter_blacklisted(clicks: DataFrame, listed: DataFrame) -> DataFrame:
    """Clicks of users that are not listed."""
    return without_keys(clicks, listed, ["user_id"])


def ad_stat(clicks: DataFrame) -> DataFrame:
    """Clicks per day, province, city and ad."""
    return with_date(clicks).groupBy("date", "province", "city", "ad_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )


def province_ad_clicks(stat: DataFrame) -> DataFrame:
    """Clicks per day, province and ad."""
    return stat.groupBy("date", "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top_ads(stat: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most clicked ads of each day and province."""
    ranked = top_per_group(
        province_ad_clicks(stat), ["date", "province"], [F.desc("click_count"), F.asc("ad_id")], n, unique="ad_id"
    )
    return ranked.drop("rank")


def trend_columns(per_minute: DataFrame) -> DataFrame:
    """(minute, ad_id, click_count) as the columns of the trend table."""
    return per_minute.select(
        F.to_date("minute").alias("date"),
        F.date_format("minute", "HH").alias("hour"),
        F.date_format("minute", "mm").alias("minute"),
        "ad_id",
        "click_count",
    )


def ad_click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks per minute and ad."""
    per_minute = clicks.groupBy(F.date_trunc("minute", "ts").alias("minute"), "ad_id").agg(
        F.count(F.lit(1)).alias("click_count")
    )
    return trend_columns(per_minute)


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
#: Window starts are numbered by slides; so many widths of them are handled together, apart from the others.
CHUNK_WIDTHS = 24


def _slides(width: str, slide: str) -> tuple[int, int]:
    """Seconds of a slide, and slides of a window."""
    seconds = [int(text.split()[0]) * _UNIT_SECONDS[text.split()[1].rstrip("s")] for text in (width, slide)]
    if seconds[0] % seconds[1]:
        raise ValueError(f"a window of {width} does not end on a slide of {slide}")
    return seconds[1], seconds[0] // seconds[1]


def window_runs(steps: DataFrame, keys: list[str], width: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Clicks per sliding window, as runs of successive windows with the same count.

    ``steps`` has the start of a slide (``step``), ``keys`` and ``click_count``. A step counts in the windows that start
    from a width before it up to itself: two changes of a running sum, however many windows these are. Per run: the
    keys, ``first`` (number of its first window: the start's seconds since 1970 over those of a slide), ``windows`` (how
    many it has) and ``click_count``. Runs without clicks are left out. Running sums go over a day's worth of window
    starts (CHUNK_WIDTHS widths), to which every step that reaches into them is cut, so a busy key is many groups.
    """
    seconds, held = _slides(width, slide)
    chunk = held * CHUNK_WIDTHS
    last = F.floor(F.unix_timestamp("step") / seconds)
    first = last - (held - 1)
    cut = steps.select(
        *keys,
        "click_count",
        first.alias("first"),
        last.alias("last"),
        F.explode(F.array_distinct(F.array(F.floor(first / chunk), F.floor(last / chunk)))).alias("chunk"),
    )
    begin = F.greatest("first", F.col("chunk") * chunk)
    end = F.least(F.col("last") + 1, (F.col("chunk") + 1) * chunk)
    changes = F.array(
        F.struct(begin.alias("at"), F.col("click_count").alias("change")),
        F.struct(end.alias("at"), (-F.col("click_count")).alias("change")),
    )
    changed = cut.select(*keys, "chunk", F.inline(changes)).groupBy(*keys, "chunk", "at").agg(F.sum("change").alias("change"))
    order = Window.partitionBy(*keys, "chunk").orderBy("at")
    runs = changed.select(
        *keys,
        F.col("at").alias("first"),
        (F.lead("at").over(order) - F.col("at")).alias("windows"),
        F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("click_count"),
    )
    return runs.where("click_count > 0")


def step_counts(clicks: DataFrame, slide: str = "10 seconds") -> DataFrame:
    """Clicks per step of a sliding window (the step's start) and ad."""
    return clicks.groupBy(F.window("ts", slide).start.alias("step"), "ad_id").agg(F.count(F.lit(1)).alias("click_count"))


def _each_window(runs: DataFrame, slide: str) -> DataFrame:
    """One row per window of the runs per minute and ad."""
    seconds, _ = _slides(slide, slide)
    number = F.explode(F.sequence("first", F.col("first") + F.col("windows") - 1)).alias("number")
    rows = runs.select("minute", "ad_id", "click_count", number)
    return rows.select(F.timestamp_seconds(F.col("number") * seconds).alias("window_start"), "minute", "ad_id", "click_count")


def minute_windows_of_steps(steps: DataFrame, width: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Clicks per window, minute and ad from the counts per step. The rows of the result are many, width over slide
    for each minute and ad; they come from the few runs of each minute and are shuffled nowhere."""
    of_minute = steps.withColumn("minute", F.date_trunc("minute", "step"))
    return _each_window(window_runs(of_minute, ["minute", "ad_id"], width, slide), slide)


def sliding_click_trend(
    clicks: DataFrame, width: str = "60 minutes", slide: str = "10 seconds"
) -> DataFrame:
    """Clicks per window, minute and ad.

    Clicks are first counted per slide step (windows begin and end on steps) and minute, so that a click is one count
    however many windows it falls into.
    """
    steps = clicks.groupBy(
        F.window("ts", slide).start.alias("step"), F.date_trunc("minute", "ts").alias("minute"), "ad_id"
    ).agg(F.count(F.lit(1)).alias("click_count"))
    return _each_window(window_runs(steps, ["minute", "ad_id"], width, slide), slide)
