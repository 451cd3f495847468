"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import visitlens.functions as fn
from oracle_queries import ORACLES
from visitlens.functions.sql import register_functions
from visitlens.operators import (
    any_of,
    between,
    equal_to,
    id_counts,
    merged_bitmaps,
    observed_count,
    one_of,
    salted_group_count,
    salted_join,
    skew_join,
)
from visitlens.params import TaskParams, task_param_fields
from visitlens.plans import ads, categories, jobs, pages, products, sessions
from visitlens.settings import prepare, scratch_dir
from visitlens.sinks import read_result
from visitlens.sources import (
    actions_in_range,
    append_segments,
    clicks_in_range,
    parse_ad_log,
    read_segments,
    rejected_ad_log,
    stream_segments,
    views,
)
from visitlens.streaming import ads as ads_stream
from visitlens.streaming import blacklist as blacklist_stream
from visitlens.streaming import metrics as stream_metrics

try:  # the training-data operators may be absent
    import corpus_pipeline
    from visitlens.llm import queries as llm_queries
except ImportError:
    LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    LLM_ORACLES: dict[str, str] = {}
else:
    LLM_QUERIES = {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}
    LLM_ORACLES = dict(llm_queries.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

RANGE = TaskParams(start_date=date(2024, 1, 3), end_date=date(2024, 1, 25))
FILTERED = TaskParams(
    start_date=RANGE.start_date,
    end_date=RANGE.end_date,
    start_age=20,
    end_age=50,
    professionals=("BUILDING", "MACHINERY", "HOUSEHOLD"),
    sex="male",
    keywords=("kw1", "kw3", "kw5", "kw7"),
)
EVER = TaskParams()
FLOW = (1, 2, 3, 4)
EXTRACT_TOTAL = 1000
LISTED_FROM = 2


# Inputs


def _actions(spark: SparkSession, sf_dir: str, params: TaskParams = RANGE) -> DataFrame:
    return actions_in_range(views.user_visit_action(prepare(spark), sf_dir, params), params)


def _sessions(spark: SparkSession, sf_dir: str, params: TaskParams = RANGE) -> DataFrame:
    return sessions.qualified_sessions(_actions(spark, sf_dir, params), views.user_info(spark, sf_dir), params)


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.visits_in_sessions(_actions(spark, sf_dir), _sessions(spark, sf_dir))


def _clicks(spark: SparkSession, sf_dir: str, params: TaskParams = RANGE) -> DataFrame:
    return clicks_in_range(_actions(spark, sf_dir, params), params)


def _ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ad_click(prepare(spark), sf_dir)


# Output forms


def _text_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", fn.format_date("date"))


def _detail(df: DataFrame) -> DataFrame:
    return df.withColumn("action_time", F.date_format("action_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _text_lists(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "search_keywords": F.array_join("search_keywords", ","),
            "click_category_ids": F.array_join(F.col("click_category_ids").cast("array<string>"), ","),
            "start_time": fn.format_time("start_time"),
        }
    )


def _session_rows(df: DataFrame) -> DataFrame:
    return _text_lists(df).drop("keyword_hit", "category_hit")


# Scans and sessions


def actions_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(_detail(_actions(spark, sf_dir)))


def session_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, users = _actions(spark, sf_dir), views.user_info(spark, sf_dir)
    return _session_rows(sessions.session_aggregate(actions, users))


def session_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_rows(_sessions(spark, sf_dir, FILTERED))


def filter_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, EVER).where(between("age", 25, 35)).select("session_id", "age")


def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sessions(spark, sf_dir, EVER).where(
        one_of("city", ("NATION_1", "NATION_4", "NATION_9"))
        & any_of("click_category_ids", ("1", "7", "12"), "bigint")
    )
    return found.select(
        "session_id", "city", F.array_join(F.col("click_category_ids").cast("array<string>"), ",").alias("click_category_ids")
    )


def filter_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir, EVER).where(equal_to("sex", "female")).select("session_id", "sex")


def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sessions.session_counters(_sessions(spark, sf_dir))
    names = {name: f"v_{name}" for name, _, _ in sessions.VISIT_BUCKETS}
    names |= {name: f"s_{name}" for name, _, _ in sessions.STEP_BUCKETS}
    return counted.withColumnsRenamed(names)


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_stats(_sessions(spark, sf_dir))


def session_stats_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_stats(_sessions(spark, sf_dir, FILTERED))


def session_count_by_date_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sessions.sessions_by_hour(_sessions(spark, sf_dir))
    return counted.select(F.concat_ws("_", fn.format_date("day"), "hour").alias("date_hour"), "session_count")


def session_extract_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    quota = sessions.extraction_quota(_sessions(spark, sf_dir), EXTRACT_TOTAL)
    return quota.withColumn("day", fn.format_date("day"))


def session_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, users = _actions(spark, sf_dir), views.user_info(spark, sf_dir)
    return _text_lists(sessions.extract_sessions(actions, users, RANGE, EXTRACT_TOTAL))


def session_extract_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = sessions.extract_session_ids(_sessions(spark, sf_dir), EXTRACT_TOTAL)
    return _detail(sessions.session_details(_actions(spark, sf_dir), drawn, EXTRACT_TOTAL))


# Categories


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.category_counts(_visits(spark, sf_dir))


def top10_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.top_categories(_visits(spark, sf_dir))


def category_session_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories.session_clicks(_visits(spark, sf_dir))


def top10_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _visits(spark, sf_dir)
    return categories.top_sessions_per_category(visits, categories.top_categories(visits))


def top10_session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detail(sessions.session_details(_actions(spark, sf_dir), top10_session(spark, sf_dir), 10 * 10))


# Products


def _area_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.area_product_click_count(_clicks(spark, sf_dir), views.city_info(spark, sf_dir))


def click_product_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.click_product_basic(_clicks(spark, sf_dir, EVER), views.city_info(spark, sf_dir))


def area_product_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.area_product_full(_area_counts(spark, sf_dir), views.product_info(spark, sf_dir))


def area_top3_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.area_top_products(
        views.user_visit_action(prepare(spark), sf_dir, RANGE),
        views.city_info(spark, sf_dir),
        views.product_info(spark, sf_dir),
        RANGE,
        levels=views.REGION_LEVELS,
    )


def salted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    basic = click_product_basic(spark, sf_dir).withColumn(
        "product_area", fn.concat_long_string("product_id", "area", ":")
    )
    return salted_group_count(basic, ["product_area"], 10, ["city_id"], "click_count")


def _joined_counts(spark: SparkSession, sf_dir: str, join: Callable[..., DataFrame]) -> DataFrame:
    described = views.product_info(spark, sf_dir).select("product_id", "product_name")
    joined = join(click_product_basic(spark, sf_dir), described, ["product_id"])
    return joined.groupBy("product_id", "product_name").agg(F.count(F.lit(1)).alias("click_count"))


def hot_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_counts(spark, sf_dir, skew_join)


def skew_join_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Int keys, half of them equal, against bigint keys."""
    clicks = _clicks(spark, sf_dir, EVER)
    half = F.when(F.col("product_id") % 2 == 0, F.lit(2)).otherwise(F.col("product_id")).cast("int")
    goods = views.product_info(spark, sf_dir).select("product_id", "product_name")
    joined = skew_join(clicks.select("city_id", half.alias("product_id")), goods, ["product_id"], "left_outer")
    return joined.groupBy(F.col("product_id").cast("bigint").alias("product_id"), "product_name").agg(
        F.count(F.lit(1)).alias("click_count")
    )


def blunt_salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_counts(spark, sf_dir, salted_join)


# Functions


def random_prefix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.product_info(spark, sf_dir).withColumn("val", fn.random_prefix("product_name", 10, ["product_id"]))
    return named.select(
        "product_id",
        fn.remove_random_prefix("val").alias("restored"),
        F.col("val").rlike("^[0-9]_").alias("prefixed"),
    )


def concat_string_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.concat(
        F.lit("professional="), segment, F.lit("|keywords=|age="), (key % 43).cast("string"), F.lit("|tail=a=b")
    )
    rows = views.table(spark, sf_dir, "customer").withColumn("text", text)
    return rows.select(
        key.alias("user_id"),
        fn.string_field("text", "professional").alias("professional"),
        fn.string_field("text", "keywords").alias("keywords"),
        fn.string_field("text", "age").alias("age"),
        fn.string_field("text", "tail").alias("absent"),
        fn.is_empty(F.when(key % 3 != 0, F.col("c_name"))).alias("empty_name"),
        fn.trim_comma(F.concat(F.lit(","), segment, F.lit(",x,"))).alias("trimmed"),
        fn.pad_two((key % 43).cast("string")).alias("padded"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(prepare(spark), sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    middle = fn.parse_time(F.lit("2024-01-15 0:00:00"))
    return rows.select(
        "event_id",
        fn.format_date("ts").alias("day"),
        fn.format_date_key("ts").alias("date_key"),
        fn.format_minute_key("ts").alias("minute_key"),
        fn.date_hour("ts").alias("date_hour"),
        fn.format_time(fn.parse_time(F.date_format("ts", "yyyy-MM-dd H:mm:ss"))).alias("parsed_time"),
        fn.format_date(fn.parse_date_key(fn.format_date_key("ts"))).alias("parsed_key"),
        fn.format_date(fn.date_of_epoch_millis(F.unix_millis("ts").cast("string"))).alias("millis_day"),
        fn.minus_seconds("ts", middle).alias("seconds_after"),
        fn.before("ts", middle).alias("is_before"),
        fn.after("ts", middle).alias("is_after"),
    )


def task_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = task_param_fields(views.task(spark, sf_dir))
    return fields.select("task_id", "startAge", "endAge", "professionals", "sex", "keywords")


def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by name and a hundred ids, so that no list grows with the table."""
    register_functions(spark)
    return spark.sql(
        """SELECT product_name, product_id DIV 100 AS ids,
                  group_concat_distinct(remove_random_prefix(random_prefix(
                      concat_long_string(product_id, product_name, ':'), 10, product_id))) AS labels,
                  group_concat_distinct(json_field(extend_info, 'product_status')) AS statuses
           FROM {products} GROUP BY product_name, product_id DIV 100""",
        products=views.product_info(spark, sf_dir),
    )


def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    eighth = F.col("p_size") / F.lit(8.0)
    return views.table(spark, sf_dir, "part").select(
        "p_partkey",
        fn.format_double(eighth, 2).alias("two"),
        fn.format_double(eighth, 0).alias("none"),
        fn.format_double(eighth, 1).alias("one"),
        F.date_diff(fn.today(), fn.yesterday()).alias("days"),
    )


def observed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ad clicks, observed while their totals per ad are worked out."""
    counted, rows = observed_count(_ads(spark, sf_dir), "ad clicks")
    totals = counted.groupBy("ad_id").agg(F.count(F.lit(1)).alias("click_count"))
    totals.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(rows.get["rows"],)], "click_rows bigint")


# Ad clicks


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ad_log(_ads(spark, sf_dir))


def ad_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = parse_ad_log(_log(spark, sf_dir))
    return clicks.select(fn.format_time("ts").alias("clicked_at"), "province", "city", "user_id", "ad_id")


def ad_log_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five ads are made unreadable, each in another way, and come back as rejected."""
    line, ad = F.col("value"), F.substring_index("value", " ", -1)
    broken = (
        F.when(ad == "3", F.concat(F.lit("x"), line))
        .when(ad == "4", F.regexp_replace(line, "^[0-9]+", "9223372036854775807"))
        .when(ad == "5", F.substring_index(line, " ", 3))
        .when(ad == "6", F.lit(""))
        .when(ad == "7", F.regexp_replace(line, " ([0-9]+) ([0-9]+)$", " u$1 $2"))
        .otherwise(line)
    )
    return rejected_ad_log(_log(spark, sf_dir).select(broken.alias("value")))


def ad_user_click_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads.user_ad_clicks(_ads(spark, sf_dir)))


def ad_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ads.blacklist(_ads(spark, sf_dir), LISTED_FROM)


def ad_daily_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per day and ad, from bitmaps."""
    return _text_date(id_counts(ads.daily_users(_ads(spark, sf_dir)), ["date", "ad_id"], "users"))


def ad_range_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per ad over all days, merged from the days' bitmaps."""
    return id_counts(merged_bitmaps(ads.daily_users(_ads(spark, sf_dir)), ["ad_id"]), ["ad_id"], "users")


def ad_returning_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of an ad on both of two days."""
    return ads.returning_users(ads.daily_users(_ads(spark, sf_dir)), date(2024, 1, 3), date(2024, 1, 4))


def ad_filtered_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ads.filter_blacklisted(_ads(spark, sf_dir), ad_blacklist(spark, sf_dir))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("clicked_at")
    return kept.select(stamp, "province", "city", "user_id", "ad_id")


def ad_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads.ad_stat(_ads(spark, sf_dir)))


def ad_stat_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads.ad_stat(ads.filter_blacklisted(_ads(spark, sf_dir), ad_blacklist(spark, sf_dir))))


def ad_province_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads.province_ad_clicks(ads.ad_stat(_ads(spark, sf_dir))))


def ad_province_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads.province_top_ads(ads.ad_stat(_ads(spark, sf_dir))))


def ad_click_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads.ad_click_trend(_ads(spark, sf_dir)))


def ad_click_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    slid = ads.sliding_click_trend(_ads(spark, sf_dir), "60 minutes", "10 minutes")
    return slid.withColumns(
        {name: F.date_format(name, "yyyy-MM-dd HH:mm") for name in ("window_start", "minute")}
    )


# Streams: the events come in several parts; after each the query starts again from its checkpoint, handles what
# is new as one batch and stops. Then its result table is read.
PARTS = 4


def _stream(spark: SparkSession, sf_dir: str, label: str, start: Callable[..., Any]) -> str:
    folder = scratch_dir(prepare(spark), label)
    for part in views.event_parts(spark, sf_dir, PARTS):
        part.write.mode("append").parquet(f"{folder}/events")
        clicks = views.ad_click_stream(spark, sf_dir, f"{folder}/events")
        started = start(clicks, folder, f"{folder}/state")
        for query in started if isinstance(started, list) else [started]:
            query.awaitTermination()
    return folder


LOG_PARTITIONS, LOG_PARTS = 3, 2


def _append_log(clicks: DataFrame, folder: str) -> None:
    """Click log lines at the end of a topic, each user's in one partition."""
    partition = F.pmod(F.xxhash64("user_id"), F.lit(LOG_PARTITIONS)).cast("int")
    lines = views.ad_log(clicks.withColumn("partition", partition), "partition")
    append_segments(lines, folder, "ad-log", ["value"], segment_lines=2_000)


def ad_log_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad clicks as a log with offsets, parsed; the offsets of each partition have no gaps."""
    folder = scratch_dir(prepare(spark), "ad-log")
    _append_log(_ads(spark, sf_dir), folder)
    log = read_segments(spark, folder, "ad-log")
    bounds = log.groupBy("partition").agg(F.min("offset").alias("low"), F.max("offset").alias("high"), F.count_distinct("offset").alias("n"))
    whole = bounds.where("low = 0 and high = n - 1").select("partition")  # a row per partition of the log
    clicks = parse_ad_log(log.join(F.broadcast(whole), "partition"))
    return clicks.select(fn.format_time("ts").alias("clicked_at"), "province", "city", "user_id", "ad_id")


def _log_stream(spark: SparkSession, sf_dir: str, label: str, start: Callable[[DataFrame, str], Any]) -> str:
    """The ad clicks as a log that grows in parts; a stream over it starts again from its offsets after each."""
    folder, cities = scratch_dir(prepare(spark), label), views.city_info(spark, sf_dir)
    for part in views.event_parts(spark, sf_dir, LOG_PARTS):
        _append_log(views.as_ad_clicks(part, cities), folder)
        start(stream_segments(spark, folder, "ad-log"), folder).awaitTermination()
    return folder


def stream_log_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running totals over a log with offsets."""

    def begin(log: DataFrame, folder: str) -> Any:
        return ads_stream.start_ad_stat(parse_ad_log(log), folder, f"{folder}/state", once=True)

    return _text_date(read_result(spark, "ad_stat", _log_stream(spark, sf_dir, "log-stat", begin)))


def stream_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, readable and rejected ones per batch of the log stream, as the query's listener heard of them. The lines of
    one ad are made unreadable."""
    listener = stream_metrics.BatchCounts()
    spark.streams.addListener(listener)

    def begin(log: DataFrame, folder: str) -> Any:
        broken = F.when(F.substring_index("value", " ", -1) == "3", F.concat(F.lit("x"), "value")).otherwise(F.col("value"))
        clicks = stream_metrics.observed_clicks(log.withColumn("value", broken))
        query = (
            clicks.writeStream.format("parquet")
            .options(path=f"{folder}/clicks", checkpointLocation=f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        listener.wait_for(query)
        return query

    try:
        _log_stream(spark, sf_dir, "log-metrics", begin)
    finally:
        spark.streams.removeListener(listener)
    return stream_metrics.counted_batches(spark, listener).select("batch", "rows", "accepted", "rejected")


def stream_ad_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream(spark, sf_dir, "ad-stat", partial(ads_stream.start_ad_stat, once=True))
    return _text_date(read_result(spark, "ad_stat", folder))


def stream_interval_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running totals by one query that goes on while the parts come in, at its interval between batches."""
    folder, query = scratch_dir(prepare(spark), "interval-stat"), None
    try:
        for part in views.event_parts(spark, sf_dir, LOG_PARTS):
            part.write.mode("append").parquet(f"{folder}/events")
            if query is None:
                clicks = views.ad_click_stream(spark, sf_dir, f"{folder}/events")
                query = ads_stream.start_ad_stat(clicks, folder, f"{folder}/state")
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    return _text_date(read_result(spark, "ad_stat", folder))


def stream_province_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream(spark, sf_dir, "province-top3", partial(ads_stream.start_province_top3, once=True))
    return _text_date(read_result(spark, "ad_province_top3", folder))


def stream_click_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stream(spark, sf_dir, "click-trend", partial(ads_stream.start_click_trend, once=True))
    return _text_date(read_result(spark, "ad_click_trend", folder))


def _click_steps(spark: SparkSession, sf_dir: str) -> str:
    return _stream(spark, sf_dir, "click-steps", partial(ads_stream.start_click_steps, once=True))


def stream_window_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(ads_stream.read_minutes(spark, _click_steps(spark, sf_dir)))


def stream_sliding_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 60 minutes every 10 seconds: how many there are per ad, and the clicks of the busiest."""
    runs = ads_stream.read_window_runs(spark, _click_steps(spark, sf_dir))
    clicks = F.col("windows") * F.col("click_count")
    return runs.groupBy("ad_id").agg(
        F.sum("windows").alias("windows"), F.sum(clicks).alias("clicks"), F.max("click_count").alias("busiest")
    )


def _stream_users(spark: SparkSession, sf_dir: str) -> str:
    start = partial(blacklist_stream.start_users, threshold=LISTED_FROM, once=True)
    return _stream(spark, sf_dir, "blacklist", start)


def stream_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_result(spark, "ad_blacklist", _stream_users(spark, sf_dir))


def stream_user_click_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_date(read_result(spark, "ad_user_click_count", _stream_users(spark, sf_dir)))


def ad_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ad job: the top ads per province of the accepted clicks."""
    start = partial(jobs.start_click_job, threshold=LISTED_FROM, once=True)
    return _text_date(read_result(spark, "ad_province_top3", _stream(spark, sf_dir, "ad-job", start)))


# Whole jobs: written to result tables and read back


def session_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of the five result tables of the session job, each row as one text."""
    actions, folder = views.user_visit_action(prepare(spark), sf_dir, RANGE), scratch_dir(spark, "session-job")
    jobs.run_session_job(actions, views.user_info(spark, sf_dir), RANGE, folder, 1, EXTRACT_TOTAL)

    def rows(name: str, **texts: Column) -> DataFrame:
        table = read_result(spark, name, folder).drop("task_id").withColumns(texts)
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in table.columns])
        return table.select(F.lit(name).alias("table_name"), text.alias("content"))

    stamp = F.date_format("action_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    stats = read_result(spark, "session_aggr_stat", folder)
    shares = [F.format_string("%.2f", F.col(c)) for c in stats.columns if c.endswith("_ratio")]
    stat = stats.select(
        F.lit("session_aggr_stat").alias("table_name"), F.concat_ws("|", F.col("session_count").cast("string"), *shares).alias("content")
    )
    others = [
        rows("session_random_extract", start_time=fn.format_time("start_time")),
        rows("session_detail", action_time=stamp),
        rows("top10_category"),
        rows("top10_session"),
    ]
    return reduce(DataFrame.unionByName, others, stat)


def product_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "product-job")
    actions = views.user_visit_action(prepare(spark), sf_dir, RANGE)
    cities, goods = views.city_info(spark, sf_dir), views.product_info(spark, sf_dir)
    jobs.run_product_job(actions, cities, goods, RANGE, folder, 2, levels=views.REGION_LEVELS)
    return read_result(spark, "area_top3_product", folder)


# Pages


def page_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(prepare(spark), "page-job")
    jobs.run_page_job(views.user_visit_action(spark, sf_dir, EVER), TaskParams(page_flow=FLOW), folder, 3)
    return read_result(spark, "page_split_convert_rate", folder)


def page_flow_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_flow_conversion(_actions(spark, sf_dir, EVER), FLOW)


def page_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_steps(_actions(spark, sf_dir, EVER))


# The driver's three functions


def entry(spark: SparkSession) -> DataFrame:
    """Top three products of each area."""
    return area_top3_product(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query by name."""
    return {
        "actions_date_range": actions_date_range,
        "clicks_date_range": _clicks,
        "session_aggregate": session_aggregate,
        "session_filter_all": session_filter_all,
        "filter_between": filter_between,
        "filter_in_list": filter_in_list,
        "filter_equal": filter_equal,
        "session_counters": session_counters,
        "session_stats": session_stats,
        "session_stats_filtered": session_stats_filtered,
        "session_count_by_date_hour": session_count_by_date_hour,
        "session_extract_quota": session_extract_quota,
        "session_extract": session_extract,
        "session_extract_detail": session_extract_detail,
        "category_counts": category_counts,
        "top10_category": top10_category,
        "category_session_clicks": category_session_clicks,
        "top10_session": top10_session,
        "top10_session_detail": top10_session_detail,
        "click_product_basic": click_product_basic,
        "area_product_click_count": _area_counts,
        "area_product_full": area_product_full,
        "area_top3_product": area_top3_product,
        "salted_group_count": salted_count,
        "salted_join": blunt_salted_join,
        "skew_join": hot_key_join,
        "skew_join_types": skew_join_types,
        "random_prefix_round_trip": random_prefix_round_trip,
        "concat_string_field": concat_string_field,
        "date_functions": date_functions,
        "task_param_fields": task_params,
        "registered_functions": registered_functions,
        "number_functions": number_functions,
        "observed_rows": observed_rows,
        "ad_log_parse": ad_log_parse,
        "ad_log_rejects": ad_log_rejects,
        "ad_log_segments": ad_log_segments,
        "ad_daily_users": ad_daily_users,
        "ad_range_users": ad_range_users,
        "ad_returning_users": ad_returning_users,
        "ad_user_click_count": ad_user_click_count,
        "ad_blacklist": ad_blacklist,
        "ad_filtered_clicks": ad_filtered_clicks,
        "ad_stat": ad_stat,
        "ad_stat_filtered": ad_stat_filtered,
        "ad_province_clicks": ad_province_clicks,
        "ad_province_top3": ad_province_top3,
        "ad_click_trend": ad_click_trend,
        "ad_click_sliding": ad_click_sliding,
        "stream_ad_stat": stream_ad_stat,
        "stream_interval_stat": stream_interval_stat,
        "stream_province_top3": stream_province_top3,
        "stream_click_trend": stream_click_trend,
        "stream_window_trend": stream_window_trend,
        "stream_sliding_trend": stream_sliding_trend,
        "stream_blacklist": stream_blacklist,
        "stream_user_click_count": stream_user_click_count,
        "stream_log_stat": stream_log_stat,
        "stream_log_metrics": stream_log_metrics,
        "session_job": session_job,
        "product_job": product_job,
        "page_job": page_job,
        "ad_job": ad_job,
        "page_flow_conversion": page_flow_conversion,
        "page_steps": page_steps,
        **LLM_QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    """The same queries in SQL."""
    return {**ORACLES, **LLM_ORACLES}
