"""Session analysis: roll-up, filter, statistics and random extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.dates import minus_seconds
from visitlens.functions.numbers import half_up_ratio
from visitlens.operators.aggregates import count_buckets
from visitlens.operators.filters import all_set, any_of, between, equal_to, one_of
from visitlens.operators.joins import BROADCAST_ROWS, skew_join
from visitlens.operators.topk import top_per_group
from visitlens.params import TaskParams
from visitlens.schemas import USER_INFO, USER_VISIT_ACTION, require

# Visit length buckets in whole seconds, both ends inclusive. 0 s is in none.
VISIT_BUCKETS = (
    ("1s_3s", 1, 3),
    ("4s_6s", 4, 6),
    ("7s_9s", 7, 9),
    ("10s_30s", 10, 30),
    ("30s_60s", 31, 60),
    ("1m_3m", 61, 180),
    ("3m_10m", 181, 600),
    ("10m_30m", 601, 1800),
    ("30m", 1801, None),
)

# Step length buckets in actions, both ends inclusive.
STEP_BUCKETS = (
    ("1_3", 1, 3),
    ("4_6", 4, 6),
    ("7_9", 7, 9),
    ("10_30", 10, 30),
    ("30_60", 31, 60),
    ("60", 61, None),
)

DETAIL_COLUMNS = (
    "user_id",
    "session_id",
    "page_id",
    "action_time",
    "search_keyword",
    "click_category_id",
    "click_product_id",
    "order_category_ids",
    "order_product_ids",
    "pay_category_ids",
    "pay_product_ids",
)

_ROLL_UP_COLUMNS = ["session_id", "user_id", "action_time", "search_keyword", "click_category_id"]


def _category_ids(params: TaskParams) -> list[str] | None:
    # Compared as text by definition, so only canonical numbers can match a number.
    if params.category_ids is None:
        return None
    return [v for v in params.category_ids if v.lstrip("-").isdigit() and str(int(v)) == v]


def session_aggregate(actions: DataFrame, users: DataFrame, params: TaskParams | None = None) -> DataFrame:
    """One row per session of a known user, with its profile columns.

    ``keyword_hit`` and ``category_hit`` tell whether any action matches the parameters; they let
    a filter work on two booleans, and the optimizer drops the distinct lists where only the
    filter or the lengths are used.
    """
    require(actions, USER_VISIT_ACTION, _ROLL_UP_COLUMNS)
    require(users, USER_INFO)
    params = params or TaskParams()
    keyword = F.nullif(F.col("search_keyword"), F.lit(""))
    categories = _category_ids(params)
    keyword_hit = one_of("search_keyword", params.keywords)
    category_hit = None if categories is None else (
        F.coalesce(F.col("click_category_id").isin([int(c) for c in categories]), F.lit(False))
        if categories else F.lit(False)
    )
    rolled = actions.groupBy("session_id").agg(
        F.max("user_id").alias("user_id"),
        F.array_sort(F.collect_set(keyword)).alias("search_keywords"),
        F.array_sort(F.collect_set("click_category_id")).alias("click_category_ids"),
        F.min("action_time").alias("start_time"),
        minus_seconds(F.max("action_time"), F.min("action_time")).alias("visit_length"),
        F.count(F.lit(1)).alias("step_length"),
        F.bool_or(F.lit(True) if keyword_hit is None else keyword_hit).alias("keyword_hit"),
        F.bool_or(F.lit(True) if category_hit is None else category_hit).alias("category_hit"),
    )
    profile = users.select("user_id", "age", "professional", "city", "sex")
    return rolled.join(profile, "user_id").select(
        "session_id",
        "user_id",
        "search_keywords",
        "click_category_ids",
        "visit_length",
        "step_length",
        "start_time",
        "age",
        "professional",
        "city",
        "sex",
        "keyword_hit",
        "category_hit",
    )


def filter_sessions(sessions: DataFrame, params: TaskParams) -> DataFrame:
    """Sessions that meet every set parameter, judged by the session's own columns."""
    return sessions.where(
        all_set(
            between("age", params.start_age, params.end_age),
            one_of("professional", params.professionals),
            one_of("city", params.cities),
            equal_to("sex", params.sex),
            any_of("search_keywords", params.keywords),
            any_of("click_category_ids", _category_ids(params), "bigint"),
        )
    )


def qualified_sessions(actions: DataFrame, users: DataFrame, params: TaskParams) -> DataFrame:
    """``filter_sessions(session_aggregate(...))`` without building lists just to search them."""
    return session_aggregate(actions, users, params).where(
        all_set(
            between("age", params.start_age, params.end_age),
            one_of("professional", params.professionals),
            one_of("city", params.cities),
            equal_to("sex", params.sex),
            None if params.keywords is None else F.col("keyword_hit"),
            None if params.category_ids is None else F.col("category_hit"),
        )
    )


def session_counters(sessions: DataFrame) -> DataFrame:
    """Session count and the 15 bucket counts, one row."""
    return sessions.agg(
        F.count(F.lit(1)).alias("session_count"),
        *count_buckets("visit_length", VISIT_BUCKETS),
        *count_buckets("step_length", STEP_BUCKETS),
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    """Session count and the share of each bucket in two decimals; null shares without sessions."""
    total = F.col("session_count")
    names = [name for name, _, _ in VISIT_BUCKETS + STEP_BUCKETS]
    return session_counters(sessions).select(
        total, *[half_up_ratio(F.col(f"`{name}`"), total).alias(f"{name}_ratio") for name in names]
    )


def sessions_by_hour(sessions: DataFrame) -> DataFrame:
    """Number of sessions per start day and hour."""
    return _with_hour(sessions).groupBy("day", "hour").agg(F.count(F.lit(1)).alias("session_count"))


def _with_hour(sessions: DataFrame) -> DataFrame:
    return sessions.withColumns(
        {"day": F.to_date("start_time"), "hour": F.date_format("start_time", "HH")}
    )


def extraction_quota(sessions: DataFrame, total: int) -> DataFrame:
    """Sessions to draw per day and hour: ``total`` split evenly over days, then by share of the day.

    Both steps round down, so a wide date range may leave an hour with none.
    """
    hours = sessions_by_hour(sessions)
    # The days are counted over the hours, 24 rows a day, not by going over the sessions again.
    of_day = Window.partitionBy("day")
    first = F.row_number().over(of_day.orderBy("hour")) == 1
    counted = hours.withColumns({"day_count": F.sum("session_count").over(of_day), "first": first.cast("int")})
    days = F.sum("first").over(Window.partitionBy())
    share = F.col("session_count").cast("double") / F.col("day_count").cast("double")
    return counted.withColumn("per_day", F.floor(F.lit(total) / days)).select(
        "day",
        "hour",
        "session_count",
        F.least(F.floor(share * F.col("per_day")), F.col("session_count")).alias("quota"),
    )


def extract_session_ids(sessions: DataFrame, total: int = 100, seed: str = "0") -> DataFrame:
    """The drawn sessions (session_id, start_time): the first ``quota`` of each hour by seeded hash.

    Hours without a quota fall away before sessions are ranked, and no hour keeps more than its share of
    ``total``.
    """
    quota = extraction_quota(sessions, total).where(F.col("quota") > 0).select("day", "hour", "quota")
    wanted = _with_hour(sessions.select("session_id", "start_time")).join(quota, ["day", "hour"])
    candidates = top_per_group(
        wanted.withColumn("draw", F.md5(F.concat(F.lit(seed), F.col("session_id")))),
        ["day", "hour"],
        [F.col("draw"), F.col("session_id")],
        total,
        unique="session_id",
    )
    return candidates.where(F.col("rank") <= F.col("quota")).select("session_id", "start_time")


def extract_sessions(
    actions: DataFrame, users: DataFrame, params: TaskParams, total: int = 100, seed: str = "0"
) -> DataFrame:
    """The drawn sessions with their keywords and clicked categories.

    The lists are built for the drawn sessions only.
    """
    drawn = extract_session_ids(qualified_sessions(actions, users, params), total, seed)
    return extract_sessions_of(actions, drawn, total)


def extract_sessions_of(actions: DataFrame, drawn: DataFrame, total: int) -> DataFrame:
    """Start, keywords and clicked categories of the drawn sessions, of which there are at most ``total``."""
    return actions_of_sessions(actions, drawn, total).groupBy("session_id").agg(
        F.min("action_time").alias("start_time"),
        F.array_sort(F.collect_set(F.nullif(F.col("search_keyword"), F.lit("")))).alias("search_keywords"),
        F.array_sort(F.collect_set("click_category_id")).alias("click_category_ids"),
    )


def actions_of_sessions(actions: DataFrame, sessions: DataFrame, max_sessions: int) -> DataFrame:
    """Actions of the given sessions, of which there are at most ``max_sessions``."""
    wanted = sessions.select("session_id").distinct()
    if max_sessions <= BROADCAST_ROWS:
        return actions.join(F.broadcast(wanted), "session_id", "left_semi")
    return skew_join(actions, wanted, ["session_id"], "left_semi")


def session_details(actions: DataFrame, sessions: DataFrame, max_sessions: int) -> DataFrame:
    """Detail rows of the given sessions in the order of the result table."""
    return actions_of_sessions(actions, sessions, max_sessions).select(*DETAIL_COLUMNS)
