"""The jobs from input tables to result tables. Nothing is written before a frame is complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlens.operators.joins import shared_frames
from visitlens.params import TaskParams
from visitlens.plans.categories import top_categories_of, top_sessions_of, visit_counts, visits_in_sessions
from visitlens.plans.pages import page_flow_conversion
from visitlens.plans.products import AREA_LEVELS, area_top_products
from visitlens.plans.sessions import (
    DETAIL_COLUMNS,
    actions_of_sessions,
    extract_session_ids,
    extract_sessions_of,
    qualified_sessions,
    session_stats,
)
from visitlens.sinks.results import write_result
from visitlens.sources.tables import actions_in_range, typed_actions
from visitlens.streaming.ads import DAY_LATENESS, start_click_trend
from visitlens.streaming.blacklist import start_blacklist_job


def run_session_job(
    actions: DataFrame,
    users: DataFrame,
    params: TaskParams,
    root: str,
    task_id: int,
    total: int = 100,
    seed: str = "0",
    top: int = 10,
) -> None:
    """Session statistics, drawn sessions, top categories and their top sessions of one task.

    Frames that serve several results are written to scratch folders, which are removed at the end: the
    qualified sessions, visits counted per session and category, and the actions of all sessions that are
    drawn or leading, of which there are at most ``total + top * top``. A task that runs again replaces its
    rows. A session that is both drawn and leading is detailed once.
    """
    spark = actions.sparkSession
    with shared_frames(spark) as keep:
        actions = typed_actions(actions_in_range(actions, params))
        qualified = qualified_sessions(actions, users, params)
        sessions = keep(qualified.select("session_id", "start_time", "visit_length", "step_length"))
        write_result(session_stats(sessions), "session_aggr_stat", root, task_id)

        visits = keep(visit_counts(visits_in_sessions(actions, sessions)))
        categories = keep(top_categories_of(visits, top))
        write_result(categories, "top10_category", root, task_id)
        leaders = keep(top_sessions_of(visits, categories, top, top))
        write_result(leaders, "top10_session", root, task_id)

        drawn = keep(extract_session_ids(sessions, total, seed))
        wanted = drawn.select("session_id").union(leaders.select("session_id")).distinct()
        details = keep(actions_of_sessions(actions, wanted, total + top * top))
        write_result(details.select(*DETAIL_COLUMNS), "session_detail", root, task_id)
        extract = extract_sessions_of(details, drawn, total)
        as_text = {
            "search_keywords": F.array_join("search_keywords", ","),
            "click_category_ids": F.array_join(F.col("click_category_ids").cast("array<string>"), ","),
        }
        write_result(extract.withColumns(as_text), "session_random_extract", root, task_id)


def run_product_job(
    actions: DataFrame,
    cities: DataFrame,
    products: DataFrame,
    params: TaskParams,
    root: str,
    task_id: int,
    n: int = 3,
    levels: Mapping[str, Sequence[str]] = AREA_LEVELS,
) -> None:
    """Top products per area of one task."""
    best = area_top_products(actions, cities, products, params, n, levels)
    write_result(best, "area_top3_product", root, task_id)


def run_page_job(actions: DataFrame, params: TaskParams, root: str, task_id: int) -> None:
    """Conversion along the task's page flow."""
    if params.page_flow is None:
        raise ValueError("the task names no page flow")
    wanted = typed_actions(actions_in_range(actions, params))
    write_result(page_flow_conversion(wanted, params.page_flow), "page_split_convert_rate", root, task_id)


def start_click_job(
    clicks: DataFrame, root: str, checkpoints: str, threshold: int, once: bool = False, lateness: str = DAY_LATENESS
) -> list[StreamingQuery]:
    """The queries on the raw clicks: the blacklist with all tables of the accepted clicks, and the click trend."""
    trend = start_click_trend(clicks, root, f"{checkpoints}/trend", once, lateness)
    return [*start_blacklist_job(clicks, root, checkpoints, threshold, once=once, lateness=lateness), trend]


def run_ad_job(clicks: DataFrame, root: str, checkpoints: str, threshold: int, lateness: str = DAY_LATENESS) -> None:
    """Handle all clicks there are now."""
    for query in start_click_job(clicks, root, checkpoints, threshold, once=True, lateness=lateness):
        query.awaitTermination()
