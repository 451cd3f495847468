"""Most visited categories and the most active sessions within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.numbers import to_long
from visitlens.functions.text import split_csv
from visitlens.operators.joins import bounded_broadcast
from visitlens.operators.topk import top_per_group, top_rows


def category_visits(actions: DataFrame) -> DataFrame:
    """One row (session_id, kind, category_id) per clicked, ordered or paid category.

    One pass over the actions; list entries that are no numbers are left out.
    """
    listed = actions.select(
        "session_id",
        F.stack(
            F.lit(3),
            F.lit("click"),
            F.col("click_category_id").cast("string"),
            F.lit("order"),
            F.col("order_category_ids"),
            F.lit("pay"),
            F.col("pay_category_ids"),
        ).alias("kind", "ids"),
    ).where(F.col("ids").isNotNull())
    exploded = listed.select("session_id", "kind", F.explode(split_csv("ids")).alias("id"))
    return exploded.select("session_id", "kind", to_long("id").alias("category_id")).where(
        F.col("category_id").isNotNull()
    )


def visits_in_sessions(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """``category_visits`` of the given sessions.

    Actions without any category stop before the join. A session may own a large share of the rest; adaptive
    execution splits it.
    """
    columns = ["session_id", "click_category_id", "order_category_ids", "pay_category_ids"]
    visiting = actions.select(*columns).where(F.coalesce(*[F.col(c).cast("string") for c in columns[1:]]).isNotNull())
    return category_visits(visiting.join(sessions.select("session_id"), "session_id", "left_semi"))


def category_counts(visits: DataFrame) -> DataFrame:
    """Clicks, orders and payments per category, 0 where there is none."""

    def count_of(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind).alias(f"{kind}_count")

    return visits.groupBy("category_id").agg(count_of("click"), count_of("order"), count_of("pay"))


def session_clicks(visits: DataFrame) -> DataFrame:
    """Clicks per category and session."""
    clicks = visits.where(F.col("kind") == "click")
    return clicks.groupBy("category_id", "session_id").agg(F.count(F.lit(1)).alias("click_count"))


def category_order() -> list[Column]:
    """Most clicks first, then orders, then payments; ties by the smaller id."""
    return [F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), F.asc("category_id")]


def top_categories(visits: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(category_counts(visits), category_order(), n)


def top_sessions_per_category(visits: DataFrame, top: DataFrame, categories: int = 10, n: int = 10) -> DataFrame:
    """The ``n`` sessions with most clicks in each of the ``categories`` top categories."""
    wanted = bounded_broadcast(top.select("category_id"), categories)
    clicks = session_clicks(visits.join(wanted, "category_id", "left_semi"))
    order = [F.desc("click_count"), F.asc("session_id")]
    return top_per_group(clicks, ["category_id"], order, n, unique="session_id").drop("rank")


# The same from visits counted per session, which are fewer rows to keep


def visit_counts(visits: DataFrame) -> DataFrame:
    """Visits per session, category and kind."""
    return visits.groupBy("session_id", "category_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def top_categories_of(counts: DataFrame, n: int = 10) -> DataFrame:
    def sum_of(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}_count")

    return top_rows(counts.groupBy("category_id").agg(sum_of("click"), sum_of("order"), sum_of("pay")), category_order(), n)


def top_sessions_of(counts: DataFrame, top: DataFrame, categories: int = 10, n: int = 10) -> DataFrame:
    wanted = bounded_broadcast(top.select("category_id"), categories)
    clicks = counts.where("kind = 'click'").join(wanted, "category_id", "left_semi")
    clicks = clicks.select("category_id", "session_id", F.col("n").alias("click_count"))
    order = [F.desc("click_count"), F.asc("session_id")]
    return top_per_group(clicks, ["category_id"], order, n, unique="session_id").drop("rank")
