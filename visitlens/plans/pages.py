"""Page one-step conversion (an extension: only its parameter and result are given)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.numbers import half_up_ratio


#: Views of one piece of a session above which the piece is cut again.
HOT_VIEWS = 100_000
# Lengths of pieces, each inside the one before.
_PIECES = ("day", "hour", "minute", "second")


def page_views(actions: DataFrame) -> DataFrame:
    """Views (session_id, action_time, page_id, n), equal ones counted."""
    seen = actions.where(F.col("page_id").isNotNull())
    return seen.groupBy("session_id", "action_time", "page_id").agg(F.count(F.lit(1)).alias("n"))


def _in_pieces(views: DataFrame, piece: str, hot_views: int) -> DataFrame:
    """``views`` with the beginning of its piece; pieces with very many views are cut shorter, down to seconds."""
    lengths = _PIECES[_PIECES.index(piece) :]
    begins = [F.date_trunc(length, "action_time") for length in lengths]
    cut = views.withColumn("piece", begins[0])
    for length, shorter in zip(lengths, begins[1:], strict=False):
        counted = views.groupBy("session_id", F.date_trunc(length, "action_time").alias("piece")).count()
        hot = counted.where(F.col("count") > hot_views).select("session_id", "piece", F.lit(True).alias("hot"))
        cut = cut.join(hot, ["session_id", "piece"], "left")
        cut = cut.withColumn("piece", F.when(F.col("hot"), shorter).otherwise(F.col("piece"))).drop("hot")
    return cut


def page_steps(actions: DataFrame, piece: str = "hour", hot_views: int = HOT_VIEWS) -> DataFrame:
    """Number of steps from each page to the next page of the session: (from_page, to_page, steps).

    Order: time, then page. Equal (session, time, page) rows are counted first, and a session is
    cut into pieces of time that are ordered on their own, shorter ones where a piece is hot; the step
    across a cut joins the last page of a piece to the first of the next. So no task sorts a whole session.
    """
    return steps_of(page_views(actions), piece, hot_views)


def steps_of(seen: DataFrame, piece: str = "hour", hot_views: int = HOT_VIEWS) -> DataFrame:
    """``page_steps`` from counted views."""
    views = _in_pieces(seen.where(F.col("action_time").isNotNull()), piece, hot_views)
    here = Window.partitionBy("session_id", "piece").orderBy("action_time", "page_id")
    placed = views.select(
        "session_id",
        "action_time",
        F.col("page_id").alias("from_page"),
        "n",
        F.lag("page_id").over(here).alias("before"),
        F.lead("page_id").over(here).alias("after"),
    )
    # A page seen n times at one time steps n-1 times to itself, then once to what follows.
    repeated = F.struct(F.col("from_page").alias("to_page"), (F.col("n") - 1).alias("steps"))
    onward = F.struct(F.col("after").alias("to_page"), F.lit(1).cast("bigint").alias("steps"))
    steps_inside = placed.select("from_page", F.inline(F.array(repeated, onward)))

    ends = placed.where(F.col("before").isNull() | F.col("after").isNull())
    across = Window.partitionBy("session_id").orderBy("action_time", "from_page")
    steps_across = ends.select(
        "from_page",
        F.lead("from_page").over(across).alias("to_page"),
        # Always 1; using n here as well lets both parts read one shuffle of the views.
        F.least("n", F.lit(1)).alias("steps"),
        "after",
    ).where(F.col("after").isNull()).drop("after")
    return (
        steps_inside.unionByName(steps_across)
        .where(F.col("to_page").isNotNull() & (F.col("steps") > 0))
        .groupBy("from_page", "to_page")
        .agg(F.sum("steps").alias("steps"))
    )


def page_flow_counts(actions: DataFrame, flow: Sequence[int], piece: str = "hour") -> DataFrame:
    """One row: visits of the first page and the steps of each consecutive pair of the flow."""
    pairs = list(zip(flow, flow[1:], strict=False))
    wanted = reduce(
        lambda a, b: a | b, [(F.col("from_page") == a) & (F.col("to_page") == b) for a, b in set(pairs)]
    )

    def steps(a: int, b: int):
        hit = (F.col("from_page") == a) & (F.col("to_page") == b)
        return F.coalesce(F.sum(F.when(hit, F.col("steps"))), F.lit(0))

    # Steps and visits come from the same counted views; views without a time are visits all the same.
    seen = page_views(actions)
    counted = steps_of(seen, piece).where(wanted).agg(
        *[steps(a, b).alias(f"pair_{i}") for i, (a, b) in enumerate(pairs, 1)]
    )
    first = F.when(F.col("page_id") == flow[0], F.col("n"))
    visits = seen.agg(F.coalesce(F.sum(first), F.lit(0)).alias("visits"))
    return counted.withColumn("visits", visits.scalar())


def page_flow_conversion(actions: DataFrame, flow: Sequence[int], piece: str = "hour") -> DataFrame:
    """One row, ``p1_p2=rate|p2_p3=rate``: each rate is steps over the steps before (first: visits)."""
    if len(flow) < 2:
        raise ValueError("a page flow needs two pages")
    counts = page_flow_counts(actions, flow, piece)
    rates = []
    for i, (a, b) in enumerate(zip(flow, flow[1:], strict=False), 1):
        whole = F.col("visits" if i == 1 else f"pair_{i - 1}")
        rate = F.coalesce(half_up_ratio(F.col(f"pair_{i}"), whole), F.lit(0.0))
        rates.append(F.concat(F.lit(f"{a}_{b}="), F.format_string("%.2f", rate)))
    return counts.select(F.concat_ws("|", *rates).alias("convert_rate"))
