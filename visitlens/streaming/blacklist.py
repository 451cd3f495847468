"""The dynamic blacklist: clicks of a batch are filtered by the users listed in earlier batches.

Everything about a user is kept in the state: the counts per day and ad, and whether the user is listed. One stateful
query gives out what it accepts, the new counts and the newly listed users, through Spark's file sink, whose log makes
a batch visible as a whole and once. The result tables are kept by further queries on that stream. No result table is
read to decide about a click.

Users share a state by the hash of their id, and a state's rows are handled as arrays: a call of Python costs far more
than a user's few rows. Clicks are counted within each task before they are dealt to the states, so a user with very
many clicks is a few rows. Counts of past days leave the state; that a user is listed stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from visitlens.plans.ads import BLACKLIST_CLICKS
from visitlens.sinks.results import ACCEPTED_SCHEMA, ACCEPTED_TABLE, put_rows
from visitlens.streaming.ads import DAY_LATENESS, batch_trigger, put_stat, running_totals, start

#: Number of states that the users are dealt to. A stream goes on from its checkpoint with the number it began with.
STATES = 8192
#: Counted rows that a task holds before it gives them out.
HELD_ROWS = 1 << 16

_KEYS = ["user_id", "date", "province", "city", "ad_id"]
_COUNTED = "user_id bigint, date date, province string, city string, ad_id bigint, click_count bigint"
_ACCEPTED = "user_id bigint, day int, province string, city string, ad_id bigint, click_count bigint, kind string"
# Arrays of 64-bit integers: the listed users, and user, day, ad and number of clicks of each count.
_STATE = "listed binary, users binary, days binary, ads binary, counts binary"
_DAY_MS = 86_400_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def summed() -> pa.Table:
        total = pa.concat_tables(held).group_by(_KEYS).aggregate([("click_count", "sum")])
        return total.rename_columns({"click_count_sum": "click_count"}).select([*_KEYS, "click_count"])

    for batch in batches:
        counted = pa.Table.from_batches([batch]).group_by(_KEYS).aggregate([([], "count_all")])
        held.append(counted.rename_columns({"count_all": "click_count"}).select([*_KEYS, "click_count"]))
        rows += counted.num_rows
        if rows >= HELD_ROWS:
            held = [summed()]
            rows = held[0].num_rows
            if 2 * rows >= HELD_ROWS:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from summed().to_batches()


def counted(clicks: DataFrame) -> DataFrame:
    """Clicks per user, day, province, city and ad, counted within each task; those without user, ad or time are left out."""
    known = clicks.where("ts is not null and user_id is not null and ad_id is not null")
    rows = known.select("user_id", F.to_date("ts").alias("date"), "province", "city", "ad_id")
    return rows.mapInArrow(_counted, _COUNTED)


def _totals(user: np.ndarray, day: np.ndarray, ad: np.ndarray, n: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` per user, day and ad, in their order, and whether a row of the sum is ``new``."""
    order = np.lexsort((ad, day, user))
    user, day, ad, n, new = user[order], day[order], ad[order], n[order], new[order]
    begins = (user[1:] != user[:-1]) | (day[1:] != day[:-1]) | (ad[1:] != ad[:-1])
    at = np.flatnonzero(np.concatenate(([True], begins)))
    return user[at], day[at], ad[at], np.add.reduceat(n, at), np.logical_or.reduceat(new, at)


def _accept(threshold: int):
    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """One state's rows of one batch."""
        held = [np.frombuffer(part, np.int64) for part in state.get] if state.exists else [np.zeros(0, np.int64)] * 5
        listed, (user, day, ad, n) = held[0], held[1:]
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            rows = rows[~np.isin(rows["user_id"], listed)]
            if len(rows):
                fresh = [rows[c].to_numpy(np.int64) for c in ("user_id", "day", "ad_id", "click_count")]
                new = np.repeat([False, True], [len(user), len(rows)])
                user, day, ad, n, new = _totals(*map(np.concatenate, zip((user, day, ad, n), fresh, strict=True)), new)
                reached = np.unique(user[new & (n >= threshold)])
                yield _given_out(rows, fresh, (user[new], day[new], ad[new], n[new]), reached)
                listed = np.union1d(listed, reached)
        # A listed user's clicks count no more, and clicks of days before the watermark do not come any more.
        stay = (day >= state.getCurrentWatermarkMs() // _DAY_MS) & ~np.isin(user, listed)
        user, day, ad, n = user[stay], day[stay], ad[stay], n[stay]
        if len(listed) or len(user):
            state.update(tuple(part.tobytes() for part in (listed, user, day, ad, n)))
        elif state.exists:
            state.remove()
        if len(user):
            # Look again when the oldest day is past.
            state.setTimeoutTimestamp((int(day.min()) + 1) * _DAY_MS)

    return accept


def _given_out(rows: pd.DataFrame, clicks: list[np.ndarray], totals: tuple[np.ndarray, ...], reached: np.ndarray) -> pd.DataFrame:
    """The accepted clicks, the new totals and the newly listed users as rows of the three kinds."""
    sizes = [len(rows), len(totals[0]), len(reached)]
    blank = np.zeros(len(reached), np.int64)
    without = np.repeat([False, False, True], sizes)
    user, day, ad, n = map(np.concatenate, zip(clicks, totals, (reached, blank, blank, blank), strict=True))
    nowhere = np.full(sizes[1] + sizes[2], None, object)
    return pd.DataFrame(
        {
            "user_id": user,
            "day": pd.arrays.IntegerArray(day.astype(np.int32), without),
            "province": np.concatenate((rows["province"].to_numpy(object), nowhere)),
            "city": np.concatenate((rows["city"].to_numpy(object), nowhere)),
            "ad_id": pd.arrays.IntegerArray(ad, without),
            "click_count": pd.arrays.IntegerArray(n, without),
            "kind": np.repeat(np.array(["click", "total", "listed"], object), sizes),
        }
    )


def accepted_clicks(clicks: DataFrame, threshold: int = BLACKLIST_CLICKS, lateness: str = DAY_LATENESS) -> DataFrame:
    """The stateful step. Rows of three kinds: ``click``, accepted counts per user, day, province, city and ad;
    ``total``, the new count of a user, day and ad; ``listed``, a user whose count reached ``threshold``, from
    whom nothing is accepted from the next batch on."""
    timed = counted(clicks).withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", lateness)
    own = F.pmod(F.xxhash64("user_id"), F.lit(STATES))
    dealt = timed.withColumns({"date": F.unix_date("date"), "state": own}).withColumnRenamed("date", "day")
    accepted = dealt.groupBy("state").applyInPandasWithState(
        _accept(threshold), _ACCEPTED, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return accepted.withColumn("day", F.date_from_unix_date("day")).withColumnRenamed("day", "date")


def start_accepted(
    clicks: DataFrame,
    root: str,
    checkpoint: str,
    threshold: int = BLACKLIST_CLICKS,
    once: bool = False,
    lateness: str = DAY_LATENESS,
) -> StreamingQuery:
    """Write what is accepted, and with it the blacklist, to the stream of accepted clicks below ``root``."""
    return (
        accepted_clicks(clicks, threshold, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("kind")
        .option("path", f"{root}/{ACCEPTED_TABLE}")
        .option("checkpointLocation", checkpoint)
        .trigger(**batch_trigger(once))
        .start()
    )


def read_accepted(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The stream that ``start_accepted`` writes, one kind of its rows."""
    rows = spark.readStream.schema(ACCEPTED_SCHEMA).parquet(f"{root}/{ACCEPTED_TABLE}")
    return rows.where(F.col("kind") == kind)


def start_user_counts(spark: SparkSession, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep ``ad_user_click_count`` up to date from the accepted stream."""

    def handle(df: DataFrame, _: int) -> None:
        newest = df.groupBy("date", "user_id", "ad_id").agg(F.max("click_count").alias("click_count"))
        put_rows(newest, "ad_user_click_count", root)

    return start(read_accepted(spark, root, "total"), handle, checkpoint, "append", once)


def start_accepted_top3(
    spark: SparkSession, root: str, checkpoint: str, n: int = 3, once: bool = False, lateness: str = DAY_LATENESS
) -> StreamingQuery:
    """Keep ``ad_stat`` and ``ad_province_top3`` of the accepted clicks up to date."""
    clicks = read_accepted(spark, root, "click").withColumn("ts", F.col("date").cast("timestamp"))
    totals = running_totals(clicks, lateness, F.col("click_count"))
    return start(totals, lambda df, _: put_stat(df, root, n), checkpoint, once=once)


def start_users(
    clicks: DataFrame,
    root: str,
    checkpoints: str,
    threshold: int = BLACKLIST_CLICKS,
    once: bool = False,
    lateness: str = DAY_LATENESS,
) -> list[StreamingQuery]:
    """Keep ``ad_user_click_count`` and ``ad_blacklist`` up to date."""
    accepted = start_accepted(clicks, root, f"{checkpoints}/accepted", threshold, once, lateness)
    if once:
        accepted.awaitTermination()
    return [accepted, start_user_counts(clicks.sparkSession, root, f"{checkpoints}/users", once)]


def start_blacklist_job(
    clicks: DataFrame,
    root: str,
    checkpoints: str,
    threshold: int = BLACKLIST_CLICKS,
    n: int = 3,
    once: bool = False,
    lateness: str = DAY_LATENESS,
) -> list[StreamingQuery]:
    """Keep all tables of the accepted clicks up to date."""
    top = start_users(clicks, root, checkpoints, threshold, once, lateness)
    return [*top, start_accepted_top3(clicks.sparkSession, root, f"{checkpoints}/top", n, once, lateness)]
