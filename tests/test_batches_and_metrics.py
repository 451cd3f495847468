"""Rows sent in batches, counts of a stream's batches, and bitmaps of ids."""

import json
import os
import sys
import uuid

import pytest
from frames import ad_clicks, at
from pyspark import cloudpickle
from pyspark.sql import functions as F

from visitlens.operators import common_bitmaps, id_bitmaps, id_counts, merged_bitmaps
from visitlens.plans import ads as A
from visitlens.settings import scratch_dir
from visitlens.sinks import write_batches
from visitlens.sources import read_log_files
from visitlens.streaming import metrics

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # connections are made in the workers


class Store:
    """Connections that write what they commit into a folder: one file per connection, one list per batch."""

    def __init__(self, folder, fail_first=()):
        self.folder, self.fail_first = folder, tuple(fail_first)
        self.batches = []

    def cursor(self):
        return self

    def executemany(self, statement, rows):
        from pyspark import TaskContext

        task = TaskContext.get()
        if task.partitionId() in self.fail_first and task.attemptNumber() == 0 and len(self.batches) == 1:
            raise OSError("the connection broke")
        self.batches.append([statement, rows])

    def commit(self):
        with open(f"{self.folder}/{uuid.uuid4().hex}.json", "w") as out:
            json.dump(self.batches, out)

    def rollback(self):
        with open(f"{self.folder}/{uuid.uuid4().hex}.rolled-back", "w") as out:
            out.write(str(len(self.batches)))

    def close(self):
        self.batches = []


def store(spark, fail_first=()):
    folder = scratch_dir(spark, "store").replace("file://", "")
    os.makedirs(folder)
    return folder, lambda: Store(folder, fail_first)


def committed(folder):
    files = [f for f in os.listdir(folder) if f.endswith(".json")]
    return [json.load(open(f"{folder}/{f}")) for f in files]


def test_each_task_sends_bounded_batches_and_commits_once(spark):
    folder, connect = store(spark)
    rows = spark.range(0, 95, numPartitions=4).select("id", F.concat(F.lit("n"), "id").alias("name"))
    write_batches(rows, connect, "put", batch_rows=10)
    tasks = committed(folder)
    assert len(tasks) == 4
    assert sorted(len(t) for t in tasks) == [3, 3, 3, 3]
    assert all(len(r) <= 10 and s == "put" for t in tasks for s, r in t)
    assert sorted(tuple(r) for t in tasks for _, rs in t for r in rs) == [(i, f"n{i}") for i in sorted(range(95))]


def test_a_failed_attempt_is_rolled_back_and_nothing_of_it_stays(spark):
    """Local sessions do not retry tasks, so the job fails as a whole; the other tasks have committed, this one has not."""
    folder, connect = store(spark, fail_first=[1])
    rows = spark.range(0, 60, numPartitions=3)
    with pytest.raises(Exception, match="the connection broke"):
        write_batches(rows, connect, "put", batch_rows=10)
    kept = [r[0] for t in committed(folder) for _, rs in t for r in rs]
    assert not set(kept) & set(range(20, 40))
    assert [f for f in os.listdir(folder) if f.endswith(".rolled-back")]


def test_tasks_without_rows_do_not_connect(spark):
    folder, connect = store(spark)
    write_batches(spark.range(0, 3, numPartitions=3).where("id = 1"), connect, "put")
    assert len(committed(folder)) == 1
    write_batches(spark.range(0), connect, "put")
    assert len(committed(folder)) == 1


def test_counts_of_every_batch_reach_the_listener(spark):
    path, root = scratch_dir(spark, "feed"), scratch_dir(spark, "root")
    listener = metrics.BatchCounts()
    spark.streams.addListener(listener)
    try:
        for part in range(3):
            good = [(f"{1704272400000 + i} p c {i} 1",) for i in range(10 * (part + 1))]
            bad = [("junk",), ("",), ("1 a b c d",)][: part + 1]
            spark.createDataFrame(good + bad, "value string").coalesce(1).write.mode("append").text(path)
            clicks = metrics.observed_clicks(read_log_files(spark, path))
            query = (
                clicks.writeStream.format("parquet").options(path=f"{root}/out", checkpointLocation=f"{root}/c")
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
            listener.wait_for(query)
    finally:
        spark.streams.removeListener(listener)
    assert [c[1:] for c in listener.counts()] == [(0, 11, 10, 1), (1, 22, 20, 2), (2, 33, 30, 3)]
    assert metrics.counted_batches(spark, listener).count() == 3
    assert spark.read.parquet(f"{root}/out").count() == 60


def test_bitmaps_count_merge_and_meet(spark):
    rows = [(d, u) for d in range(3) for u in (0, 1, 32767, 32768, 32769, 10**12 + d, -5)] + [(0, None), (0, 1), (1, 77)]
    days = id_bitmaps(spark.createDataFrame(rows, "d int, u bigint"), ["d"], "u")
    assert {r["d"]: r["ids"] for r in id_counts(days, ["d"]).collect()} == {0: 7, 1: 8, 2: 7}
    assert id_counts(merged_bitmaps(days, []), []).first()["ids"] == 6 + 3 + 1
    assert id_counts(common_bitmaps(days.where("d < 2"), [], 2), []).first()["ids"] == 6
    assert id_bitmaps(spark.createDataFrame([], "d int, u bigint"), ["d"], "u").count() == 0


def test_distinct_users_need_no_lists(spark):
    clicks = ad_clicks(spark, [(at(0, d), "p", "c", u, a) for d in range(2) for u in range(5 + d) for a in range(2)])
    users = A.daily_users(clicks)
    plan = id_counts(users, ["date", "ad_id"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "bitmap_construct_agg" in plan
    got = {r["ad_id"]: r["users"] for r in A.returning_users(users, at(0, 0).date(), at(0, 1).date()).collect()}
    assert got == {0: 5, 1: 5}
