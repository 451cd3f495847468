"""Streams in several batches against the batch forms, and the result tables they write."""

import os
import random
import shutil
import time
from datetime import datetime, timezone

import pytest
from frames import actions, ad_clicks, at, cities, products, users
from pyspark.sql import functions as F

from visitlens.params import TaskParams
from visitlens.plans import ads as A
from visitlens.plans import jobs
from visitlens.settings import scratch_dir
from visitlens.sinks import RESULT_TABLES, put_rows, read_result, replace_days, results, write_result
from visitlens.sources import parse_ad_log, read_log_files, views
from visitlens.streaming import ads as S
from visitlens.streaming import blacklist as B


def random_clicks(n, seed=1, users_n=6):
    rng = random.Random(seed)
    place = [("North", "Xi"), ("North", "Yu"), ("South", "Bo")]
    return [
        (at(rng.randrange(7200), rng.randrange(2)), *rng.choice(place), int(users_n * rng.random() ** 3), rng.randrange(3))
        for _ in range(n)
    ]


class Feed:
    """A folder of click log files, one more per ``add``."""

    def __init__(self, spark):
        self.spark = spark
        self.path = scratch_dir(spark, "feed")
        self.number = 0

    def add(self, rows):
        log = views.ad_log(ad_clicks(self.spark, rows)).coalesce(1)
        log.write.mode("append").text(self.path)
        self.number += 1

    def clicks(self):
        return parse_ad_log(read_log_files(self.spark, self.path))


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def files_of(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_running_totals_equal_batch(spark):
    """Four batches with a restart before each; nothing but the state is there to add to."""
    feed, root = Feed(spark), scratch_dir(spark, "root")
    everything = []
    for part in range(4):
        rows = random_clicks(80, part)
        everything += rows
        feed.add(rows)
        S.start_province_top3(feed.clicks(), root, f"{root}/c2", once=True).awaitTermination()
        S.start_click_trend(feed.clicks(), root, f"{root}/c3", once=True, lateness="2 days").awaitTermination()
        batch = ad_clicks(spark, everything)
        stat = A.ad_stat(batch)
        assert rows_of(read_result(spark, "ad_stat", root)) == rows_of(stat)
        assert rows_of(read_result(spark, "ad_province_top3", root)) == rows_of(A.province_top_ads(stat))
        assert rows_of(read_result(spark, "ad_click_trend", root)) == rows_of(A.ad_click_trend(batch))


def test_totals_come_from_the_state_alone(spark):
    """What a batch gives out are totals, although no result table exists."""
    feed, root, seen = Feed(spark), scratch_dir(spark, "root"), []
    for part in range(3):
        feed.add([(at(part), "p", "c", 1, 1)] * 5)
        handle = lambda df, i: seen.append((i, [r["click_count"] for r in df.collect()]))
        S.start(S.running_totals(feed.clicks()), handle, f"{root}/c", once=True).awaitTermination()
    assert [n for _, n in seen if n] == [[5], [10], [15]]


def test_a_replayed_batch_changes_nothing(spark):
    """A batch whose commit is lost is handled again: from the same state, with the same totals."""
    feed, root = Feed(spark), scratch_dir(spark, "root")
    for part in range(3):
        feed.add(random_clicks(40, part))
        S.start_province_top3(feed.clicks(), root, f"{root}/c", once=True).awaitTermination()
    before = {n: rows_of(read_result(spark, n, root)) for n in ("ad_stat", "ad_province_top3")}
    commits = sorted((int(f), f) for f in os.listdir(f"{root}/c/commits") if f.isdigit())
    os.remove(f"{root}/c/commits/{commits[-1][1]}")
    crc = f"{root}/c/commits/.{commits[-1][1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    S.start_province_top3(feed.clicks(), root, f"{root}/c", once=True).awaitTermination()
    assert commits[-1][1] in os.listdir(f"{root}/c/commits")
    assert {n: rows_of(read_result(spark, n, root)) for n in before} == before
    feed.add(random_clicks(40, 9))
    S.start_province_top3(feed.clicks(), root, f"{root}/c", once=True).awaitTermination()
    assert read_result(spark, "ad_stat", root).agg(F.sum("click_count")).first()[0] == 160


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_is_bounded_and_late_clicks_are_dropped(spark):
    """Steps leave the state an hour after, with the next batch; a click within the hour counts, one long past does not.
    A query that starts again knows the watermark of the batch before its last one."""
    feed, root, held = Feed(spark), scratch_dir(spark, "root"), []
    for hour in range(0, 12, 2):
        feed.add([(at(hour * 3600 + 10 * i), "p", "c", 1, 1) for i in range(50)])
        query = S.start_click_steps(feed.clicks(), root, f"{root}/c", once=True)
        query.awaitTermination()
        held.append(state_rows(query)[-1])
    assert max(held) <= 100  # those of a batch leave with the next one that has rows
    newest = 10 * 3600 + 490
    feed.add([(at(newest - 3000), "p", "c", 1, 1), (at(newest - 20_000), "p", "c", 1, 1)])
    S.start_click_steps(feed.clicks(), root, f"{root}/c", once=True).awaitTermination()
    assert read_result(spark, "ad_click_step", root).agg(F.sum("click_count")).first()[0] == 301


def test_bad_lines_do_not_stop_a_stream(spark):
    feed, root = Feed(spark), scratch_dir(spark, "root")
    feed.add(random_clicks(5))
    spark.createDataFrame([("junk",), ("1 a b c d",)], "value string").coalesce(1).write.mode("append").text(feed.path)
    S.start_ad_stat(feed.clicks(), root, f"{root}/c", once=True).awaitTermination()
    assert read_result(spark, "ad_stat", root).agg(F.sum("click_count")).first()[0] == 5


def literal_windows(rows, width, slide):
    """Every click in every window that it falls into."""
    found = {}
    for ts, _, _, _, ad in rows:
        second = int(ts.timestamp())
        for begin in range((second - width) // slide * slide + slide, second + 1, slide):
            if begin > second - width:
                key = datetime.fromtimestamp(begin, timezone.utc).replace(tzinfo=None), ts.replace(second=0, tzinfo=None), ad
                found[key] = found.get(key, 0) + 1
    return sorted((*k, n) for k, n in found.items())


@pytest.mark.parametrize(("width", "slide"), [("60 minutes", "10 minutes"), ("1 hour", "1 hour"), ("2 days", "30 seconds"), ("40 seconds", "20 seconds")])
def test_batch_windows_equal_literal_ones(spark, width, slide):
    rows = random_clicks(25, 5) + [(at(3600 * 15 - 9 * 3600 + s), "p", "c", 1, 1) for s in (-1, 0, 0, 1)]  # at midnight too
    seconds = [A._slides(t, t)[0] for t in (width, slide)]
    assert rows_of(A.sliding_click_trend(ad_clicks(spark, rows), width, slide)) == literal_windows(rows, *seconds)


def test_windows_have_to_end_on_slides(spark):
    with pytest.raises(ValueError, match="slide"):
        A.sliding_click_trend(ad_clicks(spark, []), "1 minute", "25 seconds")


def test_sliding_windows_come_from_steps(spark):
    feed, root = Feed(spark), scratch_dir(spark, "root")
    everything = []
    for part in range(2):
        rows = random_clicks(40, part)
        everything += rows
        feed.add(rows)
        S.start_click_steps(feed.clicks(), root, f"{root}/c", once=True, lateness="2 days").awaitTermination()
    batch = ad_clicks(spark, everything)
    slid = rows_of(S.read_sliding(spark, root))
    assert slid == rows_of(A.sliding_click_trend(batch)) == literal_windows(everything, 3600, 10)
    totals = {}
    for begin, _, ad, n in slid:
        totals[begin, ad] = totals.get((begin, ad), 0) + n
    runs = S.read_window_runs(spark, root).collect()
    assert {(r.first + i, r.ad_id): r.click_count for r in runs for i in range(r.windows)} == {
        (int(begin.timestamp()) // 10, ad): n for (begin, ad), n in totals.items()
    }
    assert len(runs) <= 4 * 80  # two changes for each of at most 80 steps, cut in two at most
    assert rows_of(S.read_minutes(spark, root)) == rows_of(A.ad_click_trend(batch))


def test_the_job_starts_on_folders_that_do_not_exist(spark):
    feed, root = Feed(spark), scratch_dir(spark, "nothing-yet")
    assert read_result(spark, "ad_stat", root).count() == 0
    feed.add(random_clicks(20))
    queries = jobs.start_click_job(feed.clicks(), root, f"{root}/c", 100)
    try:
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    for name in ("ad_stat", "ad_click_trend"):
        assert read_result(spark, name, root).agg(F.sum("click_count")).first()[0] == 20
    assert read_result(spark, "ad_province_top3", root).count() > 0 and read_result(spark, "ad_blacklist", root).count() == 0


def test_the_interval_trigger_takes_several_batches(spark):
    feed, root = Feed(spark), scratch_dir(spark, "root")
    feed.add(random_clicks(30, 1))
    query = S.start_ad_stat(feed.clicks(), root, f"{root}/c")
    try:
        query.processAllAvailable()
        feed.add(random_clicks(30, 2))
        query.processAllAvailable()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    finally:
        query.stop()
    assert read_result(spark, "ad_stat", root).agg(F.sum("click_count")).first()[0] == 60


def test_past_days_are_neither_read_nor_rewritten(spark):
    """A batch touches the folders of its own days only, and each day keeps one folder."""
    root = scratch_dir(spark, "root")
    for day in range(3):
        for number in range(4):
            before = {f for f in files_of(f"{root}/ad_stat") if f"date={at(0, day).date()}" not in f}
            put_rows(A.ad_stat(ad_clicks(spark, [(at(0, day), "p", "c", 1, 1)] * (number + 1))), "ad_stat", root)
            assert before <= files_of(f"{root}/ad_stat")
            assert len(before) == day  # one file for each day before
        stored = results.read_days(spark, "ad_stat", root, [at(0, day).date()])
        assert all(f"date={at(0, day).date()}" in f for f in stored.inputFiles() if "_days" not in f)
    assert [r.click_count for r in read_result(spark, "ad_stat", root).orderBy("date").collect()] == [4, 4, 4]


class Killed(Exception):
    pass


def killed_while(spark, monkeypatch, root, rows, after):
    """Put rows, and die once ``after`` writes are done."""
    from pyspark.sql import DataFrameWriter

    plain, writes = DataFrameWriter.parquet, []

    def parquet(self, path, *a, **b):
        if len(writes) == after:
            raise Killed
        writes.append(path)
        return plain(self, path, *a, **b)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", parquet)
        with pytest.raises(Killed):
            put_rows(ad_stat_rows(spark, *rows), "ad_stat", root)


def test_a_killed_batch_is_seen_whole_or_not_at_all(spark, monkeypatch):
    root, day = scratch_dir(spark, "root"), at(0).date()
    put_rows(ad_stat_rows(spark, ("p", 1, 5), ("p", 2, 1)), "ad_stat", root)
    first = [(day, "p", "c", 1, 5), (day, "p", "c", 2, 1)]
    second = [(day, "p", "c", 1, 9), (day, "p", "c", 2, 1), (day, "p", "c", 3, 4)]
    fresh = ("p", 1, 9), ("p", 3, 4)

    killed_while(spark, monkeypatch, root, fresh, after=0)  # before anything is written
    assert rows_of(read_result(spark, "ad_stat", root)) == first

    half = f"{root}/_days/ad_stat/b/sequence=2/date={day}"  # while the days are written beside the table
    os.makedirs(half)
    shutil.copy(next(iter(files_of(f"{root}/ad_stat"))), half)
    assert rows_of(read_result(spark, "ad_stat", root)) == first

    killed_while(spark, monkeypatch, root, fresh, after=1)  # before the table itself is overwritten
    assert rows_of(read_result(spark, "ad_stat", root)) == second
    for file in files_of(f"{root}/ad_stat"):  # and while it is
        os.remove(file)
    assert rows_of(read_result(spark, "ad_stat", root)) == second

    for _ in range(3):  # the batch is handled again
        put_rows(ad_stat_rows(spark, *fresh), "ad_stat", root)
        assert rows_of(read_result(spark, "ad_stat", root)) == second
    assert rows_of(spark.read.parquet(f"{root}/ad_stat").select("date", "province", "city", "ad_id", "click_count")) == second


def ad_stat_rows(spark, *rows):
    columns = "date date, province string, city string, ad_id bigint, click_count bigint"
    return spark.createDataFrame([(at(0).date(), p, "c", ad, n) for p, ad, n in rows], columns)


def test_many_users_in_one_batch(spark):
    """Users with few clicks and one with very many, whose clicks are counted before they are dealt to the states."""
    path, root = scratch_dir(spark, "many"), scratch_dir(spark, "root")
    clicks = spark.range(300_000).selectExpr(
        "timestamp '2024-01-03 10:00:00' as ts", "'p' as province", "'c' as city",
        "case when id % 3 = 0 then -1 else id % 20000 end as user_id", "id % 7 as ad_id",
    )
    clicks.write.parquet(path)
    stream, began = spark.readStream.schema(clicks.schema).parquet(path), time.time()
    for query in B.start_users(stream, root, f"{root}/c", 1000, once=True):
        query.awaitTermination()
    assert time.time() - began < 60
    counts = read_result(spark, "ad_user_click_count", root)
    assert counts.agg(F.sum("click_count")).first()[0] == 300_000
    assert [r.user_id for r in read_result(spark, "ad_blacklist", root).collect()] == [-1]
    # Each input batch gives a row per user, day, place and ad.
    dealt = B.counted(spark.read.parquet(path)).where("user_id = -1").count()
    assert dealt < 1000


def brute_blacklist(batches, threshold):
    """Accepted counts per (date, user, ad) and the listed users, batch by batch."""
    listed, counts = set(), {}
    for rows in batches:
        accepted = [r for r in rows if r[3] not in listed]
        for ts, _, _, user, ad in accepted:
            counts[(ts.date(), user, ad)] = counts.get((ts.date(), user, ad), 0) + 1
        listed |= {user for (_, user, _), n in counts.items() if n >= threshold}
    return listed, counts


@pytest.mark.parametrize("threshold", [12, 100])
def test_dynamic_blacklist_takes_effect_from_the_next_batch(spark, threshold):
    feed, root = Feed(spark), scratch_dir(spark, "root")
    batches = [random_clicks(90, seed) for seed in range(3)]
    for rows in batches:
        feed.add(rows)
        jobs.run_ad_job(feed.clicks(), root, f"{root}/c", threshold, "2 days")
    listed, counts = brute_blacklist(batches, threshold)
    assert {r.user_id for r in read_result(spark, "ad_blacklist", root).collect()} == listed
    assert bool(listed) == (threshold == 12)
    found = read_result(spark, "ad_user_click_count", root)
    assert {(r.date, r.user_id, r.ad_id): r.click_count for r in found.collect()} == counts
    assert read_result(spark, "ad_stat", root).agg(F.sum("click_count")).first()[0] == sum(counts.values())
    # The trend counts every click, listed or not.
    assert read_result(spark, "ad_click_trend", root).agg(F.sum("click_count")).first()[0] == 270
    top = A.province_top_ads(read_result(spark, "ad_stat", root))
    assert rows_of(read_result(spark, "ad_province_top3", root)) == rows_of(top)


def test_counts_of_past_days_leave_the_state_and_listed_users_stay(spark):
    feed, root, held = Feed(spark), scratch_dir(spark, "root"), []
    for day in range(6):
        # User 0 is listed on the first day; ten users come on one day only.
        feed.add([(at(0, day), "p", "c", 0, 1)] * 5 + [(at(i, day), "p", "c", 10 * day + i, 1) for i in range(1, 11)])
        query = B.start_accepted(feed.clicks(), root, f"{root}/c", 5, once=True)
        query.awaitTermination()
        held.append(state_rows(query)[-1])
    assert [r.user_id for r in read_result(spark, "ad_blacklist", root).collect()] == [0]
    accepted = spark.read.parquet(f"{root}/ad_accepted").where("kind = 'click'")
    assert accepted.where("user_id = 0").agg(F.sum("click_count")).first()[0] == 5
    assert accepted.agg(F.sum("click_count")).first()[0] == 5 + 60
    assert max(held) <= 1 + 4 * 10 and held[-1] == held[-2] == held[-3]  # a batch takes out what was past before it


def test_users_share_states(spark, monkeypatch):
    """Many users in few states are accepted, counted and listed like users with a state each."""
    monkeypatch.setattr(B, "STATES", 5)
    feed, root, batches = Feed(spark), scratch_dir(spark, "root"), [random_clicks(400, seed, 60) for seed in range(3)]
    for rows in batches:
        feed.add(rows)
        for query in B.start_users(feed.clicks(), root, f"{root}/c", 12, once=True, lateness="2 days"):
            query.awaitTermination()
            if state_rows(query):
                assert state_rows(query)[-1] <= 5
    listed, counts = brute_blacklist(batches, 12)
    assert {r.user_id for r in read_result(spark, "ad_blacklist", root).collect()} == listed and 1 < len(listed) < 60
    found = read_result(spark, "ad_user_click_count", root)
    assert {(r.date, r.user_id, r.ad_id): r.click_count for r in found.collect()} == counts


def test_clicks_are_counted_across_small_batches(spark):
    clicks = ad_clicks(spark, [(at(i % 50), "p", None, -1, i % 7) for i in range(3000)]).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = B.counted(clicks).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 7 and sum(r.click_count for r in rows) == 3000


def test_put_rows_and_replace_days(spark):
    root, day = scratch_dir(spark, "root"), at(0).date()
    assert put_rows(ad_stat_rows(spark).limit(0), "ad_stat", root) is None
    put_rows(ad_stat_rows(spark, ("p", 1, 5), (None, 2, 1)), "ad_stat", root)
    put_rows(ad_stat_rows(spark, (None, 2, 3), ("q", 2, 1)), "ad_stat", root)
    want = [(day, None, "c", 2, 3), (day, "p", "c", 1, 5), (day, "q", "c", 2, 1)]
    assert sorted(rows_of_nulls(read_result(spark, "ad_stat", root))) == sorted(map(str, want))

    top = "date date, province string, ad_id bigint, click_count bigint"
    replace_days(spark.createDataFrame([(day, "p", 1, 4), (day, "p", 2, 3), (at(0, 1).date(), "q", 5, 1)], top), "ad_province_top3", root)
    replace_days(spark.createDataFrame([(day, "p", 2, 9)], top), "ad_province_top3", root)
    assert rows_of(read_result(spark, "ad_province_top3", root)) == [(day, "p", 2, 9), (at(0, 1).date(), "q", 5, 1)]


def rows_of_nulls(frame):
    return [str(tuple(r)) for r in frame.collect()]


def test_session_job_writes_its_tables(spark):
    root = scratch_dir(spark, "root")
    rows = []
    for i in range(30):
        rows += [
            {"session_id": f"s{i}", "user_id": 1, "page_id": 1, "action_time": at(0), "search_keyword": "k"},
            {"session_id": f"s{i}", "user_id": 1, "page_id": 2, "action_time": at(5), "click_category_id": i % 3},
        ]
    frame, people = actions(spark, rows), users(spark)
    before = set(os.listdir(os.path.dirname(root)))
    for _ in range(2):  # a task that runs again replaces its rows
        jobs.run_session_job(frame, people, TaskParams(), root, 4, total=10)
    assert not [f for f in set(os.listdir(os.path.dirname(root))) - before if f.startswith("shared")]
    jobs.run_page_job(frame, TaskParams(page_flow=(1, 2)), root, 4)
    stats = read_result(spark, "session_aggr_stat", root).first()
    assert (stats.task_id, stats.session_count, stats["4s_6s_ratio"], stats["1_3_ratio"]) == (4, 30, 1.0, 1.0)
    drawn = read_result(spark, "session_random_extract", root).collect()
    assert len(drawn) == 10 and all(r.search_keywords == "k" and r.click_category_ids in "012" for r in drawn)
    assert [r.click_count for r in read_result(spark, "top10_category", root).collect()] == [10, 10, 10]
    assert read_result(spark, "top10_session", root).count() == 30
    # Details of the thirty leading sessions, the ten drawn ones among them.
    details = read_result(spark, "session_detail", root)
    assert details.count() == 2 * 30 == details.distinct().count()
    assert details.columns == list(RESULT_TABLES["session_detail"].columns)
    assert read_result(spark, "page_split_convert_rate", root).first().convert_rate == "1_2=1.00"


def test_product_job(spark):
    root = scratch_dir(spark, "root")
    rows = [{"session_id": "s", "user_id": 1, "action_time": at(0), "city_id": 1, "click_product_id": 7}]
    goods = products(spark, [(7, "seven", '{"product_status": 0}')])
    places = cities(spark, [(1, "Xi", "China East")])
    for task_id in (1, 2):
        jobs.run_product_job(actions(spark, rows), places, goods, TaskParams(), root, task_id)
    want = ("China East", "A Level", 7, "1:Xi", 1, "seven", "Self")
    assert rows_of(read_result(spark, "area_top3_product", root)) == [(1, *want), (2, *want)]


def test_unknown_columns_are_refused(spark):
    with pytest.raises(Exception, match="convert_rate"):
        write_result(spark.range(1), "page_split_convert_rate", scratch_dir(spark, "root"), 1)
