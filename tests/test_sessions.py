from datetime import date

import pytest
from frames import actions, at, session_of, users
from pyspark.sql import functions as F

from visitlens.params import TaskParams
from visitlens.plans import sessions as S
from visitlens.sources import actions_in_range, typed_actions

EVERYTHING = TaskParams()

VISIT_EDGES = {
    0: None, 1: "1s_3s", 3: "1s_3s", 4: "4s_6s", 6: "4s_6s", 7: "7s_9s", 9: "7s_9s", 10: "10s_30s",
    30: "10s_30s", 31: "30s_60s", 60: "30s_60s", 61: "1m_3m", 180: "1m_3m", 181: "3m_10m", 600: "3m_10m",
    601: "10m_30m", 1800: "10m_30m", 1801: "30m",
}
STEP_EDGES = {1: "1_3", 3: "1_3", 4: "4_6", 6: "4_6", 7: "7_9", 9: "7_9", 10: "10_30", 30: "10_30",
              31: "30_60", 60: "30_60", 61: "60"}


@pytest.mark.parametrize("edges, column", [(VISIT_EDGES, "visit_length"), (STEP_EDGES, "step_length")])
def test_bucket_edges(spark, edges, column):
    other = "step_length" if column == "visit_length" else "visit_length"
    frame = spark.createDataFrame([(v,) for v in edges], f"{column} bigint").withColumn(other, F.lit(0).cast("bigint"))
    counted = S.session_counters(frame).first().asDict()
    assert counted.pop("session_count") == len(edges)
    want = {}
    for bucket in edges.values():
        if bucket is not None:
            want[bucket] = want.get(bucket, 0) + 1
    assert {k: v for k, v in counted.items() if v} == want


def test_roll_up(spark):
    rows = [
        {"session_id": "s", "user_id": 1, "action_time": at(5), "search_keyword": "b", "click_category_id": 11},
        {"session_id": "s", "user_id": 1, "action_time": at(0), "search_keyword": "", "click_category_id": 1},
        {"session_id": "s", "user_id": 1, "action_time": at(65), "search_keyword": "ab"},
        {"session_id": "s", "user_id": 1, "action_time": None, "search_keyword": "b", "click_category_id": 2},
        {"session_id": "lost", "user_id": 9, "action_time": at(0)},
    ]
    (row,) = S.session_aggregate(actions(spark, rows), users(spark)).collect()
    # Category 1 stays although 11 was seen, ids sort as numbers, an empty keyword is none.
    assert row.click_category_ids == [1, 2, 11]
    assert row.search_keywords == ["ab", "b"]
    assert (row.visit_length, row.step_length, row.age) == (65, 4, 30)


def test_text_dates_and_times(spark):
    typed = actions(spark, session_of("s", 5)).limit(1)
    text = typed.withColumns({"date": F.lit("2024-01-03"), "action_time": F.lit("2024-01-03 9:05:07")})
    text = text.unionByName(text.withColumn("action_time", F.lit("2024-01-03 09:05:09")))
    text = text.unionByName(text.limit(1).withColumn("action_time", F.lit("not a time")))
    in_range = actions_in_range(text, TaskParams(start_date=date(2024, 1, 3), end_date=date(2024, 1, 3)))
    (row,) = S.session_aggregate(typed_actions(in_range), users(spark)).collect()
    assert (row.visit_length, row.step_length) == (2, 3)
    assert actions_in_range(text, TaskParams(start_date=date(2024, 1, 4))).count() == 0


def test_wrong_input_is_named(spark):
    with pytest.raises(ValueError, match="missing column age"):
        S.session_aggregate(actions(spark, []), users(spark).drop("age"))


PEOPLE = [(1, 20, "p1", "c1", "male"), (2, 30, "p2", "c2", "female"), (3, 40, "p3", "c3", "male")]


def some_sessions(spark):
    rows = (
        session_of("a", 5, user_id=1, search_keyword="k1", click_category_id=1)
        + session_of("b", 5, user_id=2, search_keyword="k2", click_category_id=11)
        + session_of("c", 5, user_id=3)
    )
    return actions(spark, rows), users(spark, PEOPLE)


@pytest.mark.parametrize(
    "params, want",
    [
        (TaskParams(), "abc"),
        (TaskParams(start_age=20, end_age=30), "ab"),
        (TaskParams(start_age=30), "abc"),
        (TaskParams(professionals=("p1", "p3")), "ac"),
        (TaskParams(cities=("c2",)), "b"),
        (TaskParams(sex="male"), "ac"),
        (TaskParams(keywords=("k2", "k9")), "b"),
        (TaskParams(category_ids=("1",)), "a"),
        (TaskParams(category_ids=("01",)), ""),
        (TaskParams(category_ids=("1", "11"), sex="female"), "b"),
        (TaskParams(keywords=()), ""),
    ],
)
def test_filters_agree(spark, params, want):
    frame, people = some_sessions(spark)
    slow = S.filter_sessions(S.session_aggregate(frame, people), params)
    fast = S.qualified_sessions(frame, people, params)
    for found in (slow, fast):
        assert "".join(sorted(r.session_id for r in found.select("session_id").collect())) == want


def test_ratios(spark):
    lengths = [2] * 1 + [5] * 2 + [0] * 4
    frame = spark.createDataFrame([(v, 1) for v in lengths], "visit_length bigint, step_length bigint")
    row = S.session_stats(frame).first()
    # 1/7 = 0.1428.. and 2/7 = 0.2857..
    assert (row.session_count, row["1s_3s_ratio"], row["4s_6s_ratio"], row["1_3_ratio"]) == (7, 0.14, 0.29, 1.0)


def test_half_is_rounded_up(spark):
    frame = spark.createDataFrame([(2 if i < 57 else 0, 1) for i in range(200)], "visit_length bigint, step_length bigint")
    assert S.session_stats(frame).first()["1s_3s_ratio"] == 0.29  # 0.285


def test_no_sessions(spark):
    frame, people = some_sessions(spark)
    none = S.qualified_sessions(frame, people, TaskParams(cities=("nowhere",)))
    row = S.session_stats(none).first()
    assert row.session_count == 0 and row["30m_ratio"] is None
    assert S.extract_session_ids(none).count() == 0


def test_extraction(spark):
    rows = []
    for day in range(2):
        for i in range(40 if day == 0 else 10):
            hour = 0 if i < 10 else 1
            rows.append({"session_id": f"{day}-{i}", "user_id": 1, "page_id": 1,
                         "action_time": at(3600 * hour + i, day), "search_keyword": "k"})
    frame, people = actions(spark, rows), users(spark)
    found = S.qualified_sessions(frame, people, EVERYTHING)
    quota = {(r.day.day, r.hour): r.quota for r in S.extraction_quota(found, 25).collect()}
    # 25 over two days is 12 a day; a quarter and three quarters of it on day one, at most 10 on day two.
    assert quota == {(3, "09"): 3, (3, "10"): 9, (4, "09"): 10}
    ids = {r.session_id for r in S.extract_session_ids(found, 25, "x").collect()}
    assert len(ids) == 22
    assert ids == {r.session_id for r in S.extract_session_ids(found.repartition(5), 25, "x").collect()}
    assert ids != {r.session_id for r in S.extract_session_ids(found, 25, "y").collect()}
    assert S.session_details(frame, S.extract_session_ids(found, 25, "x"), 25).count() == 22
    lists = S.extract_sessions(frame, people, EVERYTHING, 25, "x").collect()
    assert {r.session_id for r in lists} == ids and all(r.search_keywords == ["k"] for r in lists)
    # More than Spark limits per group by itself: drawn through salted groups.
    assert S.extract_session_ids(found, 5000).count() == 50
