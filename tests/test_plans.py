from collections import Counter

import pytest
from frames import actions, ad_clicks, at, cities, products, session_of, users
from pyspark.sql import functions as F

from visitlens.params import TaskParams
from visitlens.plans import ads as A
from visitlens.plans import categories as C
from visitlens.plans import pages as G
from visitlens.plans import products as P
from visitlens.plans import sessions as S


def test_category_counts(spark):
    rows = [
        {"session_id": "s", "user_id": 1, "action_time": at(0), "click_category_id": 1},
        {"session_id": "s", "user_id": 1, "action_time": at(1), "click_category_id": 11},
        {"session_id": "s", "user_id": 1, "action_time": at(2), "order_category_ids": "1,2,1"},
        {"session_id": "s", "user_id": 1, "action_time": at(3), "pay_category_ids": "2,x,"},
        {"session_id": "s", "user_id": 1, "action_time": at(4), "search_keyword": "k"},
        {"session_id": "lost", "user_id": 9, "action_time": at(0), "click_category_id": 1},
    ]
    frame = actions(spark, rows)
    visits = C.visits_in_sessions(frame, S.qualified_sessions(frame, users(spark), TaskParams()))
    counts = {r.category_id: (r.click_count, r.order_count, r.pay_count) for r in C.category_counts(visits).collect()}
    assert counts == {1: (1, 2, 0), 11: (1, 0, 0), 2: (0, 1, 1)}
    assert [r.category_id for r in C.top_categories(visits, 2).collect()] == [1, 11]


def test_top_categories_compare_long_counts(spark):
    big = 2**33
    counts = spark.createDataFrame(
        [(1, 5, 0, 0), (2, 5, 1, 0), (3, 5, 1, big), (4, big, 0, 0), (5, 5, 1, big)],
        "category_id bigint, click_count bigint, order_count bigint, pay_count bigint",
    )
    assert [r.category_id for r in counts.orderBy(*C.category_order()).collect()] == [4, 3, 5, 2, 1]


def test_top_sessions(spark):
    rows = []
    for i in range(12):
        rows += session_of(f"s{i:02}", 5, steps=2 + (i >= 10), click_category_id=1)
    rows += session_of("only", 5, click_category_id=2)
    frame = actions(spark, rows)
    visits = C.visits_in_sessions(frame, S.qualified_sessions(frame, users(spark), TaskParams()))
    found = C.top_sessions_per_category(visits, C.top_categories(visits)).collect()
    first = sorted((-r.click_count, r.session_id) for r in found if r.category_id == 1)
    assert first == [(-3, "s10"), (-3, "s11")] + [(-2, f"s{i:02}") for i in range(8)]
    assert [r.session_id for r in found if r.category_id == 2] == ["only"]


CITIES = [(1, "Xi", "China East"), (2, "Bo", "China East"), (11, "Yu", "West North"), (3, "Za", "Elsewhere"),
          (4, "Mi", "China Middle")]


def test_area_top_products(spark):
    clicks = [(1, 7)] * 3 + [(2, 7)] * 2 + [(2, 8)] * 5 + [(1, 9)] + [(1, 10)] + [(11, 8)] + [(3, 9)] + [(4, 10)]
    clicks += [(1, 99)] * 9 + [(99, 7)] * 9
    rows = [{"session_id": "s", "user_id": 1, "action_time": at(0), "city_id": c, "click_product_id": p}
            for c, p in clicks]
    rows += [{"session_id": "s", "user_id": 1, "action_time": at(0), "city_id": 1}]
    goods = [(7, "seven", '{"product_status": 0}'), (8, "eight", '{"product_status": 1}'), (9, "nine", "{bad"),
             (10, "ten", '{"other": 0}')]
    best = P.area_top_products(
        actions(spark, rows), cities(spark, CITIES), products(spark, goods), TaskParams()
    ).collect()
    got = {(r.area, r.product_id): (r.area_level, r.click_count, r.city_infos, r.product_status) for r in best}
    assert got == {
        ("China East", 7): ("A Level", 5, "1:Xi,2:Bo", "Self"),
        ("China East", 8): ("A Level", 5, "2:Bo", "Third Party"),
        ("China East", 9): ("A Level", 1, "1:Xi", "Third Party"),
        ("West North", 8): ("C Level", 1, "11:Yu", "Third Party"),
        ("China Middle", 10): ("B Level", 1, "4:Mi", "Third Party"),
        ("Elsewhere", 9): ("D Level", 1, "3:Za", "Third Party"),
    }


@pytest.mark.parametrize("clicks, listed", [(99, set()), (100, {5}), (101, {5})])
def test_blacklist_threshold(spark, clicks, listed):
    rows = [(at(i), "p", "c", 5, 1) for i in range(clicks)]
    # A hundred clicks spread over ads, days or users list nobody.
    rows += [(at(i), "p", "c", 6, i % 2) for i in range(150)]
    rows += [(at(i, i % 2), "p", "c", 7, 1) for i in range(150)]
    frame = ad_clicks(spark, rows)
    found = A.blacklist(frame)
    assert {r.user_id for r in found.collect()} == listed
    kept = A.filter_blacklisted(frame, found)
    assert {r.user_id for r in kept.select("user_id").distinct().collect()} == {5, 6, 7} - listed
    assert A.ad_stat(kept).agg(F.sum("click_count")).first()[0] == len(rows) - (clicks if listed else 0)


def test_province_top_ads(spark):
    rows = []
    for ad, clicks in {1: 4, 2: 4, 3: 3, 4: 3, 5: 9}.items():
        rows += [(at(i), "p", "c1" if i % 2 else "c2", 1, ad) for i in range(clicks)]
    rows += [(at(0, 1), "p", "c1", 1, 4)]
    found = A.province_top_ads(A.ad_stat(ad_clicks(spark, rows))).collect()
    assert sorted((r.date.day, -r.click_count, r.ad_id) for r in found) == [
        (3, -9, 5), (3, -4, 1), (3, -4, 2), (4, -1, 4)
    ]


def test_sliding_trend_equals_plain_windows(spark):
    rows = [(at(7 * i % 5000), "p", "c", 1, i % 3) for i in range(300)]
    frame = ad_clicks(spark, rows)
    fast = A.sliding_click_trend(frame, "60 minutes", "1 minutes")
    plain = frame.groupBy(
        F.window("ts", "60 minutes", "1 minutes").alias("w"), F.date_trunc("minute", "ts").alias("minute"), "ad_id"
    ).count().select(F.col("w.start").alias("window_start"), "minute", "ad_id", F.col("count").alias("click_count"))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect()))


def brute_steps(rows):
    by_session = {}
    for s, t, p in rows:
        by_session.setdefault(s, []).append((t, p))
    steps = Counter()
    for visits in by_session.values():
        visits.sort()
        steps.update((a[1], b[1]) for a, b in zip(visits, visits[1:]))
    return dict(steps)


def test_page_steps(spark):
    rows = [(f"s{i % 4}", at((i * 7919) % 30_000 // 5 * 5), (i * i) % 5) for i in range(2000)]
    rows += [("copies", at(10), 3)] * 50 + [("copies", at(10), 4)] * 2 + [("one", at(0), 1)]
    frame = actions(spark, [{"session_id": s, "user_id": 1, "action_time": t, "page_id": p} for s, t, p in rows])
    for piece, hot in (("hour", 10**6), ("minute", 10**6), ("day", 10**6), ("day", 2), ("hour", 1), ("minute", 0)):
        got = {(r.from_page, r.to_page): r.steps for r in G.page_steps(frame, piece, hot).collect()}
        assert got == brute_steps(rows)


def test_page_flow(spark):
    pages = [1, 2, 3, 1, 2, 1, 5]
    frame = actions(spark, [{"session_id": "s", "user_id": 1, "action_time": at(i), "page_id": p}
                            for i, p in enumerate(pages)])
    # 1 was visited three times and led to 2 twice; one of those went on to 3; nothing goes 3 to 4.
    assert G.page_flow_conversion(frame, (1, 2, 3, 4)).first()[0] == "1_2=0.67|2_3=0.50|3_4=0.00"
    assert G.page_flow_conversion(frame, (8, 9)).first()[0] == "8_9=0.00"
    with pytest.raises(ValueError):
        G.page_flow_conversion(frame, (1,))
