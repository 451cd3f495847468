"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

# The input tables of FIXTURES.md as common table expressions.
_ACTIONS = """
ev AS (
  SELECT ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
user_visit_action AS (
  SELECT CAST(ts AS DATE) AS date, user_id,
         CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS session_id,
         k % 10 AS page_id, ts AS action_time,
         CASE WHEN event_type = 'view' THEN 'kw' || CAST(k % 10 AS VARCHAR) END AS search_keyword,
         CASE WHEN event_type = 'click' THEN k % 20 END AS click_category_id,
         CASE WHEN event_type = 'click' THEN k END AS click_product_id,
         CASE WHEN event_type = 'signup' THEN CAST(k % 20 AS VARCHAR) || ',' || CAST((k + 7) % 20 AS VARCHAR) END AS order_category_ids,
         CASE WHEN event_type = 'signup' THEN CAST(k AS VARCHAR) || ',' || CAST((k + 7) % 100 AS VARCHAR) END AS order_product_ids,
         CASE WHEN event_type = 'purchase' THEN CAST(k % 20 AS VARCHAR) END AS pay_category_ids,
         CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_product_ids,
         user_id % 25 AS city_id
  FROM ev
),
action AS (
  SELECT * FROM user_visit_action WHERE date >= DATE '2024-01-03' AND date <= DATE '2024-01-25'
)"""

_USERS = """
user_info AS (
  SELECT c_custkey AS user_id, c_name AS name, CAST(18 + c_custkey % 43 AS INTEGER) AS age,
         c_mktsegment AS professional, n_name AS city,
         CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""

_CITIES = """
city_info AS (
  SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, r_name AS area
  FROM nation JOIN region ON n_regionkey = r_regionkey
)"""

_PRODUCTS = """
product_info AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         '{"product_status": ' || CAST(p_partkey % 2 AS VARCHAR) || '}' AS extend_info
  FROM part
)"""

_SESSIONS = f"""{_ACTIONS},{_USERS},
rolled AS (
  SELECT session_id, max(user_id) AS user_id,
         string_agg(DISTINCT search_keyword, ',' ORDER BY search_keyword) AS search_keywords,
         list_sort(list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL)) AS categories,
         list_sort(list(DISTINCT search_keyword) FILTER (search_keyword IS NOT NULL)) AS keywords,
         min(action_time) AS start_at,
         CAST(epoch(date_trunc('second', max(action_time))) - epoch(date_trunc('second', min(action_time))) AS BIGINT) AS visit_length,
         count(*) AS step_length
  FROM action GROUP BY session_id
),
session AS (
  SELECT rolled.*, age, professional, city, sex FROM rolled JOIN user_info USING (user_id)
),
hit AS (
  SELECT * FROM session
  WHERE age BETWEEN 20 AND 50 AND professional IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND sex = 'male'
    AND list_has_any(keywords, ['kw1', 'kw3', 'kw5', 'kw7'])
)"""

_SESSION_COLUMNS = """session_id, user_id, coalesce(search_keywords, '') AS search_keywords,
       coalesce(array_to_string(categories, ','), '') AS click_category_ids,
       strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_time, visit_length, step_length,
       age, professional, city, sex"""

_DETAIL_COLUMNS = """user_id, session_id, page_id, strftime(action_time, '%Y-%m-%d %H:%M:%S.%f') AS action_time,
       search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids,
       pay_category_ids, pay_product_ids"""

_COUNTERS = """count(*) AS session_count,
       count_if(visit_length BETWEEN 1 AND 3) AS v_1s_3s, count_if(visit_length BETWEEN 4 AND 6) AS v_4s_6s,
       count_if(visit_length BETWEEN 7 AND 9) AS v_7s_9s, count_if(visit_length BETWEEN 10 AND 30) AS v_10s_30s,
       count_if(visit_length > 30 AND visit_length <= 60) AS v_30s_60s,
       count_if(visit_length > 60 AND visit_length <= 180) AS v_1m_3m,
       count_if(visit_length > 180 AND visit_length <= 600) AS v_3m_10m,
       count_if(visit_length > 600 AND visit_length <= 1800) AS v_10m_30m,
       count_if(visit_length > 1800) AS v_30m,
       count_if(step_length BETWEEN 1 AND 3) AS s_1_3, count_if(step_length BETWEEN 4 AND 6) AS s_4_6,
       count_if(step_length BETWEEN 7 AND 9) AS s_7_9, count_if(step_length BETWEEN 10 AND 30) AS s_10_30,
       count_if(step_length > 30 AND step_length <= 60) AS s_30_60, count_if(step_length > 60) AS s_60"""

_COUNTER_NAMES = (
    "v_1s_3s", "v_4s_6s", "v_7s_9s", "v_10s_30s", "v_30s_60s", "v_1m_3m", "v_3m_10m", "v_10m_30m", "v_30m",
    "s_1_3", "s_4_6", "s_7_9", "s_10_30", "s_30_60", "s_60",
)

_RATIOS = ", ".join(
    f"CAST((200 * {name} + session_count) // (2 * session_count) AS DOUBLE) / 100 AS \"{name[2:]}_ratio\""
    for name in _COUNTER_NAMES
)

_DRAWN = f"""{_SESSIONS},
by_hour AS (
  SELECT CAST(start_at AS DATE) AS d, strftime(start_at, '%H') AS h, count(*) AS n FROM session GROUP BY 1, 2
),
by_day AS (SELECT d, sum(n) AS day_n FROM by_hour GROUP BY d),
quota AS (
  SELECT d, h, n, least(CAST(floor(CAST(n AS DOUBLE) / CAST(day_n AS DOUBLE)
         * floor(CAST(1000 AS DOUBLE) / (SELECT count(*) FROM by_day))) AS BIGINT), n) AS quota
  FROM by_hour JOIN by_day USING (d)
),
placed AS (
  SELECT session_id, CAST(start_at AS DATE) AS d, strftime(start_at, '%H') AS h,
         row_number() OVER (PARTITION BY CAST(start_at AS DATE), strftime(start_at, '%H')
                            ORDER BY md5('0' || session_id), session_id) AS rn
  FROM session
),
drawn AS (SELECT session_id FROM placed JOIN quota USING (d, h) WHERE rn <= quota)"""

_CATEGORIES = f"""{_SESSIONS},
visit AS (
  SELECT session_id, 'click' AS kind, click_category_id AS category_id FROM action WHERE click_category_id IS NOT NULL
  UNION ALL
  SELECT session_id, 'order', CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT) FROM action
  WHERE order_category_ids IS NOT NULL
  UNION ALL
  SELECT session_id, 'pay', CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT) FROM action
  WHERE pay_category_ids IS NOT NULL
),
counted AS (
  SELECT session_id, category_id, count_if(kind = 'click') AS click_count,
         count_if(kind = 'order') AS order_count, count_if(kind = 'pay') AS pay_count
  FROM visit WHERE session_id IN (SELECT session_id FROM session) GROUP BY 1, 2
),
category AS (
  SELECT category_id, CAST(sum(click_count) AS BIGINT) AS click_count,
         CAST(sum(order_count) AS BIGINT) AS order_count, CAST(sum(pay_count) AS BIGINT) AS pay_count
  FROM counted GROUP BY 1
),
top10 AS (
  SELECT * FROM category ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
),
ranked AS (
  SELECT category_id, session_id, click_count,
         row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS rn
  FROM counted WHERE click_count > 0 AND category_id IN (SELECT category_id FROM top10)
)"""

_AREAS = f"""{_ACTIONS},{_CITIES},{_PRODUCTS},
basic AS (
  SELECT city_id, city_name, area, click_product_id AS product_id
  FROM action JOIN city_info USING (city_id) WHERE click_product_id IS NOT NULL
),
area_count AS (
  SELECT area, product_id, count(*) AS click_count,
         string_agg(DISTINCT CAST(city_id AS VARCHAR) || ':' || city_name, ','
                    ORDER BY CAST(city_id AS VARCHAR) || ':' || city_name) AS city_infos
  FROM basic GROUP BY 1, 2
),
full_count AS (
  SELECT area, product_id, click_count, city_infos, product_name,
         CASE WHEN json_extract_string(extend_info, '$.product_status') = '0'
              THEN 'Self' ELSE 'Third Party' END AS product_status
  FROM area_count JOIN product_info USING (product_id)
)"""

_ADS = f"""{_CITIES},
ad_click AS (
  SELECT ts, area AS province, city_name AS city, user_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS ad_id
  FROM events JOIN city_info ON user_id % 25 = city_id WHERE event_type IN ('click', 'view')
),
user_count AS (
  SELECT CAST(ts AS DATE) AS d, user_id, ad_id, count(*) AS click_count FROM ad_click GROUP BY 1, 2, 3
),
listed AS (SELECT DISTINCT user_id FROM user_count WHERE click_count >= 2),
stat AS (
  SELECT CAST(ts AS DATE) AS d, province, city, ad_id, count(*) AS click_count FROM ad_click GROUP BY 1, 2, 3, 4
),
by_province AS (
  SELECT d, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM stat GROUP BY 1, 2, 3
),
top_ads AS (
  SELECT *, row_number() OVER (PARTITION BY d, province ORDER BY click_count DESC, ad_id) AS rn FROM by_province
)"""

_D = "strftime(d, '%Y-%m-%d') AS date"

_STAT = f"WITH {_ADS} SELECT {_D}, province, city, ad_id, click_count FROM stat"
_TOP_ADS = f"WITH {_ADS} SELECT {_D}, province, ad_id, click_count FROM top_ads WHERE rn <= 3"
_TREND = f"""WITH {_ADS} SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour,
       strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count
FROM ad_click GROUP BY 1, 2, 3, 4"""
_LISTED = f"WITH {_ADS} SELECT user_id FROM listed"

_JOINED = f"""WITH {_AREAS}
SELECT product_id, product_name, count(*) AS click_count FROM basic JOIN product_info USING (product_id) GROUP BY 1, 2"""

_TOP_PRODUCTS = f"""WITH {_AREAS}
SELECT area, CASE WHEN area IN ('ASIA', 'EUROPE') THEN 'A Level' WHEN area = 'AMERICA' THEN 'B Level'
                  ELSE 'D Level' END AS area_level,
       product_id, click_count, city_infos, product_name, product_status
FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS rn FROM full_count)
WHERE rn <= 3"""

ORACLES: dict[str, str] = {
    "actions_date_range": f"""WITH {_ACTIONS}
SELECT {_DETAIL_COLUMNS}, strftime(date, '%Y-%m-%d') AS date, city_id FROM action""",
    "clicks_date_range": f"""WITH {_ACTIONS}
SELECT city_id, click_product_id AS product_id FROM action WHERE click_product_id IS NOT NULL""",
    "session_aggregate": f"WITH {_SESSIONS} SELECT {_SESSION_COLUMNS} FROM session",
    "session_filter_all": f"WITH {_SESSIONS} SELECT {_SESSION_COLUMNS} FROM hit",
    "filter_between": f"WITH {_SESSIONS} SELECT session_id, age FROM session WHERE age BETWEEN 25 AND 35",
    "filter_in_list": f"""WITH {_SESSIONS} SELECT session_id, city, array_to_string(categories, ',') AS click_category_ids
FROM session WHERE city IN ('NATION_1', 'NATION_4', 'NATION_9') AND list_has_any(categories, [1, 7, 12])""",
    "filter_equal": f"WITH {_SESSIONS} SELECT session_id, sex FROM session WHERE sex = 'female'",
    "session_counters": f"WITH {_SESSIONS} SELECT {_COUNTERS} FROM session",
    "session_stats": f"""WITH {_SESSIONS}, c AS (SELECT {_COUNTERS} FROM session)
SELECT session_count, {_RATIOS} FROM c""",
    "session_stats_filtered": f"""WITH {_SESSIONS}, c AS (SELECT {_COUNTERS} FROM hit)
SELECT session_count, {_RATIOS} FROM c""",
    "session_count_by_date_hour": f"""WITH {_SESSIONS}
SELECT strftime(start_at, '%Y-%m-%d_%H') AS date_hour, count(*) AS session_count FROM session GROUP BY 1""",
    "session_extract_quota": f"""WITH {_DRAWN}
SELECT strftime(d, '%Y-%m-%d') AS day, h AS hour, n AS session_count, quota FROM quota""",
    "session_extract": f"""WITH {_DRAWN}
SELECT session_id, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_time,
       coalesce(search_keywords, '') AS search_keywords,
       coalesce(array_to_string(categories, ','), '') AS click_category_ids
FROM session WHERE session_id IN (SELECT session_id FROM drawn)""",
    "session_extract_detail": f"""WITH {_DRAWN}
SELECT {_DETAIL_COLUMNS} FROM action WHERE session_id IN (SELECT session_id FROM drawn)""",
    "category_counts": f"WITH {_CATEGORIES} SELECT * FROM category",
    "top10_category": f"WITH {_CATEGORIES} SELECT * FROM top10",
    "category_session_clicks": f"""WITH {_CATEGORIES}
SELECT category_id, session_id, click_count FROM counted WHERE click_count > 0""",
    "top10_session": f"WITH {_CATEGORIES} SELECT category_id, session_id, click_count FROM ranked WHERE rn <= 10",
    "top10_session_detail": f"""WITH {_CATEGORIES}
SELECT {_DETAIL_COLUMNS} FROM action WHERE session_id IN (SELECT session_id FROM ranked WHERE rn <= 10)""",
    "click_product_basic": f"WITH {_AREAS} SELECT city_id, city_name, area, product_id FROM basic",
    "area_product_click_count": f"WITH {_AREAS} SELECT * FROM area_count",
    "area_product_full": f"WITH {_AREAS} SELECT * FROM full_count",
    "area_top3_product": _TOP_PRODUCTS,
    "salted_group_count": f"""WITH {_AREAS}
SELECT CAST(product_id AS VARCHAR) || ':' || area AS product_area, count(*) AS click_count FROM basic GROUP BY 1""",
    "salted_join": _JOINED,
    "skew_join": _JOINED,
    "random_prefix_round_trip": """
SELECT p_partkey AS product_id, p_name AS restored, TRUE AS prefixed FROM part""",
    "concat_string_field": """
SELECT c_custkey AS user_id, c_mktsegment AS professional, NULL AS keywords,
       CAST(c_custkey % 43 AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS absent,
       (c_custkey % 3 = 0) AS empty_name, c_mktsegment || ',x' AS trimmed,
       CASE WHEN c_custkey % 43 BETWEEN 10 AND 99 THEN CAST(c_custkey % 43 AS VARCHAR)
            ELSE '0' || CAST(c_custkey % 43 AS VARCHAR) END AS padded
FROM customer""".replace("NULL AS keywords", "CAST(NULL AS VARCHAR) AS keywords"),
    "date_functions": """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y%m%d') AS date_key,
       strftime(ts, '%Y%m%d%H%M') AS minute_key, strftime(ts, '%Y-%m-%d_%H') AS date_hour,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed_time, strftime(ts, '%Y-%m-%d') AS parsed_key,
       strftime(ts, '%Y-%m-%d') AS millis_day,
       CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) AS seconds_after,
       ts < TIMESTAMP '2024-01-15 00:00:00' AS is_before, ts > TIMESTAMP '2024-01-15 00:00:00' AS is_after
FROM events""",
    "task_param_fields": """
SELECT c_custkey AS task_id, CAST(18 + c_custkey % 20 AS VARCHAR) AS "startAge",
       CAST(40 + c_custkey % 20 AS VARCHAR) AS "endAge", c_mktsegment AS professionals,
       CASE WHEN c_custkey % 2 = 0 THEN 'male' END AS sex, CAST(NULL AS VARCHAR) AS keywords
FROM customer""",
    "registered_functions": f"""WITH {_PRODUCTS}
SELECT product_name, product_id // 100 AS ids, string_agg(DISTINCT CAST(product_id AS VARCHAR) || ':' || product_name, ','
         ORDER BY CAST(product_id AS VARCHAR) || ':' || product_name) AS labels,
       string_agg(DISTINCT json_extract_string(extend_info, '$.product_status'), ','
         ORDER BY json_extract_string(extend_info, '$.product_status')) AS statuses
FROM product_info GROUP BY 1, 2""",
    "number_functions": """
SELECT p_partkey, round(p_size / 8.0::DOUBLE, 2) AS two, round(p_size / 8.0::DOUBLE, 0) AS none,
       round(p_size / 8.0::DOUBLE, 1) AS one, 1 AS days FROM part""",
    "observed_rows": f"WITH {_ADS} SELECT count(*) AS click_rows FROM ad_click",
    "ad_log_parse": f"""WITH {_ADS}
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS clicked_at, replace(province, ' ', '_') AS province,
       replace(city, ' ', '_') AS city, user_id, ad_id FROM ad_click""",
    "ad_log_rejects": f"""WITH {_ADS},
line AS (
  SELECT ad_id, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ms,
         replace(province, ' ', '_') || ' ' || replace(city, ' ', '_') AS place, CAST(user_id AS VARCHAR) AS u FROM ad_click
)
SELECT CASE ad_id WHEN 3 THEN 'x' || ms || ' ' || place || ' ' || u || ' 3'
                  WHEN 4 THEN '9223372036854775807 ' || place || ' ' || u || ' 4'
                  WHEN 5 THEN ms || ' ' || place WHEN 6 THEN ''
                  ELSE ms || ' ' || place || ' u' || u || ' 7' END AS value
FROM line WHERE ad_id BETWEEN 3 AND 7""",
    "ad_user_click_count": f"WITH {_ADS} SELECT {_D}, user_id, ad_id, click_count FROM user_count",
    "ad_blacklist": _LISTED,
    "ad_filtered_clicks": f"""WITH {_ADS}
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS clicked_at, province, city, user_id, ad_id
FROM ad_click WHERE user_id NOT IN (SELECT user_id FROM listed)""",
    "ad_stat": _STAT,
    "ad_stat_filtered": f"""WITH {_ADS}
SELECT strftime(ts, '%Y-%m-%d') AS date, province, city, ad_id, count(*) AS click_count
FROM ad_click WHERE user_id NOT IN (SELECT user_id FROM listed) GROUP BY 1, 2, 3, 4""",
    "ad_province_clicks": f"WITH {_ADS} SELECT {_D}, province, ad_id, click_count FROM by_province",
    "ad_province_top3": _TOP_ADS,
    "ad_click_trend": _TREND,
    "ad_click_sliding": f"""WITH {_ADS},
w AS (
  SELECT time_bucket(INTERVAL '10 minutes', ts) - (i * INTERVAL '10 minutes') AS window_start, ts, ad_id
  FROM ad_click, range(6) r(i)
)
SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, strftime(ts, '%Y-%m-%d %H:%M') AS minute,
       ad_id, count(*) AS click_count
FROM w GROUP BY 1, 2, 3""",
    "stream_ad_stat": _STAT,
    "stream_province_top3": _TOP_ADS,
    "stream_click_trend": _TREND,
    "stream_window_trend": _TREND,
    "stream_blacklist": _LISTED,
    "stream_user_click_count": f"WITH {_ADS} SELECT {_D}, user_id, ad_id, click_count FROM user_count",
    "product_job": f"SELECT CAST(2 AS BIGINT) AS task_id, * FROM ({_TOP_PRODUCTS})",
    "session_job": f"""WITH {_CATEGORIES},
by_hour AS (
  SELECT CAST(start_at AS DATE) AS d, strftime(start_at, '%H') AS h, count(*) AS n FROM session GROUP BY 1, 2
),
by_day AS (SELECT d, sum(n) AS day_n FROM by_hour GROUP BY d),
quota AS (
  SELECT d, h, least(CAST(floor(CAST(n AS DOUBLE) / CAST(day_n AS DOUBLE)
         * floor(CAST(1000 AS DOUBLE) / (SELECT count(*) FROM by_day))) AS BIGINT), n) AS quota
  FROM by_hour JOIN by_day USING (d)
),
drawn AS (
  SELECT session_id, d, h FROM (
    SELECT session_id, CAST(start_at AS DATE) AS d, strftime(start_at, '%H') AS h,
           row_number() OVER (PARTITION BY CAST(start_at AS DATE), strftime(start_at, '%H')
                              ORDER BY md5('0' || session_id), session_id) AS rn
    FROM session) JOIN quota USING (d, h) WHERE rn <= quota
)
SELECT 'session_aggr_stat' AS table_name, CAST(1 AS BIGINT) AS task_id, CAST(1 AS BIGINT) AS row_count
UNION ALL SELECT 'session_random_extract', 1, count(*) FROM drawn
UNION ALL SELECT 'session_detail', 1,
  (SELECT count(*) FROM action WHERE session_id IN (SELECT session_id FROM drawn))
  + (SELECT count(*) FROM action WHERE session_id IN (SELECT session_id FROM ranked WHERE rn <= 10))
UNION ALL SELECT 'top10_category', 1, count(*) FROM top10
UNION ALL SELECT 'top10_session', 1, count(*) FROM ranked WHERE rn <= 10""",
    "page_flow_conversion": f"""WITH {_ACTIONS},
step AS (
  SELECT page_id AS a, lead(page_id) OVER (PARTITION BY session_id ORDER BY action_time, page_id) AS b FROM action
),
n AS (
  SELECT (SELECT count(*) FROM action WHERE page_id = 1) AS v,
         count_if(a = 1 AND b = 2) AS p1, count_if(a = 2 AND b = 3) AS p2, count_if(a = 3 AND b = 4) AS p3 FROM step
),
r AS (
  SELECT CASE WHEN v = 0 THEN 0 ELSE (200 * p1 + v) // (2 * v) END AS r1,
         CASE WHEN p1 = 0 THEN 0 ELSE (200 * p2 + p1) // (2 * p1) END AS r2,
         CASE WHEN p2 = 0 THEN 0 ELSE (200 * p3 + p2) // (2 * p2) END AS r3 FROM n
)
SELECT '1_2=' || printf('%.2f', r1 / 100.0) || '|2_3=' || printf('%.2f', r2 / 100.0)
       || '|3_4=' || printf('%.2f', r3 / 100.0) AS convert_rate FROM r""",
    "page_steps": f"""WITH {_ACTIONS},
step AS (
  SELECT page_id AS from_page, lead(page_id) OVER (PARTITION BY session_id ORDER BY action_time, page_id) AS to_page
  FROM action
)
SELECT from_page, to_page, count(*) AS steps FROM step WHERE to_page IS NOT NULL GROUP BY 1, 2""",
}

# Queries that are not about a task look at all dates.
_RANGE = " WHERE date >= DATE '2024-01-03' AND date <= DATE '2024-01-25'"
for _name in (
    "filter_between", "filter_in_list", "filter_equal", "click_product_basic", "salted_group_count", "salted_join",
    "skew_join", "page_flow_conversion", "page_steps",
):
    ORACLES[_name] = ORACLES[_name].replace(_RANGE, "")
ORACLES["skew_join_types"] = f"""WITH {_AREAS},
half AS (
  SELECT CASE WHEN click_product_id % 2 = 0 THEN 2 ELSE click_product_id END AS product_id
  FROM action WHERE click_product_id IS NOT NULL
)
SELECT h.product_id, p.product_name, count(*) AS click_count
FROM half h LEFT JOIN product_info p USING (product_id) GROUP BY 1, 2""".replace(_RANGE, "")

# Contents of the session job's tables, each row as one text. None of its columns is null in a drawn session's lists.
_SHARES = ", ".join(f"printf('%.2f', \"{name[2:]}_ratio\")" for name in _COUNTER_NAMES)
_DETAIL_NAMES = (
    "user_id", "session_id", "page_id", "action_time", "search_keyword", "click_category_id", "click_product_id",
    "order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids",
)
_DETAIL_TEXT = " || '|' || ".join(f"coalesce(CAST({name} AS VARCHAR), '-')" for name in _DETAIL_NAMES)
ORACLES["session_job"] = f"""WITH {_CATEGORIES},
{_DRAWN.removeprefix(_SESSIONS + ",")},
share AS (SELECT session_count, {_RATIOS} FROM (SELECT {_COUNTERS} FROM session)),
wanted AS (SELECT session_id FROM drawn UNION SELECT session_id FROM ranked WHERE rn <= 10),
detail AS (SELECT {_DETAIL_COLUMNS} FROM action WHERE session_id IN (SELECT session_id FROM wanted))
SELECT 'session_aggr_stat' AS table_name, concat_ws('|', CAST(session_count AS VARCHAR), {_SHARES}) AS content FROM share
UNION ALL
SELECT 'session_random_extract', session_id || '|' || strftime(start_at, '%Y-%m-%d %H:%M:%S') || '|'
       || coalesce(search_keywords, '') || '|' || coalesce(array_to_string(categories, ','), '')
FROM session WHERE session_id IN (SELECT session_id FROM drawn)
UNION ALL SELECT 'session_detail', {_DETAIL_TEXT} FROM detail
UNION ALL SELECT 'top10_category', concat_ws('|', category_id, click_count, order_count, pay_count) FROM top10
UNION ALL SELECT 'top10_session', concat_ws('|', category_id, session_id, click_count) FROM ranked WHERE rn <= 10"""

# The streams get the month in four parts, one batch each; a user is listed from the batch after the one in which
# a count of a day and ad reaches the threshold, and until then all clicks of the user are accepted.
_BATCHES = f"""{_ADS},
batched AS (SELECT *, CAST(ts AS DATE) AS d, least((day(ts) - 1) // 7, 3) AS batch FROM ad_click),
reached AS (
  SELECT user_id, min(batch) AS batch FROM (
    SELECT user_id, d, ad_id, batch, count(*) AS n FROM batched GROUP BY 1, 2, 3, 4
  ) WHERE n >= 2 GROUP BY 1
),
accepted AS (
  SELECT b.* FROM batched b LEFT JOIN reached r USING (user_id) WHERE r.batch IS NULL OR b.batch <= r.batch
)"""
ORACLES["stream_blacklist"] = f"WITH {_BATCHES} SELECT user_id FROM reached"
ORACLES["stream_user_click_count"] = f"""WITH {_BATCHES}
SELECT {_D}, user_id, ad_id, count(*) AS click_count FROM accepted GROUP BY d, user_id, ad_id"""
ORACLES["ad_job"] = f"""WITH {_BATCHES},
accepted_top AS (
  SELECT d, province, ad_id, count(*) AS click_count,
         row_number() OVER (PARTITION BY d, province ORDER BY count(*) DESC, ad_id) AS rank
  FROM accepted GROUP BY 1, 2, 3
)
SELECT {_D}, province, ad_id, click_count FROM accepted_top WHERE rank <= 3"""
ORACLES["stream_sliding_trend"] = f"""WITH {_ADS},
step AS (SELECT epoch_us(ts) // 10000000 AS step, ad_id, count(*) AS n FROM ad_click GROUP BY 1, 2),
slid AS (
  SELECT step + i AS w, ad_id, sum(n) AS n FROM step, (SELECT unnest(range(360)) AS i) GROUP BY 1, 2
)
SELECT ad_id, count(*) AS windows, CAST(sum(n) AS BIGINT) AS clicks, CAST(max(n) AS BIGINT) AS busiest FROM slid GROUP BY 1"""
ORACLES["page_job"] = f"SELECT CAST(3 AS BIGINT) AS task_id, * FROM ({ORACLES['page_flow_conversion']})"

# The log and the distinct users.
ORACLES["ad_log_segments"] = ORACLES["ad_log_parse"]
ORACLES["ad_daily_users"] = f"""WITH {_ADS}
SELECT strftime(ts, '%Y-%m-%d') AS date, ad_id, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM ad_click GROUP BY 1, 2"""
ORACLES["ad_range_users"] = f"WITH {_ADS} SELECT ad_id, count(DISTINCT user_id) AS users FROM ad_click GROUP BY 1"
ORACLES["ad_returning_users"] = f"""WITH {_ADS},
seen AS (SELECT DISTINCT CAST(ts AS DATE) AS d, ad_id, user_id FROM ad_click)
SELECT ad_id, count(*) AS users FROM seen a JOIN seen b USING (ad_id, user_id)
WHERE a.d = DATE '2024-01-03' AND b.d = DATE '2024-01-04' GROUP BY 1"""
# Places stand in the log with underscores.
ORACLES["stream_log_stat"] = f"""WITH {_ADS}
SELECT strftime(ts, '%Y-%m-%d') AS date, replace(province, ' ', '_') AS province, replace(city, ' ', '_') AS city, ad_id,
       count(*) AS click_count FROM ad_click GROUP BY 1, 2, 3, 4"""
ORACLES["stream_log_metrics"] = f"""WITH {_ADS}
SELECT CAST(least((day(ts) - 1) // 15, 1) AS BIGINT) AS batch, count(*) AS rows, count_if(ad_id <> 3) AS accepted,
       count_if(ad_id = 3) AS rejected FROM ad_click GROUP BY 1"""
ORACLES["stream_interval_stat"] = _STAT
