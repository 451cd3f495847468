from datetime import date

import pytest
from pyspark.sql import functions as F

import visitlens.functions as fn
from visitlens.functions.sql import register_functions
from visitlens.params import PARAM_FIELDS, TaskParams, load_task_params, task_param_fields
from visitlens.schemas import TASK


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, name, want",
    [
        ("a=1|b=2", "b", "2"),
        ("a=|b=2", "a", None),
        ("a=1|b=2", "c", None),
        ("a=1=2|b=2", "a", None),
        ("xa=1|a=2", "a", "2"),
        ("a=|a=3", "a", "3"),
        ("", "a", None),
        (None, "a", None),
        ("a.c=1|abc=2", "abc", "2"),
    ],
)
def test_string_field(spark, text, name, want):
    assert value(spark, fn.string_field(F.lit(text).cast("string"), name)) == want


def test_text(spark):
    lit = F.lit
    assert value(spark, fn.trim_comma(lit(",a,b,"))) == "a,b"
    assert value(spark, fn.trim_comma(lit(",,a"))) == ",a"
    assert value(spark, fn.pad_two(lit("7"))) == "07"
    assert value(spark, fn.pad_two(lit("17"))) == "17"
    assert value(spark, fn.is_empty(lit(None).cast("string"))) is True
    assert value(spark, fn.is_not_empty(lit("x"))) is True
    assert value(spark, fn.concat_long_string(lit(None).cast("bigint"), lit("x"), ":")) == "null:x"
    assert value(spark, fn.concat_long_string(lit(3), lit(None).cast("string"), ":")) == "3:null"
    assert value(spark, fn.json_field(lit('{"product_status": 0}'), "product_status")) == "0"
    assert value(spark, fn.json_field(lit("{broken"), "product_status")) is None
    assert value(spark, fn.remove_random_prefix(lit("9_a_b"))) == "a_b"
    assert value(spark, fn.remove_random_prefix(lit("a_b"))) == "a_b"


def test_group_concat_distinct(spark):
    frame = spark.createDataFrame([("11",), ("1",), ("11",), (None,)], "x string")
    assert frame.agg(fn.group_concat_distinct("x").alias("v")).first().v == "1,11"


def test_random_prefix_is_repeatable_and_in_range(spark):
    frame = spark.range(1000).select(fn.random_prefix(F.lit("v"), 4, ["id"]).alias("p"))
    first, again = [sorted(r.p for r in frame.collect()) for _ in range(2)]
    assert first == again and set(first) == {"0_v", "1_v", "2_v", "3_v"}


def test_dates(spark):
    stamp = fn.parse_time(F.lit("2024-01-03 9:05:07"))
    assert value(spark, fn.format_time(stamp)) == "2024-01-03 09:05:07"
    assert value(spark, fn.date_hour(stamp)) == "2024-01-03_09"
    assert value(spark, fn.format_minute_key(stamp)) == "202401030905"
    assert value(spark, fn.format_date_key(stamp)) == "20240103"
    assert value(spark, fn.parse_time(F.lit("soon"))) is None
    assert value(spark, fn.parse_date_key(F.lit("20240103"))) == date(2024, 1, 3)
    assert value(spark, fn.parse_date_key(F.lit("2024"))) is None
    assert value(spark, fn.date_of_epoch_millis(F.lit("1704272400123"))) == date(2024, 1, 3)
    assert value(spark, fn.timestamp_of_epoch_millis(F.lit("x"))) is None
    assert value(spark, fn.minus_seconds(F.timestamp_millis(F.lit(2001)), F.timestamp_millis(F.lit(999)))) == 2
    assert value(spark, F.datediff(fn.today(), fn.yesterday())) == 1


def test_numbers(spark):
    assert value(spark, fn.to_long(F.lit("12"))) == 12
    assert value(spark, fn.to_long(F.lit("1x"))) is None
    assert value(spark, fn.half_up_ratio(F.lit(57), F.lit(200))) == 0.29
    assert value(spark, fn.half_up_ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, fn.format_double(F.lit(2.345), 1)) == 2.3


def test_registered_names(spark):
    register_functions(spark)
    row = spark.sql(
        """SELECT concat_long_string(1, 'x', ':') a, json_field('{"s": 0}', 's') b,
                  remove_random_prefix(random_prefix('v_w', 10, 3)) c,
                  group_concat_distinct(x) d FROM VALUES ('b'), ('a'), ('b') t(x)
           GROUP BY ALL"""
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("1:x", "0", "v_w", "a,b")


def test_params(spark):
    text = """{"startDate": ["2024-01-03"], "endDate": ["2024-01-04"], "startAge": ["10"], "endAge": ["50"],
               "professionals": ["p1,p2"], "sex": ["male"], "keywords": [], "cities": [""],
               "categoryIds": ["1,2"], "targetPageFlow": ["1,2,3"]}"""
    tasks = spark.createDataFrame([(7, *[None] * 6, text), (8, *[None] * 6, "{}")], TASK)
    assert load_task_params(tasks, 7) == TaskParams(
        date(2024, 1, 3), date(2024, 1, 4), 10, 50, ("p1", "p2"), None, "male", None, ("1", "2"), (1, 2, 3)
    )
    assert load_task_params(tasks, 8) == TaskParams()
    with pytest.raises(LookupError):
        load_task_params(tasks, 9)
    row = task_param_fields(tasks.where("task_id = 7")).first().asDict()
    assert set(row) == {"task_id", *PARAM_FIELDS}
    assert (row["professionals"], row["keywords"], row["cities"]) == ("p1,p2", None, None)


def test_milliseconds_beyond_a_timestamp_are_null(spark):
    most = (2**63 - 1) // 1000
    rows = [(str(most),), (str(-most),), (str(most + 1),), (str(-most - 1),), (str(2**63 - 1),), ("x",), (None,)]
    got = spark.createDataFrame(rows, "v string").select(fn.timestamp_of_epoch_millis("v").isNotNull().alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, False, False]
