import os
import random

import pytest
from frames import actions, at
from pyspark.sql import functions as F

from visitlens.operators import (
    hot_keys,
    observed_count,
    salted_group_count,
    salted_join,
    skew_join,
    top_per_group,
    without_keys,
)
from visitlens.settings import scratch_dir
from visitlens.sources import actions_in_range, clicks_in_range, jdbc_options
from visitlens.sources.adlog import kafka_options, parse_ad_log, rejected_ad_log


def skewed(spark, n=6000):
    """A third of the rows have key 0, many of them equal; one key is null."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, None).otherwise(F.col("id") % 500)
    return spark.range(n).select(key.cast("bigint").alias("k"), (F.col("id") % 7).alias("v")).repartition(6)


@pytest.mark.parametrize("join", [skew_join, salted_join])
@pytest.mark.parametrize("how", ["inner", "left_outer", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_join(spark, join, how):
    left = skewed(spark)
    right = spark.range(0, 400, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    right = right.unionByName(right.limit(3))
    got, want = join(left, right, ["k"], how), left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("how", ["inner", "left_outer", "left_semi", "left_anti"])
def test_the_repeated_side_is_not_broadcast(spark, how):
    """Spark takes the side for as small as before its rows were repeated."""
    joined = salted_join(skewed(spark), spark.range(0, 400, 2).toDF("k"), ["k"], how)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_hot_keys_are_few_and_right(spark):
    found = hot_keys(skewed(spark), ["k"], parts=100).collect()
    # Key 0 owns a third: 34 salts bring it to a hundredth; no other key owns more than that.
    assert [r["__salts"] for r in found] == [34]


def test_hot_key_is_spread(spark):
    left = skewed(spark)
    spread = F.pmod(F.xxhash64("k", "v", F.spark_partition_id()), F.lit(34))
    assert left.where("k = 0").select(spread.alias("s")).distinct().count() > 15


@pytest.mark.parametrize("kinds", [("int", "bigint"), ("bigint", "int"), ("decimal(12,2)", "decimal(20,4)"), ("double", "int")])
@pytest.mark.parametrize("how", ["inner", "left_outer", "left_semi", "left_anti"])
def test_skew_join_of_different_number_types(spark, kinds, how):
    key = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 500)
    left = spark.range(4000).select(key.cast(kinds[0]).alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    right = spark.range(0, 400, 2).select(F.col("id").cast(kinds[1]).alias("k"), F.col("id").alias("w"))
    got, want = skew_join(left, right, ["k"], how, parts=50), left.join(right, ["k"], how)
    assert got.schema == want.schema
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_skew_join_of_dates_and_timestamps(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    left = spark.range(900).select(day.alias("k"), "id")
    right = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS k, 1 AS w")
    got, want = skew_join(left, right, ["k"], parts=10), left.join(right, ["k"])
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 300


def test_skew_join_refuses_text_against_numbers(spark):
    with pytest.raises(TypeError, match="k is bigint"):
        skew_join(spark.range(3).toDF("k"), spark.createDataFrame([("1",)], "k string"), ["k"])


def test_skew_join_without_exchange_reuse_and_beyond_the_sketch(spark):
    """Both sides see the salts of one sketch, even where more keys are hot than it holds exactly."""
    left = spark.range(20000).select((F.col("id") % 41).alias("k"), "id")
    right = spark.range(41).toDF("k")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = skew_join(left, right, ["k"], parts=45)
        assert got.count() == 20000 and got.select("id").distinct().count() == 20000
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_without_keys_whatever_the_size_and_type(spark):
    left = skewed(spark)
    keys = spark.range(0, 300).select(F.col("id").cast("int").alias("k"))
    want = left.join(keys, ["k"], "left_anti")
    for bound in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        try:
            got = without_keys(left, keys.union(keys), ["k"])
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    for master in ("yarn", "local-cluster[2,1,512]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_dir(Session(spark_master=master), "x")
    assert os.path.isdir(os.path.dirname(scratch_dir(Session(spark_master="local[2]"), "x")))
    shared = Conf({"spark.checkpoint.dir": "hdfs:///tmp/"})
    session = Session(spark_master="yarn")
    session.conf = shared
    assert scratch_dir(session, "x").startswith("hdfs:///tmp/x-")


def test_salted_group_count(spark):
    frame = skewed(spark)
    got = salted_group_count(frame, ["k"], 8, ["v"])
    want = frame.groupBy("k").count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_top_per_group(spark, n):
    rows = [(random.Random(i).randrange(3), random.Random(-i).randrange(40), i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "g int, v int, u int")
    found = top_per_group(frame, ["g"], [F.desc("v"), F.asc("u")], n, unique="u")
    want = []
    for g in range(3):
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want += [(*r, i) for i, r in enumerate(members[:n], 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_small_top_is_cut_before_the_shuffle(spark, capsys):
    frame = skewed(spark)
    top_per_group(frame, ["k"], [F.desc("v")], 3).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") >= 2


def test_observed_count(spark):
    frame, seen = observed_count(skewed(spark), "rows seen")
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 6000


def test_dates_and_columns_reach_the_scan(spark, capsys):
    from datetime import date

    from visitlens.params import TaskParams

    path = scratch_dir(spark, "actions")
    rows = [{"session_id": "s", "user_id": 1, "action_time": at(0, d), "city_id": 1, "click_product_id": d}
            for d in range(5)]
    actions(spark, rows).write.partitionBy("date").parquet(path)
    params = TaskParams(start_date=date(2024, 1, 4), end_date=date(2024, 1, 5))
    stored = spark.read.parquet(path)
    assert actions_in_range(stored, params).count() == 2
    clicks = clicks_in_range(stored, params)
    assert sorted(r.product_id for r in clicks.collect()) == [1, 2]
    clicks.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(click_product_id)]" in plan
    assert "ReadSchema: struct<click_product_id:bigint,city_id:bigint>" in plan
    assert "PartitionFilters" in plan


def test_ad_log(spark):
    lines = ["1704272400123 North Xi 5 1", "1704272400123 North Xi five 1", "1704272400123 North Xi 5", "", "x y z 1 2",
             "1704272400124 South Yu 6 2"]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    good = parse_ad_log(frame).orderBy("user_id").collect()
    assert [(r.province, r.city, r.user_id, r.ad_id) for r in good] == [("North", "Xi", 5, 1), ("South", "Yu", 6, 2)]
    assert good[0].ts.timestamp() == 1704272400.123
    assert sorted(r.value for r in rejected_ad_log(frame).collect()) == sorted(lines[1:5])


def test_source_options():
    assert kafka_options("h:1", "a, b")["subscribe"] == "a,b"
    options = jdbc_options("jdbc:x", "city_info", "u", "p", ("city_id", 0, 100, 4))
    assert options["dbtable"] == "city_info" and options["numPartitions"] == "4"
    assert "numPartitions" not in jdbc_options("jdbc:x", "city_info", "u", "p")


def test_scratch_is_below_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert os.path.dirname(scratch_dir(spark, "a")) == base.rstrip("/")
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")
