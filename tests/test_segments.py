"""The log with offsets: numbering, segments, reading again, starting again."""

import os
import shutil

import pytest
from frames import ad_clicks, at
from pyspark.sql import functions as F

from visitlens.operators import numbered_rows
from visitlens.settings import scratch_dir
from visitlens.sinks import read_result
from visitlens.sources import append_segments, parse_ad_log, read_segments, segments, stream_segments, views
from visitlens.streaming import ads as S


def lines(spark, rows):
    return spark.createDataFrame(rows, "partition int, value string")


def append(spark, path, rows, size=3):
    append_segments(lines(spark, rows), path, "t", ["value"], size)


def held(frame):
    return sorted((r["partition"], r["offset"], r["value"]) for r in frame.collect())


def numbered(first, values, partition=0):
    return [(partition, first + i, v) for i, v in enumerate(values)]


def test_offsets_follow_each_other_over_appends(spark):
    path = scratch_dir(spark, "log")
    append(spark, path, [(0, f"a{i}") for i in range(7)] + [(1, "x")])
    append(spark, path, [(0, f"b{i}") for i in range(2)] + [(2, "y"), (1, "z é 𝄞")])
    want = numbered(0, [*(f"a{i}" for i in range(7)), "b0", "b1"]) + [(1, 0, "x"), (1, 1, "z é 𝄞"), (2, 0, "y")]
    log = read_segments(spark, path, "t")
    assert held(log) == sorted(want)
    assert log.columns == ["key", "value", "topic", "partition", "offset", "timestamp", "timestampType"]
    assert {r["topic"] for r in log.collect()} == {"t"}
    folders = sorted(f for f in os.listdir(f"{path}/t/partition=0") if f.startswith("segment"))
    assert folders == ["segment=0-3", "segment=3-6", "segment=6-7", "segment=7-9"]


def test_an_empty_topic(spark):
    path = scratch_dir(spark, "log")
    assert read_segments(spark, path, "nothing").count() == 0
    append(spark, path, [])
    assert read_segments(spark, path, "t").count() == 0
    with pytest.raises(Exception, match="topic"):
        spark.read.format(segments.FORMAT).option("path", path).load().count()


def test_a_stream_goes_on_at_its_offsets(spark):
    """Between runs nothing is read twice and nothing is left out, and partitions may come later."""
    path, root = scratch_dir(spark, "log"), scratch_dir(spark, "root")
    seen = []

    def run():
        handle = lambda df, i: seen.append((i, held(df)))
        S.start(stream_segments(spark, path, "t"), handle, f"{root}/c", "append", once=True).awaitTermination()

    append(spark, path, [(0, f"a{i}") for i in range(5)])
    run()
    append(spark, path, [(0, "b"), (1, "c")])
    run()
    run()
    append(spark, path, [(1, "d")])
    run()
    assert [rows for _, rows in seen if rows] == [numbered(0, [f"a{i}" for i in range(5)]), [(0, 5, "b"), (1, 0, "c")], [(1, 1, "d")]]


def test_starting_offsets(spark):
    path = scratch_dir(spark, "log")
    append(spark, path, [(0, f"a{i}") for i in range(8)])
    log = segments.Log({"path": path, "topic": "t", "startingoffsets": '{"0": 4}'})
    reader = segments.SegmentStreamReader(log)
    stretches = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [(s.begin, s.end) for s in stretches] == [(4, 6), (6, 8)]
    values = [v.as_py() for s in stretches for b in reader.read(s) for v in b.column("value")]
    assert values == [b"a4", b"a5", b"a6", b"a7"]
    log.starting = "latest"
    assert reader.initialOffset() == {"0": 8} == reader.latestOffset()


def test_a_lost_partition_is_read_again(spark):
    """A task that dies on its first attempt gives the same rows on its second; so does every later read."""
    path = scratch_dir(spark, "log")
    append(spark, path, [(0, f"a{i}") for i in range(9)])
    log = segments.Log({"path": path, "topic": "t"})
    reader = segments.SegmentStreamReader(log)
    [first, *_] = reader.partitions({"0": 1}, {"0": 8})
    half = iter(reader.read(first))
    next(half)
    del half  # lost half-way
    again = [b.to_pydict() for b in reader.read(first)]
    assert again == [b.to_pydict() for b in reader.read(first)]
    assert [o for b in again for o in b["offset"]] == [1, 2]


def test_what_lies_behind_a_gap_waits(spark):
    path = scratch_dir(spark, "log")
    append(spark, path, [(0, f"a{i}") for i in range(9)])
    middle = f"{path}/t/partition=0/segment=3-6"
    shutil.move(middle, f"{path}/away")
    log = segments.Log({"path": path, "topic": "t"})
    assert log.latest() == {"0": 3}
    assert [v for _, _, v in held(read_segments(spark, path, "t"))] == ["a0", "a1", "a2"]
    with pytest.raises(ValueError, match="not there any more"):
        log.stretches({"0": 0}, {"0": 9})
    shutil.move(f"{path}/away", middle)
    assert log.latest() == {"0": 9}


def test_a_damaged_segment_is_an_error(spark):
    path = scratch_dir(spark, "log")
    append(spark, path, [(0, f"a{i}") for i in range(3)])
    folder = f"{path}/t/partition=0/segment=0-3"
    [file] = [f for f in os.listdir(folder) if f.endswith(".txt")]
    with open(f"{folder}/{file}", "w") as out:
        out.write("a0\na1\n")
    log = segments.Log({"path": path, "topic": "t"})
    with pytest.raises(OSError, match="holds 2 lines"):
        list(log.read(log.stretches({"0": 0}, {"0": 3})[0]))


def test_the_click_job_runs_on_the_log(spark):
    path, root = scratch_dir(spark, "log"), scratch_dir(spark, "root")
    for part in range(2):
        clicks = ad_clicks(spark, [(at(i + part), "p", "c", i, i % 3) for i in range(30)])
        log = views.ad_log(clicks.withColumn("partition", (F.col("user_id") % 2).cast("int")), "partition")
        append_segments(log, path, "clicks", ["value"], 4)
        stream = parse_ad_log(stream_segments(spark, path, "clicks"))
        S.start_ad_stat(stream, root, f"{root}/c", once=True).awaitTermination()
    counts = {r["ad_id"]: r["click_count"] for r in read_result(spark, "ad_stat", root).collect()}
    assert counts == {0: 20, 1: 20, 2: 20}


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_numbers_have_no_gaps(spark, parts):
    """A key with most rows, equal rows, a null key, more ranges than rows."""
    rows = [("hot", i % 50) for i in range(300)] + [("b", 1), ("b", 1), (None, 3), (None, 2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows, "k string, v int").repartition(5)
        got = [tuple(r) for r in numbered_rows(frame, ["k"], [F.desc("v")]).collect()]
        assert numbered_rows(frame.limit(0), ["k"], ["v"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for key in ("hot", "b", None):
        own = sorted((n, v) for k, v, n in got if k == key)
        assert [n for n, _ in own] == list(range(len(own)))
        assert [v for _, v in own] == sorted((v for k, v in rows if k == key), reverse=True)
