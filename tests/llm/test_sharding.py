import zlib

import numpy as np
import pytest
from llm_frames import PROSE, documents, edge_rows

from visitlens.llm import sharding as S


def check(spark, rows, shards=40):
    got = S.shard_report(documents(spark, rows), shards).collect()
    assert [f for f in got[0].asDict()] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r)
    total, largest = sum(w[1] for w in want), max(w[1] for w in want)
    for shard in range(shards):
        own = held.get(shard, [])
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= largest + 1
    assert {r["law"] for r in got} == {"bytes"} and set(held) <= set(range(shards))


def test_even_bytes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(n), "s") for i, n in enumerate(rng.integers(0, 900, 1500))]
    check(spark, edge_rows() + rows)


def test_a_third_of_all_rows_are_copies(spark):
    check(spark, edge_rows() + [(i, PROSE, "s") for i in range(700)] + [(1000 + i, f"{i} {PROSE}", "s") for i in range(1400)])


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(S, "KEYS", 1)
    monkeypatch.setattr(S, "RANGES", 2)
    check(spark, [(i, PROSE[: i % 90], "s") for i in range(2000)], shards=7)


def test_fewer_rows_than_shards_and_none(spark):
    got = S.shard_report(documents(spark, edge_rows()[:3])).collect()
    assert len(got) == 3 and all(r["slot"] == 0 or r["slot"] < 3 for r in got)
    assert S.shard_report(documents(spark, [])).collect() == []


def test_ranges_follow_the_key_order():
    splitters = S.Splitters([(5, 2), (5, 9), (8, 0)])
    k, row = np.array([1, 5, 5, 5, 5, 6, 8, 9]), np.array([0, 1, 2, 8, 9, 3, 0, 1])
    assert splitters.range_of(k, row).tolist() == [0, 0, 1, 1, 2, 2, 3, 3]


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = edge_rows()
    S.write_shards(documents(spark, rows), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back) == sorted((str(i), str(t)) for i, t, _ in rows)


@pytest.mark.parametrize("wanted", [10, 100])
def test_sample_is_bounded(spark, wanted):
    keys = S.shard_keys(documents(spark, [(i, "x" * (i % 50), "s") for i in range(3000)]))
    total = keys.selectExpr("sum(size)").first()[0]
    assert len(S._sampled(keys, total, wanted)) <= 2 * wanted
