"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key: the hash of their text, so equal texts are neighbours, and then a row number. Keys
are sampled with a probability in proportion to the record's size, so quantiles of the sample are quantiles of
the bytes. They cut the key space into ranges, several for each shard; ranges whose exact bytes turn out too
large are cut again by samples of their own. Within a range, which is small, records are put in order and their
bytes added up, and the sum over all bytes before a record decides its shard: shards are contiguous in the key,
and no shard is more than one record away from its even share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.common import columns_of, saved, small_batches

#: Bytes that a record costs beside its text.
RECORD_BYTES = 16
#: Ranges for each shard, and sampled keys for each range.
RANGES, KEYS = 16, 32
#: A range above so many times its share of the bytes is cut again, in so many passes at most.
OVERFULL, PASSES = 2.0, 4
#: Rows of a written file.
FILE_ROWS = 100_000


class Splitters:
    """Ordered upper bounds (k, row), exclusive; range i holds the keys from bound i - 1 to below bound i."""

    def __init__(self, bounds: list[tuple[int, int]]) -> None:
        bounds = sorted(set(bounds))
        self.k = np.array([b[0] for b in bounds], np.int64)
        self.row = np.array([b[1] for b in bounds], np.int64)

    def merged(self, more: list[tuple[int, int]]) -> Splitters:
        return Splitters([*zip(self.k.tolist(), self.row.tolist(), strict=True), *more])

    def range_of(self, k: np.ndarray, row: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.k, k, "left"), np.searchsorted(self.k, k, "right")
        out = low.copy()
        for i in np.unique(low[low < high]):  # keys equal to a bound's: its row numbers decide
            same = (low == i) & (high > low)
            out[same] = i + np.searchsorted(self.row[i : high[same][0]], row[same], "right")
        return out

    def column(self, k: str, row: str) -> Column:
        @F.pandas_udf("int")
        def find(ks: pd.Series, rows: pd.Series) -> pd.Series:
            return pd.Series(self.range_of(ks.to_numpy(np.int64), rows.to_numpy(np.int64)).astype(np.int32))

        return find(k, row)


def _sampled(keys: DataFrame, total: int, wanted: int) -> list[tuple[int, int, float]]:
    """(k, row, bytes it stands for): about ``wanted`` keys, drawn by a hash with a chance in proportion to size.

    A record as large as the step between draws is always there; the others stand for one step each. The number
    of keys is bounded by twice ``wanted`` whatever the table's size.
    """
    step = max(total / wanted, 1.0)
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(step))
    draw = F.pmod(F.xxhash64(F.lit("draw"), "k", "row"), F.lit(1 << 40)) / float(1 << 40)
    rows = keys.where(draw < chance).select("k", "row", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w"))
    return [tuple(r) for r in rows.collect()]


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """Keys that cut the sample's weight in ``parts`` even pieces."""
    sample.sort()
    reached = np.cumsum([w for _, _, w in sample])
    if not len(reached):
        return []
    goals = reached[-1] * np.arange(1, parts) / parts
    picks = np.unique(np.searchsorted(reached, goals, "left"))
    return [sample[i][:2] for i in picks]


def shard_keys(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, k and row of every document, written once; the text is read only here.

    ``row_col`` names row numbers that ``docs`` already has; without it rows are numbered here.
    """
    numbered = {} if row_col is None else {"row": row_col}
    own = columns_of(docs, doc_id=id_col, text=text_col, **numbered)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = own.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k"),
        (F.monotonically_increasing_id() if row_col is None else F.col("row")).alias("row"),
    )
    return saved(found, "shard-keys")


def assign_shards(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, row, k of every row: all rows, sizes of shards near equal.

    A null text has no bytes and the checksum of none. Null ids and repeated rows are placed like others. With
    fewer rows than shards some shards stay empty; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keys = shard_keys(docs, id_col, text_col, row_col)
    total = keys.agg(F.sum("size")).first()[0] or 0
    share = total / (shards * RANGES)
    splitters = Splitters(_quantiles(_sampled(keys, total, shards * RANGES * KEYS), shards * RANGES))
    for _ in range(PASSES):
        ranged = saved(keys.withColumn("range", splitters.column("k", "row")), "ranges")
        held = ranged.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest")
        )
        ranges = sorted(held.collect())  # about shards * RANGES rows
        overfull = {r["range"]: r["bytes"] for r in ranges if r["rows"] > 1 and r["bytes"] > OVERFULL * share + r["largest"]}
        if not overfull:
            break
        inside = ranged.where(F.col("range").isin(list(overfull)))
        more = _sampled(inside, sum(overfull.values()), len(overfull) * RANGES * KEYS)
        cuts = []
        where = splitters.range_of(np.array([m[0] for m in more], np.int64), np.array([m[1] for m in more], np.int64))
        for number, size in overfull.items():
            own = [m for m, r in zip(more, where, strict=True) if r == number]
            cuts += _quantiles(own, int(-(-size // max(share, 1.0))))
        splitters = splitters.merged(cuts)
    return _placed(ranged, ranges, total, shards)


def _placed(ranged: DataFrame, ranges: list, total: int, shards: int) -> DataFrame:
    spark = ranged.sparkSession
    before, at = [], 0
    for r in ranges:
        before.append((r["range"], at))
        at += r["bytes"]
    bases = F.broadcast(spark.createDataFrame(before, "range int, base bigint"))  # about shards * RANGES rows
    within = Window.partitionBy("range").orderBy("k", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn(
        "place", F.row_number().over(Window.partitionBy("range").orderBy("k", "row")) - 1
    )
    middle = F.col("base") + F.col("inside") + F.col("size") / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(total, 1)))).cast("int"))
    placed = saved(summed.join(bases, "range").withColumn("shard", shard), "placed")
    parts = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    slots, at, last = [], 0, None
    for p in sorted(parts.collect(), key=lambda p: (p["shard"], p["range"])):  # ranges and the cuts through them
        at = at if p["shard"] == last else 0
        slots.append((p["shard"], p["range"], at - p["first"]))
        at, last = at + p["n"], p["shard"]
    starts = F.broadcast(spark.createDataFrame(slots, "shard int, range int, shift bigint"))
    return placed.join(starts, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot"), "row", "k"
    )


def shard_report(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``assign_shards``."""
    return assign_shards(docs, shards, id_col, text_col).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Documents (doc_id, text, slot) written as Parquet, one folder per shard, in the order of the slots.

    The documents are numbered and written once beforehand, so that every row is matched by its own number.
    """
    own = columns_of(docs, doc_id=id_col, text=text_col)
    rows = saved(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
    places = assign_shards(rows, shards, row_col="row").select("row", "shard", "slot")
    out = rows.join(places, "row").select("doc_id", "text", "shard", "slot")
    files = F.floor(F.col("slot") / FILE_ROWS)
    out.repartition("shard", files).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
