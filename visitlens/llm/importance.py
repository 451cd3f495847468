"""Draws documents whose n-grams are like those of a target, by hashed importance weights.

The texts of a batch are joined with a separator between them and one regular expression finds the words of all;
the documents' offsets, searched for each word's place, tell which neighbouring words belong to one document, so
bigrams across documents are masked before the buckets are counted. The buckets of a document are written once:
the corpus counts and the scores both come from them. What the driver holds is one count per bucket.

Which documents are drawn is a matter of rank: the scores are dealt into ranges, sorted there, and the sizes of the
ranges before give every row its place, so no task sees all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.llm.common import columns_of, saved, small_batches

#: Buckets that features are hashed into.
BUCKETS = 10_000
#: Documents with fewer words are never drawn; of the others so many percent are.
LEAST_WORDS, PERCENT = 20, 25
#: Part of what a document's noise is hashed from.
SEED = 7
#: Stands between two texts; no word holds it.
SENTINEL = b"\x00"
#: Bytes of text that are joined at a time; a longer text stands alone.
JOINED_BYTES = 1 << 22
#: Words of ASCII digits and letters and of everything beyond ASCII, over lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_HASHED = "n_words bigint, n_features bigint, buckets binary"


def hashed_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of some texts, the text each belongs to, and the words of each text."""
    blob = SENTINEL.join(texts).lower()
    offsets = np.fromiter(accumulate((len(t) + 1 for t in texts[:-1]), initial=0), np.int64, len(texts))
    starts, words = [], []
    for found in WORD.finditer(blob):
        starts.append(found.start())
        words.append(found[0])
    owner = np.searchsorted(offsets, np.array(starts, np.int64), "right") - 1
    single = [crc32(w) for w in words]
    # The checksum of "a b" goes on from that of "a".
    pair = [crc32(w, crc32(b" ", c)) for c, w in zip(single, words[1:], strict=False)]
    inside = owner[:-1] == owner[1:]
    sums = np.concatenate([np.array(single, np.int64), np.array(pair, np.int64)[inside]])
    owners = np.concatenate([owner, owner[:-1][inside]])
    return (sums % BUCKETS).astype(np.uint16), owners, np.bincount(owner, minlength=len(texts))


def _portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    portion, held = [], 0
    for text in texts:
        if portion and held + len(text) > JOINED_BYTES:
            yield portion
            portion, held = [], 0
        portion.append(text)
        held += len(text) + 1
    if portion:
        yield portion


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        n_words, buckets = [], []
        for portion in _portions(texts):
            found, owners, words = hashed_features(portion)
            found = found[np.argsort(owners, kind="stable")]
            ends = np.cumsum(np.bincount(owners, minlength=len(portion)))
            buckets += [part.tobytes() for part in np.split(found, ends[:-1])]
            n_words += words.tolist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array([len(b) // 2 for b in buckets], pa.int64()),
                pa.array(buckets, pa.binary()),
            ],
            ["doc_id", "n_words", "n_features", "buckets"],
        )


def _joined(column: pa.Array) -> np.ndarray:
    """The buckets of a batch of rows, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        counts += np.bincount(_joined(batch.column("buckets")), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])


def features(texts: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """doc_id, n_words, n_features and buckets (unsigned 16-bit, little-endian) of every row, written once."""
    small_batches(texts.sparkSession)
    own = columns_of(texts, doc_id=id_col, text=text_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    return saved(own.mapInArrow(_with_features, f"doc_id {kind}, {_HASHED}"), label)


def bucket_counts(hashed: DataFrame) -> np.ndarray:
    """Features per bucket over all rows."""
    part = hashed.select("buckets").mapInArrow(_tally, "bucket bigint, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for row in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: the log ratio of target to corpus share, in thousandths, rounded down."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratios = ((t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def _weighted(table: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            reached = np.concatenate([[0], np.cumsum(table[_joined(batch.column("buckets"))])])
            ends = np.cumsum(n)
            sums = reached[ends] - reached[ends - n]
            weight = np.where(n > 0, np.floor_divide(sums, np.maximum(n, 1)), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return weigh


def noise(ident: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the seed and the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32))))).cast("bigint")


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ...) with ``rank`` for the drawn rows, null for the others.

    ``scored`` has to give the same rows each time it is read.
    """
    spark = scored.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    fit = scored.withColumn("row", F.monotonically_increasing_id()).where(F.col("n_words") >= least_words)
    dealt = fit.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = saved(dealt.withColumn("at", F.monotonically_increasing_id()), "importance-ranks")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per range
    before = dict(zip([r["part"] for r in sizes], accumulate((r["n"] for r in sizes), initial=0), strict=False))
    drawn = sum(r["n"] for r in sizes) * percent // 100
    starts = spark.createDataFrame(list(before.items()), "part bigint, before bigint")
    rank = F.col("before") + place + 1
    numbered = placed.withColumn("part", part).join(F.broadcast(starts), "part", "left")
    numbered = numbered.withColumn("rank", F.when(rank <= drawn, rank)).drop("row", "at", "part", "before")
    unfit = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return numbered.unionByName(unfit)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; a rank says that it is drawn.

    Words are lower-cased in A-Z only. A null or empty text has no features, weight 0, and is never drawn; an empty
    target gives every feature the gain of a bucket without target features. Equal scores go by id (null last), and
    repeated rows are ranked one after the other; a null id counts as the empty text in the noise. An empty table
    gives no rows. Other columns of ``docs`` are not touched, whatever their names.
    """
    corpus = features(docs, id_col, text_col, "importance-corpus")
    like = features(target.withColumn("_none", F.lit(0)), "_none", target_text_col, "importance-target")
    table = gains(bucket_counts(corpus), bucket_counts(like))
    kind = corpus.schema["doc_id"].dataType.simpleString()
    weighed = corpus.mapInArrow(_weighted(table), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    scored = saved(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    return ranked(scored, least_words, percent)


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns; a drawn id that is repeated brings all its rows."""
    chosen = resample(docs, target, id_col, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(chosen.distinct(), docs[f"`{id_col}`"].eqNullSafe(F.col("_drawn")), "left_semi")
