"""WARC records, and a Merkle audit that compares replicas of them.

Records of a file are hashed in the order of their offsets. Neighbours make a node, which covers their range of
offsets and whose hash is that of its children's hashes and of the range's length, up to one root per file. Where a
node begins is decided by the records themselves: at those whose hashed id ends in as many zeros as the level asks for,
one in FANOUT of the level below. So a record that is missing or too many changes the node it belongs to and those
above, and all others keep their hashes, though all later offsets move.

Two replicas are compared from the roots: only below nodes whose hashes differ are the children looked at, so what is
read of a sound file is its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.llm.common import columns_of, saved

#: Children of a node on average, and records of a file.
FANOUT, FILE_RECORDS = 16, 4096
_DATE = "2024-01-01T00:00:00Z"
_LEVELS = 16

# Records


def _record(uri: Column, payload: Column, record_id: Column) -> Column:
    """One response record, header and block, as text."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:"),
        record_id,
        F.lit(">\r\nWARC-Date: " + _DATE + "\r\nWARC-Target-URI: "),
        uri,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(http).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, http, F.lit("\r\n\r\n"))


def warc_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS
) -> DataFrame:
    """page_id, file_id, offset, length, record (text) of every page.

    Null urls and pages count as empty. A file holds the pages of one stretch of ids, in their order (null ids
    make a file of their own per hash of the page); repeated rows follow each other. An empty table gives no rows.
    """
    own = columns_of(pages, page_id=id_col, url=url_col, html=html_col)
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    name = F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    stretch = F.floor(F.col("page_id") / file_records).cast("string")
    file_id = F.coalesce(stretch, F.concat(F.lit("none-"), F.pmod(F.xxhash64(url, html), F.lit(1024)).cast("string")))
    record = _record(url, html, name)
    return with_offsets(own.select("page_id", file_id.alias("file_id"), record.alias("record")))


def with_offsets(records: DataFrame) -> DataFrame:
    """Length and offset of each record (page_id, file_id, record) in its file."""
    sized = records.withColumn("length", F.octet_length("record").cast("bigint"))
    sized = sized.withColumn("sha", F.sha2(F.col("record").cast("binary"), 256))
    before = Window.partitionBy("file_id").orderBy("page_id", "sha").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("page_id", "file_id", "offset", "length", "sha", "record")


# Trees


def _begins(key: Column, level: int) -> Column:
    """Whether a node of a level begins with this record."""
    return F.pmod(F.xxhash64(key), F.lit(FANOUT**level)) == 0


def _placed(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of a level with ``up``, the record their parent begins with; the first of a file has none (empty)."""
    so_far = Window.partitionBy("file_id").orderBy("low", "key").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when((F.col("key") != "") & _begins(F.col("key"), level + 1), F.col("key")), ignorenulls=True)
    return nodes.withColumn("up", F.coalesce(begin.over(so_far), F.lit("")))


def leaves(records: DataFrame) -> DataFrame:
    """Level 0 of the trees: file_id, key, low, high (offsets), hash, up of each record.

    The key is the record's id and which of the records of that id it is.
    """
    time = F.row_number().over(Window.partitionBy("file_id", "page_id").orderBy("offset", "sha"))
    key = F.concat_ws("#", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), time)
    own = records.select(
        "file_id", key.alias("key"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"),
        F.col("sha").alias("hash"),
    )
    return _placed(own, 0)


def parents(nodes: DataFrame, level: int) -> DataFrame:
    """The level above, ``level``: children hashed in the order of their offsets."""
    kids = F.array_sort(F.collect_list(F.struct("low", "key", "hash")))
    grouped = nodes.groupBy("file_id", F.col("up").alias("key")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), kids.alias("kids")
    )
    told = F.concat_ws(":", F.col("high") - F.col("low"), F.array_join(F.transform("kids", lambda k: k["hash"]), ""))
    return _placed(grouped.select("file_id", "key", "low", "high", F.sha2(told, 256).alias("hash")), level)


def trees(records: DataFrame) -> list[DataFrame]:
    """All levels, leaves first; the last has one root per file, whose key is empty."""
    levels = [saved(leaves(records), "tree")]
    while len(levels) == 1 or levels[-1].where("key <> ''").limit(1).count():
        if len(levels) > _LEVELS:
            raise RuntimeError("a file has more records than a tree of this height holds")
        levels.append(saved(parents(levels[-1], len(levels)), "tree"))
    return levels


def _grown(levels: list[DataFrame], height: int) -> list[DataFrame]:
    while len(levels) < height:
        levels.append(saved(parents(levels[-1], len(levels)), "tree"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file_id, key, low, high, fault of every record at which the replicas differ: changed, missing, extra.

    ``ours`` and ``theirs`` are records with offsets. From the roots down, only children of nodes that differ
    are joined. Files that one side lacks differ as a whole. Records that only changed places change the nodes above
    them, but are no faults themselves.
    """
    left, right = trees(ours), trees(theirs)
    height = max(len(left), len(right))
    open_ = None
    for mine, other in zip(reversed(_grown(left, height)), reversed(_grown(right, height)), strict=True):
        if open_ is not None:
            mine, other = (
                side.join(open_.where(there).select("file_id", "up"), ["file_id", "up"], "left_semi")
                for side, there in ((mine, "fault <> 'extra'"), (other, "fault <> 'missing'"))
            )
        both = mine.alias("m").join(other.alias("o"), ["file_id", "key"], "full")
        differ = both.where(F.expr("not (m.hash <=> o.hash)")).select(
            "file_id",
            "key",
            F.coalesce("m.low", "o.low").alias("low"),
            F.coalesce("m.high", "o.high").alias("high"),
            F.expr("case when o.hash is null then 'missing' when m.hash is null then 'extra' else 'changed' end").alias("fault"),
        )
        differ = saved(differ, "differ")
        open_ = differ.select("file_id", F.col("key").alias("up"), "fault")
    return differ


def audit_pages(pages: DataFrame, damaged: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, file_id, offset, length, sha256, fault ('sound' if none) of every record of ``pages`` against the
    replica made of ``damaged``.

    Records are matched by their ids, repeated ones in the order of their offsets and hashes; null ids by what the page
    holds. Records that only ``damaged`` has are not in the result (``audit`` reports them as extra). Without rows in
    ``damaged`` all are missing; no rows give no rows.
    """
    ours = saved(warc_records(pages, id_col).drop("record"), "records")
    theirs = saved(warc_records(damaged, id_col).drop("record"), "records")
    faults = audit(ours, theirs).where("fault <> 'extra'").select("file_id", "low", "fault")
    joined = ours.join(faults, (ours["file_id"] == faults["file_id"]) & (ours["offset"] == faults["low"]), "left")
    return joined.select(
        "page_id", ours["file_id"], "offset", "length", F.col("sha").alias("sha256"), F.coalesce("fault", F.lit("sound")).alias("fault")
    )
