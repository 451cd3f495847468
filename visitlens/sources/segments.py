"""A log in segment files as a source with offsets: batch or stream, with the columns of the Kafka source.

A topic is a folder with ``partition=<p>/segment=<first>-<next>``; a segment holds the lines with the offsets from
``first`` to before ``next`` of its partition and never changes. The newest offset is known from the names alone; a
task reads one segment, or the part of it that is asked for. Offsets are kept in the query's checkpoint, so a query
that starts again goes on where it was, and a task that runs again reads the same lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from visitlens.operators.numbering import numbered_rows

FORMAT = "log_segments"
# Columns of the Kafka source.
COLUMNS = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
)
#: Lines of one segment.
SEGMENT_LINES = 100_000
#: Lines handed over at a time.
BATCH_LINES = 10_000


@dataclass(frozen=True)
class Segment:
    """Lines ``first`` to before ``next`` of a partition, in the folder ``path``."""

    partition: int
    first: int
    next: int
    path: str


@dataclass
class Stretch(InputPartition):
    """The lines of a segment that one task reads."""

    segment: Segment
    begin: int
    end: int

    def __init__(self, segment: Segment, begin: int, end: int) -> None:
        super().__init__((segment, begin, end))
        self.segment, self.begin, self.end = segment, begin, end


def _names(files: FileSystem, path: str) -> list[tuple[str, str]]:
    """Names and paths of the folders in a folder; none if it does not exist."""
    found = files.get_file_info(FileSelector(path, allow_not_found=True))
    return [(f.base_name, f.path) for f in found if f.type == FileType.Directory]


class Log:
    """The segments of one topic. A folder that only this process's file systems can name is enough to list them."""

    def __init__(self, options) -> None:
        for name in ("path", "topic"):
            if not options.get(name):
                raise ValueError(f"{FORMAT} needs the option {name}")
        self.topic = options["topic"]
        self.uri = f"{options['path'].rstrip('/')}/{self.topic}"
        self.starting = options.get("startingoffsets", options.get("startingOffsets", "earliest"))

    def segments(self) -> dict[int, list[Segment]]:
        """Per partition the segments in order, as far as they follow each other: what lies behind a gap is still
        being written."""
        files, base = FileSystem.from_uri(self.uri)
        found: dict[int, list[Segment]] = {}
        for name, path in _names(files, base):
            if name.startswith("partition="):
                number, chain = int(name.split("=")[1]), []
                for segment, folder in _names(files, path):
                    if segment.startswith("segment="):
                        first, following = segment.split("=")[1].split("-")
                        chain.append(Segment(number, int(first), int(following), folder))
                chain.sort(key=lambda s: s.first)
                whole = [s for i, s in enumerate(chain) if not i or chain[i - 1].next == s.first]
                gap = next((i for i, s in enumerate(chain) if i and chain[i - 1].next != s.first), len(chain))
                found[number] = whole[:gap]
        return found

    def earliest(self) -> dict[str, int]:
        return {str(p): chain[0].first for p, chain in self.segments().items() if chain}

    def latest(self) -> dict[str, int]:
        return {str(p): chain[-1].next for p, chain in self.segments().items() if chain}

    def stretches(self, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
        found = []
        for partition, chain in sorted(self.segments().items()):
            begin = start.get(str(partition), chain[0].first if chain else 0)
            until = end.get(str(partition), 0)
            if begin < until and (not chain or chain[0].first > begin or chain[-1].next < until):
                raise ValueError(f"{self.topic}, partition {partition}: offsets {begin} to {until} are not there any more")
            for s in chain:
                if s.first < until and s.next > begin:
                    found.append(Stretch(s, max(begin, s.first), min(until, s.next)))
        return found

    def read(self, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        """The lines of a stretch; a segment that does not hold as many lines as its name says is an error."""
        files, _ = FileSystem.from_uri(self.uri)
        segment = stretch.segment
        inside = files.get_file_info(FileSelector(segment.path))
        parts = [f for f in inside if f.type == FileType.File and not f.base_name.startswith(("_", "."))]
        if len(parts) != 1:
            raise OSError(f"{segment.path} holds {len(parts)} files instead of one")
        with files.open_input_stream(parts[0].path) as stream:
            lines = stream.read().split(b"\n")
        if lines[-1] == b"":
            lines.pop()
        if len(lines) != segment.next - segment.first:
            raise OSError(f"{segment.path} holds {len(lines)} lines")
        lines = lines[stretch.begin - segment.first : stretch.end - segment.first]
        for at in range(0, len(lines), BATCH_LINES):
            values = lines[at : at + BATCH_LINES]
            n = len(values)
            first = stretch.begin + at
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, pa.binary()),
                    pa.array(values, pa.binary()),
                    pa.array([self.topic] * n),
                    pa.array([segment.partition] * n, pa.int32()),
                    pa.array(range(first, first + n), pa.int64()),
                    pa.array([parts[0].mtime] * n, pa.timestamp("us", "UTC")),
                    pa.array([0] * n, pa.int32()),
                ],
                [c.split()[0] for c in COLUMNS.split(", ")],
            )


class SegmentReader(DataSourceReader):
    """All lines there are when the query is planned."""

    def __init__(self, log: Log) -> None:
        self.log = log

    def partitions(self) -> Sequence[InputPartition]:
        return self.log.stretches(self.log.earliest(), self.log.latest()) or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Stretch):
            yield from self.log.read(partition)


class SegmentStreamReader(DataSourceStreamReader):
    """Lines from the checkpoint's offset to the newest one; at first from ``startingOffsets``: ``earliest``,
    ``latest`` or a JSON object of offsets by partition."""

    def __init__(self, log: Log) -> None:
        self.log = log

    def initialOffset(self) -> dict:
        if self.log.starting == "earliest":
            return self.log.earliest()
        if self.log.starting == "latest":
            return self.log.latest()
        return {str(p): int(n) for p, n in json.loads(self.log.starting).items()}

    def latestOffset(self) -> dict:
        return self.log.latest()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.log.stretches(start, end)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.log.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: segments stay until whoever owns the log removes them."""


class LogSegments(DataSource):
    """``spark.read`` or ``spark.readStream`` of format ``log_segments`` with the options ``path`` and ``topic``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(Log(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SegmentStreamReader(Log(self.options))


def _as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("string") for c in ("key", "value")})


def read_segments(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """The whole log of a topic as it is now; key and value as text."""
    spark.dataSource.register(LogSegments)
    return _as_text(spark.read.format(FORMAT).options(path=path, topic=topic).load())


def stream_segments(spark: SparkSession, path: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A stream over the log of a topic; key and value as text, as ``read_kafka_log`` gives them."""
    spark.dataSource.register(LogSegments)
    reader = spark.readStream.format(FORMAT).options(path=path, topic=topic, startingOffsets=starting)
    return _as_text(reader.load())


def append_segments(
    lines: DataFrame, path: str, topic: str, order: Sequence[Column | str], segment_lines: int = SEGMENT_LINES
) -> None:
    """Append (partition int, value string) rows to a topic, in the given order within each partition.

    Lines get the offsets that follow the partition's last one and are cut into segments, one file each. One
    writer at a time. A value must not hold a line end.
    """
    spark = lines.sparkSession
    known = Log({"path": path, "topic": topic}).latest()
    begins = spark.createDataFrame([(int(p), n) for p, n in known.items()], "partition int, begin bigint")
    numbered = numbered_rows(lines.withColumn("partition", F.col("partition").cast("int")), ["partition"], order)
    sizes = numbered.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))
    placed = numbered.join(sizes.join(begins, "partition", "left"), "partition")
    begin = F.coalesce("begin", F.lit(0))
    first = F.floor(F.col("number") / segment_lines) * segment_lines
    until = F.least(first + segment_lines, F.col("rows"))
    cut = placed.select("partition", F.concat_ws("-", begin + first, begin + until).alias("segment"), "number", "value")
    files = cut.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "number").drop("number")
    files.write.mode("append").partitionBy("partition", "segment").option("compression", "none").text(f"{path}/{topic}")
