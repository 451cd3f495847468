"""Rows sent to a store in bounded batches, one connection per task, committed per task attempt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of one batch.
BATCH_ROWS = 1_000


@dataclass
class Sent(WriterCommitMessage):
    """What one task attempt has committed."""

    partition: int
    rows: int
    batches: int


class BatchWriter(DataSourceArrowWriter):
    """Sends the rows of a task with ``executemany`` and commits once all are sent. An attempt that fails is rolled
    back and runs again as a whole; an attempt that was lost after its commit is sent twice, so the statement has to
    put rows by their key."""

    def __init__(self, connect: Callable[[], Any], statement: str, batch_rows: int, done: Callable[[list[Sent]], None] | None) -> None:
        self.connect, self.statement, self.batch_rows, self.done = connect, statement, batch_rows, done

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        sent, batches, connection = 0, 0, None
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, self.batch_rows):
                    part = batch.slice(at, self.batch_rows)
                    rows = list(zip(*[column.to_pylist() for column in part.columns], strict=True))
                    connection = connection or self.connect()
                    connection.cursor().executemany(self.statement, rows)
                    sent, batches = sent + len(rows), batches + 1
            if connection is not None:
                connection.commit()
        except BaseException:
            if connection is not None:
                connection.rollback()
            raise
        finally:
            if connection is not None:
                connection.close()
        return Sent(TaskContext.get().partitionId(), sent, batches)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.done is not None:
            self.done([m for m in messages if isinstance(m, Sent)])


def write_batches(
    df: DataFrame,
    connect: Callable[[], Any],
    statement: str,
    batch_rows: int = BATCH_ROWS,
    done: Callable[[list[Sent]], None] | None = None,
) -> None:
    """Send all rows of ``df`` through connections of the Python database interface.

    ``connect`` is called once in each task that has rows and gives an object with ``cursor().executemany``,
    ``commit``, ``rollback`` and ``close``; it travels to the executors, so it has to be picklable. ``statement`` takes the
    columns of ``df`` in order. A batch holds ``batch_rows`` rows at most. ``done`` is called on the driver, in a process
    of its own, with what every task has committed.
    """

    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return "row_batches"

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return BatchWriter(connect, statement, batch_rows, done)

    df.sparkSession.dataSource.register(Batches)
    df.write.format("row_batches").mode("append").save()
