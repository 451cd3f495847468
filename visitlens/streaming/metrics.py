"""Counts of a log stream per batch, taken while the batch is handled and told to a listener."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from visitlens.sources.adlog import parsed_log, readable

#: The name under which a stream's counts are observed.
METRICS = "ad_log"


def observed_clicks(log: DataFrame, column: str = "value") -> DataFrame:
    """Clicks of the readable lines of a log, which counts its lines, the readable and the rejected ones on the way:
    no job of its own, no second pass."""
    parsed = parsed_log(log, column)
    counts = (
        F.count(F.lit(1)).alias("rows"),
        F.count_if(readable()).alias("accepted"),
        F.count_if(~readable()).alias("rejected"),
    )
    return parsed.observe(METRICS, *counts).where(readable()).select("click.*")


class BatchCounts(StreamingQueryListener):
    """Keeps the counts of every batch of the queries it hears of: (query id, batch, rows, accepted, rejected).

    A batch that is handled again replaces its counts.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._counts: dict[tuple[str, int], tuple[int, int, int]] = {}
        self._ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(METRICS)
        if row is not None and row["rows"]:
            with self._lock:
                self._counts[str(progress.id), progress.batchId] = row["rows"], row["accepted"], row["rejected"]

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))

    def counts(self) -> list[tuple[str, int, int, int, int]]:
        with self._lock:
            return sorted((*key, *value) for key, value in self._counts.items())

    def wait_for(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Wait until all that an ended query had to tell is here: listeners are told later than the query ends."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self._ended:
            if time.monotonic() > until:
                raise TimeoutError(f"no word of the end of {query.runId}")
            time.sleep(0.02)


def counted_batches(spark: SparkSession, listener: BatchCounts) -> DataFrame:
    """The counts so far as a frame: query_id, batch, rows, accepted, rejected."""
    return spark.createDataFrame(
        listener.counts(), "query_id string, batch bigint, rows bigint, accepted bigint, rejected bigint"
    )
