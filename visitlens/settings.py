"""Session settings the jobs expect, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings, so an existing session can take them over.
SESSION_CONF = {
    # Dates and minutes are cut from timestamps in this zone.
    "spark.sql.session.timeZone": "UTC",
    # Coalescing, skew splitting and runtime broadcast decisions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Sets per session are small, so more of them fit before an aggregate has to sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    # Streaming state larger than the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # A batch uploads what it changed in the state, not the state's files.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Every batch gives out what it changed at once; state that is past leaves with the next batch that has rows.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply ``SESSION_CONF`` to a session and return it."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor can reach.

    Without that setting only a session in one process can go on, in a temporary folder of its own; on a cluster
    other machines would not see the files, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="visitlens-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
