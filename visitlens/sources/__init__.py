from visitlens.sources.adlog import parse_ad_log, read_kafka_log, read_log_files, rejected_ad_log
from visitlens.sources.segments import append_segments, read_segments, stream_segments
from visitlens.sources.tables import (
    actions_in_range,
    clicks_in_range,
    jdbc_options,
    read_jdbc,
    typed_actions,
)

__all__ = [
    "actions_in_range",
    "append_segments",
    "clicks_in_range",
    "jdbc_options",
    "parse_ad_log",
    "read_jdbc",
    "read_kafka_log",
    "read_log_files",
    "read_segments",
    "rejected_ad_log",
    "stream_segments",
    "typed_actions",
]
