from visitlens.sinks.batched import write_batches
from visitlens.sinks.results import (
    RESULT_TABLES,
    ResultTable,
    put_rows,
    read_days,
    read_result,
    replace_days,
    write_jdbc,
    write_result,
)

__all__ = [
    "RESULT_TABLES",
    "ResultTable",
    "put_rows",
    "read_days",
    "read_result",
    "replace_days",
    "write_batches",
    "write_jdbc",
    "write_result",
]
