"""The functions under their SQL names: scalar ones as SQL functions that the optimizer inlines, the aggregate as an
Arrow function, because a SQL function cannot aggregate."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

_DEFINITIONS = (
    """concat_long_string(v1 BIGINT, v2 STRING, sep STRING) RETURNS STRING
       RETURN concat(coalesce(cast(v1 AS STRING), 'null'), sep, coalesce(v2, 'null'))""",
    """json_field(json STRING, field STRING) RETURNS STRING
       RETURN get_json_object(json, concat('$.', field))""",
    # The salt is a hash of what the caller names, so that a repeated task sends its rows the same way.
    """random_prefix(val STRING, num INT, salt_on BIGINT) RETURNS STRING
       RETURN concat(cast(pmod(xxhash64(salt_on), num) AS STRING), '_', val)""",
    """remove_random_prefix(val STRING) RETURNS STRING
       RETURN regexp_replace(val, '^[0-9]+_', '')""",
)


def _concat_distinct(values: pa.Array) -> str:
    """The distinct non-null values of a group in ascending order, joined by commas; empty without any."""
    return ",".join(sorted(pc.unique(values.drop_null()).to_pylist()))


def register_functions(spark: SparkSession) -> None:
    """Create the temporary functions in the session.

    ``group_concat_distinct(x)`` aggregates in SQL, with all values of a group in one Python worker; the ``Column`` of the
    same name stays in the JVM and keeps each value once before the shuffle, for groups that are large.
    """
    spark.udf.register("group_concat_distinct", arrow_udf(_concat_distinct, "string"))
    for definition in _DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
