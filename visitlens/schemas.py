"""Input table layouts and the check that a DataFrame fits one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


USER_VISIT_ACTION = _table(
    ("date", T.DateType()),
    ("user_id", T.LongType()),
    ("session_id", T.StringType()),
    ("page_id", T.LongType()),
    ("action_time", T.TimestampType()),
    ("search_keyword", T.StringType()),
    ("click_category_id", T.LongType()),
    ("click_product_id", T.LongType()),
    ("order_category_ids", T.StringType()),
    ("order_product_ids", T.StringType()),
    ("pay_category_ids", T.StringType()),
    ("pay_product_ids", T.StringType()),
    ("city_id", T.LongType()),
)

USER_INFO = _table(
    ("user_id", T.LongType()),
    ("username", T.StringType()),
    ("name", T.StringType()),
    ("age", T.IntegerType()),
    ("professional", T.StringType()),
    ("city", T.StringType()),
    ("sex", T.StringType()),
)

PRODUCT_INFO = _table(
    ("product_id", T.LongType()),
    ("product_name", T.StringType()),
    ("extend_info", T.StringType()),
)

CITY_INFO = _table(
    ("city_id", T.LongType()),
    ("city_name", T.StringType()),
    ("area", T.StringType()),
)

TASK = _table(
    ("task_id", T.LongType()),
    ("task_name", T.StringType()),
    ("create_time", T.StringType()),
    ("start_time", T.StringType()),
    ("finish_time", T.StringType()),
    ("task_type", T.StringType()),
    ("task_status", T.StringType()),
    ("task_param", T.StringType()),
)

AD_CLICK = _table(
    ("ts", T.TimestampType()),
    ("province", T.StringType()),
    ("city", T.StringType()),
    ("user_id", T.LongType()),
    ("ad_id", T.LongType()),
)


def require(df: DataFrame, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Raise ``ValueError`` unless ``df`` has the schema's columns (or the named ones) and types."""
    actual = {field.name: field.dataType for field in df.schema}
    problems = []
    for field in schema:
        if columns is not None and field.name not in columns:
            continue
        if field.name not in actual:
            problems.append(f"missing column {field.name}")
        elif actual[field.name] != field.dataType:
            problems.append(
                f"column {field.name} is {actual[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    if problems:
        raise ValueError("; ".join(problems))
    return df
