"""Task parameters: which dates, users, keywords and categories a job looks at."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameter names inside the task_param JSON object.
PARAM_FIELDS = (
    "startDate",
    "endDate",
    "startAge",
    "endAge",
    "professionals",
    "cities",
    "sex",
    "keywords",
    "categoryIds",
    "targetPageFlow",
)


@dataclass(frozen=True)
class TaskParams:
    """Typed task parameters. ``None`` means "no restriction"."""

    start_date: date | None = None
    end_date: date | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: tuple[str, ...] | None = None
    cities: tuple[str, ...] | None = None
    sex: str | None = None
    keywords: tuple[str, ...] | None = None
    category_ids: tuple[str, ...] | None = None
    page_flow: tuple[int, ...] | None = None

    @classmethod
    def from_json(cls, text: str | None) -> TaskParams:
        """Read ``{"startDate": ["2024-01-03"], ...}``; the first element of each array counts."""
        raw = json.loads(text) if text else {}

        def first(name: str) -> str | None:
            value = raw.get(name)
            if isinstance(value, list):
                value = value[0] if value else None
            return None if value is None or value == "" else str(value)

        def as_date(name: str) -> date | None:
            value = first(name)
            return None if value is None else date.fromisoformat(value)

        def as_int(name: str) -> int | None:
            value = first(name)
            return None if value is None else int(value)

        def as_list(name: str) -> tuple[str, ...] | None:
            value = first(name)
            return None if value is None else tuple(part for part in value.split(",") if part)

        flow = as_list("targetPageFlow")
        return cls(
            start_date=as_date("startDate"),
            end_date=as_date("endDate"),
            start_age=as_int("startAge"),
            end_age=as_int("endAge"),
            professionals=as_list("professionals"),
            cities=as_list("cities"),
            sex=first("sex"),
            keywords=as_list("keywords"),
            category_ids=as_list("categoryIds"),
            page_flow=None if flow is None else tuple(int(page) for page in flow),
        )


def param_column(task_param: Column | str, name: str) -> Column:
    """First element of the array ``name`` in a task_param JSON column, null when absent."""
    parsed = F.from_json(task_param, "map<string,array<string>>")
    return F.nullif(F.get(F.try_element_at(parsed, F.lit(name)), F.lit(0)), F.lit(""))


def task_param_fields(tasks: DataFrame) -> DataFrame:
    """One row per task with a text column per parameter."""
    return tasks.select("task_id", *[param_column("task_param", n).alias(n) for n in PARAM_FIELDS])


def load_task_params(tasks: DataFrame, task_id: int) -> TaskParams:
    """Parameters of one task. Exactly one short row reaches the driver."""
    rows = tasks.where(F.col("task_id") == task_id).select("task_param").take(1)
    if not rows:
        raise LookupError(f"no task {task_id}")
    return TaskParams.from_json(rows[0][0])
