"""Hand-made input frames."""

from datetime import datetime, timedelta, timezone

from visitlens.schemas import AD_CLICK, CITY_INFO, PRODUCT_INFO, USER_INFO, USER_VISIT_ACTION

START = datetime(2024, 1, 3, 9, 0, 0, tzinfo=timezone.utc)


def at(seconds=0, day=0):
    return START + timedelta(days=day, seconds=seconds)


def actions(spark, rows):
    """Rows as dicts; what is left out is null, the date follows from action_time."""
    names = USER_VISIT_ACTION.fieldNames()
    full = []
    for row in rows:
        row = dict(row)
        if row.get("action_time") is not None:
            row.setdefault("date", row["action_time"].date())
        full.append(tuple(row.get(name) for name in names))
    return spark.createDataFrame(full, USER_VISIT_ACTION)


def session_of(session_id, length, steps=2, user_id=1, **extra):
    """A session of ``steps`` actions that lasts ``length`` seconds."""
    times = [at(0)] * (steps - 1) + [at(length)]
    return [
        {"session_id": session_id, "user_id": user_id, "page_id": 1, "action_time": t, **extra} for t in times
    ]


def users(spark, rows=((1, 30, "p1", "c1", "male"),)):
    return spark.createDataFrame([(u, f"u{u}", f"n{u}", a, p, c, s) for u, a, p, c, s in rows], USER_INFO)


def cities(spark, rows):
    return spark.createDataFrame(rows, CITY_INFO)


def products(spark, rows):
    return spark.createDataFrame(rows, PRODUCT_INFO)


def ad_clicks(spark, rows):
    return spark.createDataFrame(rows, AD_CLICK)
