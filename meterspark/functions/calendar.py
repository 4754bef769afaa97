"""Calendar expressions: date parts and working-time features."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 2016 holiday dates of the source analysis.
HOLIDAYS_2016 = [
    "2016-01-01", "2016-01-18", "2016-02-15", "2016-05-30", "2016-07-04", "2016-09-05",
    "2016-10-10", "2016-11-11", "2016-11-24", "2016-11-25", "2016-12-23", "2016-12-26",
]
# Hour ranges of the time-of-day code (0-6 -> 4, 7-12 -> 1, 13-18 -> 2, 19-23 -> 3),
# business hours 9-18 inclusive, seasons Dec-Feb 1, Mar-May 2, Jun-Aug 3, Sep-Nov 4.
BUSINESS_FIRST_HOUR, BUSINESS_LAST_HOUR = 9, 18
SEASON_WINTER, SEASON_SPRING, SEASON_SUMMER, SEASON_FALL = 1, 2, 3, 4


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def calendar_parts(ts) -> dict[str, Column]:
    """date, month, time (HH:mm:ss) and hour of a timestamp."""
    t = _c(ts)
    return {
        "date": F.to_date(t),
        "month": F.month(t),
        "time": F.date_format(t, "HH:mm:ss"),
        "hr": F.hour(t),
    }


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


def is_workday(ts) -> Column:
    return F.when(day_of_week(ts) >= 5, F.lit(0)).otherwise(F.lit(1))


def is_holiday(ts, holidays: Sequence[str] = HOLIDAYS_2016) -> Column:
    days = [F.lit(dt.date.fromisoformat(d)) for d in holidays]
    return F.when(F.to_date(_c(ts)).isin(*days), F.lit(1)).otherwise(F.lit(0))


def time_of_day(ts) -> Column:
    h = F.hour(_c(ts))
    return (F.when(h <= 6, F.lit(4)).when(h <= 12, F.lit(1)).when(h <= 18, F.lit(2)).otherwise(F.lit(3)))


def is_business_hr(ts, holidays: Sequence[str] = HOLIDAYS_2016) -> Column:
    h = F.hour(_c(ts))
    in_hours = (h >= BUSINESS_FIRST_HOUR) & (h <= BUSINESS_LAST_HOUR)
    open_day = (is_workday(ts) == 1) & (is_holiday(ts, holidays) == 0)
    return F.when(in_hours & open_day, F.lit(1)).otherwise(F.lit(0))


def season(ts) -> Column:
    m = F.month(_c(ts))
    return (F.when(m.isin(12, 1, 2), F.lit(SEASON_WINTER)).when(m.isin(3, 4, 5), F.lit(SEASON_SPRING))
            .when(m.isin(6, 7, 8), F.lit(SEASON_SUMMER)).otherwise(F.lit(SEASON_FALL)))


def calendar_features(ts, holidays: Sequence[str] = HOLIDAYS_2016) -> dict[str, Column]:
    return {
        "day_of_week": day_of_week(ts),
        "is_workday": is_workday(ts),
        "is_holiday": is_holiday(ts, holidays),
        "time_of_day": time_of_day(ts),
        "is_business_hr": is_business_hr(ts, holidays),
        "season": season(ts),
    }


# SQL twins (DuckDB) of the same rules, for oracle queries.
def calendar_features_sql(ts: str, holidays: Sequence[str] = HOLIDAYS_2016) -> str:
    hol = ", ".join(f"DATE '{d}'" for d in holidays)
    dow = f"(isodow({ts}) - 1)"
    work = f"CASE WHEN {dow} >= 5 THEN 0 ELSE 1 END"
    holi = f"CASE WHEN CAST({ts} AS DATE) IN ({hol}) THEN 1 ELSE 0 END"
    h = f"hour({ts})"
    return (
        f"CAST({dow} AS INTEGER) AS day_of_week, {work} AS is_workday, {holi} AS is_holiday, "
        f"CASE WHEN {h} <= 6 THEN 4 WHEN {h} <= 12 THEN 1 WHEN {h} <= 18 THEN 2 ELSE 3 END AS time_of_day, "
        f"CASE WHEN {h} BETWEEN 9 AND 18 AND {work} = 1 AND {holi} = 0 THEN 1 ELSE 0 END AS is_business_hr, "
        f"CASE WHEN month({ts}) IN (12, 1, 2) THEN 1 WHEN month({ts}) IN (3, 4, 5) THEN 2 "
        f"WHEN month({ts}) IN (6, 7, 8) THEN 3 ELSE 4 END AS season"
    )
