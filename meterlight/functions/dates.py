"""Date ranges: validity, defaults, and the two ways a column is held against one."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.fixed_values import DEFAULT_WINDOWS

MIDNIGHT = "midnight"
WHOLE_DAY = "whole_day"


def check_end_rule(end_rule: str) -> str:
    """The rule, or ``ValueError`` for one that does not exist."""
    if end_rule not in (MIDNIGHT, WHOLE_DAY):
        raise ValueError(f"unknown end rule {end_rule!r}")
    return end_rule


def as_date(value: date | str | None) -> date | None:
    return date.fromisoformat(value) if isinstance(value, str) else value


def check_range(start: date | str | None, end: date | str | None) -> tuple[date, date]:
    """Both dates, or ``ValueError`` when one is missing or they are the wrong way round."""
    first, last = as_date(start), as_date(end)
    if first is None or last is None:
        raise ValueError("a date range needs a start and an end")
    if first > last:
        raise ValueError(f"the range starts on {first}, after its end {last}")
    return first, last


def default_range(kind: str, today: date | str) -> tuple[date, date]:
    """The range an ``admin`` or a ``user`` starts with."""
    before, after = DEFAULT_WINDOWS[kind]
    day = as_date(today)
    return day + timedelta(days=before), day + timedelta(days=after)


def in_date_range(df: DataFrame, column: str, start: date | str, end: date | str) -> DataFrame:
    """Rows of a date column within the range, both ends included."""
    first, last = check_range(start, end)
    return df.where(F.col(column).between(F.lit(first), F.lit(last)))


def in_ts_range(
    df: DataFrame, column: str, start: date | str, end: date | str, end_rule: str = MIDNIGHT
) -> DataFrame:
    """Rows of a timestamp column within the range.

    ``midnight`` ends at 00:00:00 of the last day, that instant included; ``whole_day`` keeps the
    whole last day. Bounds are date literals, which reach the parquet scan.
    """
    first, last = check_range(start, end)
    moment = F.col(column)
    if check_end_rule(end_rule) == MIDNIGHT:
        return df.where((moment >= F.lit(first)) & (moment <= F.lit(last)))
    return df.where((moment >= F.lit(first)) & (moment < F.lit(last + timedelta(days=1))))
