"""Results kept per day and extended by the days that change: totals, and exact distinct counts.

Both keep one folder per day and write a changed day again as a whole, so that refreshing twice, or
after a correction, leaves what one computation over the whole log gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date, timedelta
from functools import reduce
from inspect import signature

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight.functions.dates import MIDNIGHT, WHOLE_DAY, check_end_rule, check_range, in_date_range
from meterlight.operators.numbering import number_rows
from meterlight.session import delete_path, new_shared_path
from meterlight.sources.logs import last_day_before
from meterlight.views import UsageViews

DAY = "usage_date"


def stretches(days: Iterable[date]) -> list[tuple[date, date]]:
    """First and last day of each stretch of days in a row."""
    found: list[tuple[date, date]] = []
    for day in sorted(set(days)):
        if found and found[-1][1] + timedelta(days=1) == day:
            found[-1] = found[-1][0], day
        else:
            found.append((day, day))
    return found


def _write_days(rows: DataFrame, path: str, spans: Sequence[tuple[date, date]]) -> None:
    """Replace the days of ``spans`` by the rows given; days without rows lose their folder."""
    spark = rows.sparkSession
    copy = new_shared_path(spark, "days")
    rows.write.parquet(copy)
    kept = spark.read.schema(rows.schema).parquet(copy)
    written = kept.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
    written.option("partitionOverwriteMode", "dynamic").parquet(path)
    left = {row[0] for row in kept.select(DAY).distinct().collect()}
    for first, last in spans:
        for number in range((last - first).days + 1):
            day = first + timedelta(days=number)
            if day not in left:
                delete_path(spark, f"{path.rstrip('/')}/{DAY}={day.isoformat()}")


def _stored_days(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is stored below ``path``, with ``schema``; nothing before the first refresh."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return found.select(*schema.names)


class DailyState:
    """A result with a row or more per day, kept below ``path``.

    ``measure`` is an analysis of views and a range whose result has a column ``usage_date`` and
    depends, for each day, on that day's rows only: ``warehouse_daily``, ``ai_daily``,
    ``spill_daily``, ``day_cost``. ``refresh`` computes the days that have changed, as
    ``merge_log`` and ``replace_days`` name them, and nothing else; ``between`` reads days.
    """

    def __init__(self, views: UsageViews, path: str, measure: Callable[..., DataFrame]):
        self._views, self._path, self._measure = views, path, measure
        day = date(2000, 1, 1)
        self._schema = measure(views, day, day).schema
        # Metering is dated, and its analyses know no end rule.
        self._dated = "end_rule" not in signature(measure).parameters

    def _computed(self, first: date, last: date, end_rule: str) -> DataFrame:
        if self._dated:
            return self._measure(self._views, first, last)
        return self._measure(self._views, first, last, end_rule=end_rule)

    def refresh(self, days: Iterable[date | None]) -> None:
        """Compute these days again; rows without a day belong to no range and are left out."""
        spans = stretches(day for day in days if day is not None)
        if not spans:
            return
        parts = [self._computed(first, last, WHOLE_DAY) for first, last in spans]
        _write_days(reduce(DataFrame.union, parts), self._path, spans)

    def between(self, start: date | str, end: date | str, end_rule: str = MIDNIGHT) -> DataFrame:
        """The result for a range. Of a last day that ends at midnight only its first instant counts,
        which is read from the log."""
        first, last = check_range(start, end)
        check_end_rule(end_rule)
        spark = self._views.queries.sparkSession
        stored = _stored_days(spark, self._path, self._schema)
        if self._dated or end_rule == WHOLE_DAY:
            return in_date_range(stored, DAY, first, last)
        whole = stored.where((F.col(DAY) >= F.lit(first)) & (F.col(DAY) < F.lit(last)))
        return whole.union(self._computed(last, last, MIDNIGHT))

    def last_before(self, start: date | str) -> DataFrame:
        """The rows of the last stored day before ``start``: its folder's name tells it."""
        first, _ = check_range(start, start)
        spark = self._views.queries.sparkSession
        stored = _stored_days(spark, self._path, self._schema)
        last = last_day_before(stored, DAY, first)
        return stored.where(F.col(DAY) == F.lit(last) if last else F.lit(False))


_BITS = "bits"
_BUCKET = "bucket"


class DistinctDays:
    """Exact distinct counts that add up over days: a bitmap of dictionary numbers per day.

    Every value ever seen has a number, given once and kept below ``path``. A day keeps, per group
    of ``by`` and per 32,768 numbers, a bitmap of the values that occur; the bitmaps of a range's
    days are joined by OR and their bits counted. So no value is read or shuffled again, a copy in
    two days counts once, and what a task holds is one bitmap per group.

    ``rows`` is a function of views and a range, like an analysis, whose result has ``usage_date``,
    ``value`` and the columns ``by``. NULL values do not count, as in ``COUNT(DISTINCT value)``.
    """

    def __init__(self, views: UsageViews, path: str, rows: Callable[..., DataFrame], by: Sequence[str] = ()):
        self._views, self._rows, self._by = views, rows, list(by)
        self._numbers, self._days = f"{path.rstrip('/')}/numbers", f"{path.rstrip('/')}/days"
        day = date(2000, 1, 1)
        given = rows(views, day, day, WHOLE_DAY).schema
        self._value = T.StructType([given["value"], T.StructField("number", T.LongType())])
        kept = [given[column] for column in self._by]
        kept += [T.StructField(_BUCKET, T.LongType()), T.StructField(_BITS, T.BinaryType())]
        self._kept = T.StructType([*kept, given[DAY]])
        self._spark = views.queries.sparkSession

    def _numbered(self) -> DataFrame:
        try:
            return self._spark.read.parquet(self._numbers)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self._spark.createDataFrame([], self._value)

    def refresh(self, days: Iterable[date | None]) -> None:
        """Number the new values of these days and write their bitmaps again. One refresh at a time."""
        spans = stretches(day for day in days if day is not None)
        if not spans:
            return
        parts = [self._rows(self._views, first, last, WHOLE_DAY) for first, last in spans]
        rows = reduce(DataFrame.union, parts)
        copy = new_shared_path(self._spark, "distinct")
        rows.select(DAY, "value", *self._by).distinct().write.parquet(copy)
        rows = self._spark.read.parquet(copy)
        known = self._numbered()
        after = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        new = rows.where("value IS NOT NULL").select("value").distinct().join(known, "value", "left_anti")
        numbered = number_rows(new, [], [F.col("value")], "place")
        numbered = numbered.select("value", (F.col("place") - 1 + after).alias("number"))
        numbered.write.mode("append").parquet(self._numbers)
        held = rows.join(self._numbered(), "value", "left")
        # Numbers begin at 0; the bitmap functions count from 1.
        at = F.col("number") + 1
        bitmaps = held.groupBy(*self._by, DAY, F.bitmap_bucket_number(at).alias(_BUCKET)).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias(_BITS)
        )
        _write_days(bitmaps.select(*self._kept.names), self._days, spans)

    def between(self, start: date | str, end: date | str, name: str = "distinct_values") -> DataFrame:
        """The distinct values per group of ``by`` in a range of whole days; a group of NULLs has none."""
        stored = in_date_range(_stored_days(self._spark, self._days, self._kept), DAY, start, end)
        joined = stored.groupBy(*self._by, _BUCKET).agg(F.bitmap_or_agg(_BITS).alias(_BITS))
        count = F.coalesce(F.sum(F.bitmap_count(_BITS)), F.lit(0)).cast("bigint")
        return joined.groupBy(*self._by).agg(count.alias(name))


def query_ids(views: UsageViews, start: date, end: date, end_rule: str) -> DataFrame:
    """Query ids per day, for ``DistinctDays``."""
    log = views.scoped(start, end, end_rule=end_rule).queries
    return log.select(F.col("start_time").cast("date").alias(DAY), F.col("query_id").alias("value"))


def failing_users(views: UsageViews, start: date, end: date, end_rule: str) -> DataFrame:
    """Users of failed queries per day, error code and warehouse, for ``DistinctDays``."""
    log = views.scoped(start, end, end_rule=end_rule).queries
    return log.where(F.col("execution_status") != "SUCCESS").select(
        F.col("start_time").cast("date").alias(DAY),
        F.col("user_name").alias("value"),
        "error_code",
        "warehouse_name",
    )
