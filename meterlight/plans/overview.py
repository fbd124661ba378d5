"""The account overview, its key figures, and the personal usage overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.fixed_values import ADMIN_PLACES, SERVICE_KPIS, USER_PLACES
from meterlight.functions.dates import WHOLE_DAY, check_range
from meterlight.functions.display import format_kpis
from meterlight.functions.measures import ratio
from meterlight.operators.governance import Caller
from meterlight.operators.per_query import query_totals, times
from meterlight.views import Day, UsageViews


def admin_overview(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Credits per service type, largest first."""
    return (
        views.scoped(start, end)
        .metering.groupBy("service_type")
        .agg(
            F.sum("credits_used").cast("double").alias("total_credits"),
            F.sum("credits_used_compute").cast("double").alias("current_compute"),
            F.sum("credits_used_cloud_services").cast("double").alias("current_cloud_services"),
        )
        .orderBy(F.col("total_credits").desc_nulls_last(), "service_type")
    )


def _total_or_zero(credits: Column) -> Column:
    return F.coalesce(F.sum(credits).cast("double"), F.lit(0.0))


def service_kpis(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Total credits and those of the listed services: one row, none without metering rows."""
    credits = F.col("credits_used")
    figures = [
        _total_or_zero(F.when(F.col("service_type") == service, credits)).alias(name)
        for name, service in SERVICE_KPIS.items()
    ]
    return (
        views.scoped(start, end)
        .metering.agg(
            F.count(F.lit(1)).alias("rows"),
            _total_or_zero(credits).alias("total_credits"),
            *figures,
        )
        .where(F.col("rows") > 0)
        .drop("rows")
    )


def displayed_kpis(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """The key figures as text."""
    return format_kpis(service_kpis(views, start, end), ADMIN_PLACES)


def attributed_queries(scope: UsageViews) -> DataFrame:
    """One row per query that has attribution: what a row-by-row join adds up to.

    Joining the logs row by row repeats a query's own values once per attribution row, and each
    attribution row once per row of the query. The row counts of both sides say how often, so the
    repeated rows need not exist.
    """
    return query_totals(scope.queries).join(scope.query_credits, "query_id")


def repeated_cloud_credits() -> Column:
    return F.sum(times("attribution_rows", "cloud_credits"))


def repeated_mean_seconds() -> Column:
    repeats = F.sum(times("attribution_rows", "elapsed_rows"))
    return ratio(F.sum(times("attribution_rows", "elapsed")), repeats) / 1000


def user_overview(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """One row: queries, compute credits, cloud credits and mean seconds, over the joined logs.

    Cloud credits and seconds count once per attribution row, as in a plain join.
    """
    return attributed_queries(views.scoped(start, end, user, end_rule)).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.sum(times("query_rows", "credits")), 3).cast("double").alias("compute_credits"),
        F.round(repeated_cloud_credits(), 3).cast("double").alias("cs_credits"),
        F.round(repeated_mean_seconds(), 2).alias("avg_execution_seconds"),
    )


def displayed_overview(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """The personal overview as text."""
    return format_kpis(user_overview(views, start, end, user, end_rule), USER_PLACES)


_OVERVIEW_SQL = """
WITH credits AS (
  SELECT query_id, COUNT(*) AS entries,
         CAST(SUM(COALESCE(credits_attributed_compute, 0)) AS DECIMAL(25, 9)) AS compute
  FROM {attribution} LEFT SEMI JOIN {queries} USING (query_id)
  GROUP BY query_id
),
queries AS (
  SELECT query_id, COUNT(*) AS entries,
         CAST(SUM(COALESCE(credits_used_cloud_services, 0)) AS DECIMAL(25, 9)) AS cloud,
         CAST(SUM(CAST(total_elapsed_time AS DECIMAL(20, 0))) AS DECIMAL(25, 0)) AS elapsed,
         COUNT(total_elapsed_time) AS timed
  FROM {queries}
  WHERE start_time >= :start_date
    AND (start_time <= :end_date OR :whole_day AND start_time < DATE_ADD(:end_date, 1))
  GROUP BY query_id
)
SELECT COUNT(*) AS total_queries,
       CAST(ROUND(SUM(CAST(q.entries AS DECIMAL(12, 0)) * c.compute), 3) AS DOUBLE)
         AS compute_credits,
       CAST(ROUND(SUM(CAST(c.entries AS DECIMAL(12, 0)) * q.cloud), 3) AS DOUBLE) AS cs_credits,
       ROUND(CAST(SUM(CAST(c.entries AS DECIMAL(12, 0)) * q.elapsed) AS DOUBLE)
         / NULLIF(CAST(SUM(c.entries * q.timed) AS DOUBLE), 0) / 1000, 2)
         AS avg_execution_seconds
FROM queries q JOIN credits c ON q.query_id = c.query_id
"""


def user_overview_sql(
    views: UsageViews, start: Day, end: Day, user: Caller = None, end_rule: str | None = None
) -> DataFrame:
    """``user_overview`` as SQL text, with the dates and the end rule bound as parameters.

    The views have the same range, so that logs stored by day are read for their days only.
    """
    first, last = check_range(start, end)
    scope = views.scoped(first, last, user, end_rule)
    whole_day = scope.end_rule == WHOLE_DAY
    return scope.queries.sparkSession.sql(
        _OVERVIEW_SQL,
        args={"start_date": first, "end_date": last, "whole_day": whole_day},
        queries=scope.queries,
        attribution=scope.attribution_credits,
    )
