"""Warehouse analyses: credits over time, efficiency, cost per query, right-sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions.dates import in_date_range
from meterlight.functions.measures import (
    compute_credits,
    exact_total,
    mean,
    ratio,
    share,
    spilled_locally,
    spilled_remotely,
)
from meterlight.operators.governance import Caller
from meterlight.operators.per_query import query_totals, times
from meterlight.views import Day, UsageViews


def _daily(scope: UsageViews) -> DataFrame:
    return (
        scope.attribution.groupBy(
            "warehouse_name", F.col("start_time").cast("date").alias("usage_date")
        ).agg(F.sum(compute_credits()).alias("credits"))
    )


def warehouse_daily(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Credits per warehouse and day."""
    return _daily(views.scoped(start, end, user, end_rule)).withColumn("credits", F.col("credits").cast("double"))


def warehouse_hourly(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Credits per warehouse and hour of the day."""
    return (
        views.scoped(start, end, user, end_rule)
        .attribution.where(F.col("warehouse_name").isNotNull())
        .groupBy("warehouse_name", F.hour("start_time").alias("hour_of_day"))
        .agg(F.sum(compute_credits()).cast("double").alias("credits"))
        .withColumn("hour_of_day", F.col("hour_of_day").cast("bigint"))
    )


def warehouse_trend(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Credits of the trailing seven days per warehouse; the window sees one row per day.

    The days of a range are whole days, and their values those of the whole log: the six days
    before the range are read as well.
    """
    scope = views.scoped(start, end, user, end_rule)
    week = (
        W.partitionBy("warehouse_name")
        .orderBy(F.unix_date("usage_date"))
        .rangeBetween(-6, W.currentRow)
    )
    trend = (
        _daily(scope.with_days_before(6))
        .where(F.col("warehouse_name").isNotNull())
        .select(
            "warehouse_name",
            "usage_date",
            F.sum("credits").over(week).cast("double").alias("credits_7d"),
        )
    )
    return trend if scope.range is None else in_date_range(trend, "usage_date", *scope.range)


def warehouse_efficiency(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Queries, mean elapsed time and bytes scanned per warehouse."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy("warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            mean(F.col("total_elapsed_time")).alias("avg_elapsed_ms"),
            exact_total(F.col("bytes_scanned")).cast("double").alias("bytes_scanned"),
        )
    )


def success_rate(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Share of successful queries per warehouse."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy("warehouse_name")
        .agg(share(F.col("execution_status") == "SUCCESS").alias("success_rate"))
    )


def cost_per_query(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Credits per attributed query and warehouse."""
    scope = views.scoped(start, end, user, end_rule)
    return (
        query_totals(scope.queries, "warehouse_name")
        .join(scope.query_credits, "query_id")
        .groupBy("warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.sum(times("query_rows", "credits")).alias("spent"),
        )
        .select(
            "warehouse_name",
            "queries",
            F.col("spent").cast("double").alias("credits"),
            ratio(F.col("spent"), F.col("queries")).alias("credits_per_query"),
        )
    )


def spill_shares(scope: UsageViews) -> DataFrame:
    return scope.queries.groupBy("warehouse_name").agg(
        share(spilled_remotely()).alias("remote_spill_share"),
        share(spilled_locally()).alias("local_spill_share"),
    )


def right_sizing(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    size_up_above: float = 0.05,
    size_down_below: float = 0.01,
) -> DataFrame:
    """What each warehouse's spilling says about its size."""
    action = (
        F.when(F.col("remote_spill_share") > size_up_above, "SIZE_UP")
        .when(F.col("local_spill_share") < size_down_below, "SIZE_DOWN")
        .otherwise("KEEP")
    )
    return spill_shares(views.scoped(start, end, user, end_rule)).withColumn("action", action)
