"""Account and user analyses: cost over time and by category, users, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.functions.dates import in_date_range
from meterlight.functions.measures import compute_credits, or_zero, ratio
from meterlight.operators.governance import Caller
from meterlight.operators.per_query import query_totals, times
from meterlight.operators.ranking import top_ranks
from meterlight.views import Day, UsageViews

# The windows below have no partition: they run over one row per day or per service type.


def _daily_cost(metering: DataFrame) -> DataFrame:
    return metering.groupBy("usage_date").agg(F.sum("credits_used").alias("credits"))


def cost_daily(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Credits per day and the change against the day before it in the log.

    The day before a range's first one is found by its date and read as well.
    """
    scope = views.scoped(start, end)
    days = _daily_cost(scope.metering)
    if scope.range is not None:
        days = days.union(_daily_cost(scope.metering_before(scope.range[0])))
    changes = cost_changes(days)
    return changes if scope.range is None else in_date_range(changes, "usage_date", *scope.range)


def day_cost(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Exact credits per day, as ``DailyState`` keeps them for ``cost_changes``."""
    return _daily_cost(views.scoped(start, end).metering)


def cost_changes(days: DataFrame) -> DataFrame:
    """Credits per day and the change against the day before it, from exact credits per day."""
    before = F.lag("credits").over(W.orderBy(F.col("usage_date").asc_nulls_last()))
    return days.select(
        "usage_date",
        F.col("credits").cast("double").alias("credits"),
        (F.col("credits") - before).cast("double").alias("delta"),
    )


def cost_cumulative(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Credits spent up to and including each day."""
    by_day = W.orderBy(F.col("usage_date").asc_nulls_last())
    so_far = by_day.rowsBetween(W.unboundedPreceding, W.currentRow)
    return _daily_cost(views.scoped(start, end).metering).select(
        "usage_date", F.sum("credits").over(so_far).cast("double").alias("credits_to_date")
    )


def cost_by_category(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Credits per service type and their share of all credits."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        views.scoped(start, end)
        .metering.groupBy("service_type")
        .agg(F.sum("credits_used").alias("spent"))
        .select(
            "service_type",
            F.col("spent").cast("double").alias("credits"),
            ratio(F.col("spent"), F.sum("spent").over(everything)).alias("share"),
        )
    )


def top_users(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    count: int = 10,
) -> DataFrame:
    """The users who spent most, by rank, ties included."""
    spent = (
        views.scoped(start, end, user, end_rule)
        .attribution.where(F.col("user_name").isNotNull())
        .groupBy("user_name")
        .agg(F.sum(compute_credits()).alias("credits"))
    )
    return top_ranks(spent, "credits", count, "spending_rank").select(
        "user_name", F.col("credits").cast("double").alias("credits"), "spending_rank"
    )


def user_efficiency(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Credits per query, mean elapsed time and success rate per user."""
    scope = views.scoped(start, end, user, end_rule)
    rows = F.sum("query_rows")
    spent = F.sum(or_zero(times("query_rows", "credits")))
    return (
        query_totals(scope.queries, "user_name")
        .join(scope.query_credits, "query_id", "left")
        .groupBy("user_name")
        .agg(
            rows.alias("queries"),
            ratio(spent, rows).alias("credits_per_query"),
            ratio(F.sum("elapsed"), F.sum("elapsed_rows")).alias("avg_elapsed_ms"),
            ratio(F.sum("succeeded"), rows).alias("success_rate"),
        )
    )


def user_activity(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Queries per user, weekday (Monday is 1) and hour."""
    moment = F.col("start_time")
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy(
            "user_name",
            F.extract(F.lit("DAYOFWEEK_ISO"), moment).cast("bigint").alias("weekday"),
            F.hour(moment).cast("bigint").alias("hour_of_day"),
        )
        .agg(F.count(F.lit(1)).alias("queries"))
    )


def storage_growth(views: UsageViews, start: Day = None, end: Day = None) -> DataFrame:
    """Bytes per source and snapshot date, with those of the snapshot before.

    For a range, each source's last snapshot before it is read as well.
    """
    scope = views.scoped(start, end)
    columns = ["source", "snapshot_date", "bytes"]
    snapshots = scope.storage.select(*columns)
    if scope.range is not None:
        earlier = scope.all_dates().storage.where(F.col("snapshot_date") < F.lit(scope.range[0]))
        latest = F.max(F.struct("snapshot_date", "bytes")).alias("latest")
        last = earlier.groupBy("source").agg(latest).select("source", "latest.*")
        snapshots = snapshots.union(last)
    before = W.partitionBy("source").orderBy(F.col("snapshot_date").asc_nulls_last())
    growth = snapshots.select(*columns, F.lag("bytes").over(before).alias("previous_bytes"))
    return growth if scope.range is None else in_date_range(growth, "snapshot_date", *scope.range)
