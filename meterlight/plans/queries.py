"""Query analyses: spilling, details, errors, the most expensive ones, scanning, compilation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.functions.measures import (
    cloud_credits,
    exact_total,
    failed,
    mean,
    ratio,
    share,
    spilled,
)
from meterlight.operators.governance import Caller
from meterlight.operators.percentile import exact_percentile
from meterlight.session import broadcast_rows
from meterlight.views import Day, UsageViews

LOCAL = "bytes_spilled_to_local_storage"
REMOTE = "bytes_spilled_to_remote_storage"


def _by_cost(*ids: str) -> list:
    return [F.col("credits").desc(), *ids]


def spill_queries(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Queries that spilled to disk."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.where(spilled())
        .select("query_id", F.col(LOCAL).alias("bytes_local"), F.col(REMOTE).alias("bytes_remote"))
    )


def spill_by_warehouse(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Spilled queries and bytes per warehouse, local against remote."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.where(spilled())
        .groupBy("warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            exact_total(F.col(LOCAL)).cast("double").alias("bytes_local"),
            exact_total(F.col(REMOTE)).cast("double").alias("bytes_remote"),
        )
    )


def spill_impact(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Mean elapsed time of queries that spilled and of those that did not."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy(spilled().alias("spilled"))
        .agg(
            F.count(F.lit(1)).alias("queries"),
            mean(F.col("total_elapsed_time")).alias("avg_elapsed_ms"),
        )
    )


def spill_daily(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Spilled queries and bytes per day."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.where(spilled())
        .groupBy(F.col("start_time").cast("date").alias("usage_date"))
        .agg(
            F.count(F.lit(1)).alias("spilled_queries"),
            exact_total(F.col(LOCAL)).cast("double").alias("bytes_local"),
            exact_total(F.col(REMOTE)).cast("double").alias("bytes_remote"),
        )
    )


def query_details(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """The query log, all columns, with profile links."""
    return views.scoped(start, end, user, end_rule).queries.withColumn(
        "credits_used_cloud_services", F.col("credits_used_cloud_services").cast("double")
    )


def error_tracking(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Failed queries and the users they hit, per error code and warehouse."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.where(failed())
        .groupBy("error_code", "warehouse_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.count_distinct("user_name").alias("users"),
        )
    )


def _dearest(scope: UsageViews, count: int) -> DataFrame:
    """The rows of the query log that cost most.

    Only ``count`` query ids can hold the ``count`` dearest rows. They are found on ids and credits
    alone, and the log is then probed with that many ids, a broadcast bounded by the limit.
    Attribution of other queries goes before it is summed.
    """
    ids = (
        scope.credits_of(scope.queries)
        .orderBy(*_by_cost("query_id"))
        .limit(count)
        .select("query_id", F.col("credits").cast("double").alias("credits"))
    )
    return scope.queries.join(broadcast_rows(ids, count), "query_id")


def top_queries(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    count: int = 20,
) -> DataFrame:
    """The most expensive queries."""
    return (
        _dearest(views.scoped(start, end, user, end_rule), count)
        .select("query_id", "user_name", "warehouse_name", "query_type", "credits")
        .orderBy(*_by_cost("query_id", "user_name", "warehouse_name", "query_type"))
        .limit(count)
    )


def top_query_resources(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    count: int = 20,
) -> DataFrame:
    """The most expensive queries with what they used."""
    return (
        _dearest(views.scoped(start, end, user, end_rule), count)
        .select(
            "query_id",
            "user_name",
            "warehouse_name",
            "query_type",
            "credits",
            "bytes_scanned",
            F.col(LOCAL).alias("bytes_local"),
            F.col(REMOTE).alias("bytes_remote"),
            "total_elapsed_time",
        )
        .orderBy(*_by_cost("query_id", "user_name", "warehouse_name", "query_type"))
        .limit(count)
    )


def top_queries_all(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    count: int = 25,
) -> DataFrame:
    """The most expensive queries, warehouse and AI cost side by side."""
    scope = views.scoped(start, end, user, end_rule)
    warehouse = scope.attributed_in_range.select(
        "query_id", F.lit("WAREHOUSE").alias("kind"), F.col("credits").cast("decimal(38,9)")
    )
    ai = (
        scope.ai_log.groupBy("query_id")
        .agg(F.sum("token_credits").cast("decimal(38,9)").alias("credits"))
        .select("query_id", F.lit("AI").alias("kind"), "credits")
    )
    return (
        warehouse.unionByName(ai)
        .orderBy(F.col("credits").desc_nulls_last(), "query_id", "kind")
        .limit(count)
        .withColumn("credits", F.col("credits").cast("double"))
    )


def cloud_services_by_type(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Cloud service credits per query type."""
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy("query_type")
        .agg(F.sum(cloud_credits()).cast("double").alias("cloud_credits"))
    )


def compilation_share(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Mean compilation time and its share of the elapsed time, per query type."""
    compiling, elapsed = F.col("compilation_time"), F.col("total_elapsed_time")
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy("query_type")
        .agg(
            mean(compiling).alias("avg_compilation_ms"),
            ratio(exact_total(compiling), exact_total(elapsed)).alias("compilation_share"),
        )
    )


def scan_patterns(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Bytes scanned per user."""
    scanned = F.col("bytes_scanned")
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy("user_name")
        .agg(
            exact_total(scanned).cast("double").alias("total_bytes"),
            mean(scanned).alias("avg_bytes"),
            F.max(scanned).alias("max_bytes"),
        )
    )


def large_queries(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    fraction: float = 0.95,
) -> DataFrame:
    """Queries that scanned at least the given percentile of all queries' bytes.

    Bytes are whole, so the limit is rounded up to a BIGINT, which the scan can filter by.
    """
    queries = views.scoped(start, end, user, end_rule).queries
    limit = exact_percentile(queries, [], "bytes_scanned", fraction, "limit")
    return queries.where(
        F.col("bytes_scanned") >= limit.select(F.ceil(F.round("limit", 4))).scalar()
    ).select("query_id", "user_name", "warehouse_name", "bytes_scanned")


def failure_rollup(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Failure rate per warehouse and query type, per warehouse, and overall.

    Counted at the finest level first: the rollup then triples groups, not log rows.
    ``level`` is 0 for the finest level, 1 per warehouse, 3 overall.
    """
    return (
        views.scoped(start, end, user, end_rule)
        .queries.groupBy("warehouse_name", "query_type")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(failed()).alias("failures"))
        .rollup("warehouse_name", "query_type")
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.sum("rows").alias("queries"),
            ratio(F.sum("failures"), F.sum("rows")).alias("failure_rate"),
        )
    )


def failing_share(scope: UsageViews) -> DataFrame:
    return scope.queries.groupBy("user_name").agg(share(failed()).alias("failure_share"))
