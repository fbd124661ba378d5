"""AI function and AI chat analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.functions.measures import ratio
from meterlight.operators.governance import Caller
from meterlight.operators.per_query import times
from meterlight.operators.percentile import count_values, percentile_of_counts
from meterlight.views import Day, UsageViews


def ai_by_function(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Calls, tokens and credits per AI function and model."""
    scope = views.scoped(start, end, user, end_rule)
    logged = scope.queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("query_rows"))
    return (
        scope.ai_calls("function_name", "model_name")
        .join(logged, "query_id")
        .groupBy("function_name", "model_name")
        .agg(
            F.sum(F.col("calls") * F.col("query_rows")).alias("calls"),
            F.sum(times("query_rows", "tokens")).cast("bigint").alias("tokens"),
            F.sum(times("query_rows", "token_credits")).cast("double").alias("credits"),
        )
    )


def ai_daily(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Tokens and credits per day."""
    scope = views.scoped(start, end, user, end_rule)
    day = F.col("start_time").cast("date").alias("usage_date")
    logged = scope.queries.groupBy("query_id", day).agg(F.count(F.lit(1)).alias("query_rows"))
    return (
        scope.ai_calls()
        .join(logged, "query_id")
        .groupBy("usage_date")
        .agg(
            F.sum(times("query_rows", "tokens")).cast("bigint").alias("tokens"),
            F.sum(times("query_rows", "token_credits")).cast("double").alias("credits"),
        )
    )


def analyst_daily(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Chat requests and credits per user and day."""
    return (
        views.scoped(start, end, user, end_rule)
        .analyst.groupBy("username", F.col("start_time").cast("date").alias("usage_date"))
        .agg(
            F.sum("request_count").alias("requests"),
            F.sum("credits").cast("double").alias("credits"),
        )
    )


def ai_model_cost(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Credits per million tokens and model."""
    millionfold = F.sum("token_credits").cast("double") * 1e6
    return (
        views.scoped(start, end, user, end_rule)
        .ai_log.groupBy("model_name")
        .agg(ratio(millionfold, F.sum("tokens")).alias("credits_per_million_tokens"))
    )


def ai_query_details(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
) -> DataFrame:
    """Every AI function call with the query behind it."""
    return (
        views.scoped(start, end, user, end_rule)
        .ai_queries.select(
            "query_id",
            "user_name",
            "function_name",
            "model_name",
            "tokens",
            F.col("token_credits").cast("double").alias("credits"),
            "total_elapsed_time",
            "query_id_url",
        )
    )


def ai_function_perf(
    views: UsageViews,
    start: Day = None,
    end: Day = None,
    user: Caller = None,
    end_rule: str | None = None,
    fraction: float = 0.95,
) -> DataFrame:
    """Mean and exact interpolated percentile of the elapsed time per AI function.

    Both come from the counts per elapsed time, so the joins below run once.
    """
    keys = ["function_name"]
    scope = views.scoped(start, end, user, end_rule)
    elapsed = scope.queries.groupBy("query_id", "total_elapsed_time").agg(
        F.count(F.lit(1)).alias("query_rows")
    )
    calls = scope.ai_calls(*keys).join(elapsed, "query_id")
    calls = calls.withColumn("repeats", F.col("calls") * F.col("query_rows"))
    counts = count_values(calls, keys, "total_elapsed_time", "repeats")
    weighted = F.col("value").cast("decimal(20,0)") * F.col("n").cast("decimal(15,0)")
    means = counts.groupBy(*keys).agg(ratio(F.sum(weighted), F.sum("n")).alias("avg_elapsed_ms"))
    tails = percentile_of_counts(counts, keys, fraction, "p95_elapsed_ms")
    same = F.col("means.function_name").eqNullSafe(F.col("tails.function_name"))
    return means.alias("means").join(tails.alias("tails"), same).select(
        "means.function_name",
        "avg_elapsed_ms",
        F.round("p95_elapsed_ms", 4).alias("p95_elapsed_ms"),
    )
