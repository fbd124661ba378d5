"""The steps of the overviews as results of their own."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.fixed_values import DEFAULT_WINDOWS
from meterlight.functions.dates import WHOLE_DAY, default_range, in_ts_range
from meterlight.functions.measures import compute_credits
from meterlight.operators.per_query import times
from meterlight.plans.overview import (
    attributed_queries,
    repeated_cloud_credits,
    repeated_mean_seconds,
)
from meterlight.views import UsageViews


def plain_credits(df: DataFrame) -> DataFrame:
    """Credits as doubles, the type every result shows them in."""
    decimals = {
        name: F.col(name).cast("double") for name, kind in df.dtypes if kind.startswith("decimal")
    }
    return df.withColumns(decimals)


def join_history_attribution(views: UsageViews) -> DataFrame:
    """The two logs joined row by row; AQE splits a hot query on either side.

    Attribution stands on the left, the side a sort-merge join streams: its rows of a hot query are
    never held in memory together.
    """
    queries = views.queries.select(
        "query_id", "start_time", "total_elapsed_time", "credits_used_cloud_services"
    )
    attribution = views.attribution_credits.select("query_id", "credits_attributed_compute")
    joined = attribution.join(queries, "query_id", "inner")
    return plain_credits(joined.select(*queries.columns, "credits_attributed_compute"))


def count_distinct_queries(views: UsageViews) -> DataFrame:
    return views.attribution_credits.agg(F.count_distinct("query_id").alias("total_queries"))


def sum_coalesce(views: UsageViews) -> DataFrame:
    """Compute and cloud credits over the joined logs, NULL counting as 0."""
    return attributed_queries(views).agg(
        F.sum(times("query_rows", "credits")).cast("double").alias("compute_credits"),
        repeated_cloud_credits().cast("double").alias("cs_credits"),
    )


def avg_elapsed(views: UsageViews) -> DataFrame:
    return attributed_queries(views).agg(repeated_mean_seconds().alias("avg_execution_seconds"))


def scalar_round(views: UsageViews) -> DataFrame:
    """Each attribution entry rounded to three and to two places, halves away from zero."""
    return views.attribution_credits.select(
        "query_id",
        F.round(compute_credits(), 3).cast("double").alias("credits_3"),
        F.round(compute_credits(), 2).cast("double").alias("credits_2"),
    )


def default_ranges(views: UsageViews, today: date | str) -> DataFrame:
    """The default ranges of both kinds, with the queries that started on their days.

    One pass over the days of both counts for both.
    """
    day = F.col("start_time").cast("date")
    bounds = {kind: default_range(kind, today) for kind in DEFAULT_WINDOWS}
    first_day = min(first for first, _ in bounds.values())
    last_day = max(last for _, last in bounds.values())
    counted = in_ts_range(views.queries, "start_time", first_day, last_day, WHOLE_DAY).agg(
        *(
            F.count_if(day.between(F.lit(first), F.lit(last))).alias(kind)
            for kind, (first, last) in bounds.items()
        )
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(first).alias("start_date"),
                F.lit(last).alias("end_date"),
                F.lit((last - first) // timedelta(days=1) + 1).cast("bigint").alias("days"),
                F.col(kind).alias("queries"),
            )
            for kind, (first, last) in bounds.items()
        )
    )
    return counted.select(F.inline(rows))
