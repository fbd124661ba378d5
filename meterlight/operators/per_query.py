"""One row per query, made before any join on the query id.

Attribution holds many rows per query, and a long query can hold a large part of the log. Summing
per query first happens mostly on the map side, so a hot query reaches the join as one row, and
each key meets one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlight.functions.measures import cloud_credits, compute_credits, exact_total

# A row count times a per-query sum must fit 38 digits without losing the nine decimals.
COUNT_TYPE = "decimal(12,0)"
CREDIT_SUM_TYPE = "decimal(25,9)"
TIME_SUM_TYPE = "decimal(25,0)"


def credits_per_query(attribution: DataFrame) -> DataFrame:
    """query_id, credits, attribution_rows."""
    return attribution.groupBy("query_id").agg(
        F.sum(compute_credits()).cast(CREDIT_SUM_TYPE).alias("credits"),
        F.count(F.lit(1)).alias("attribution_rows"),
    )


def query_totals(queries: DataFrame, *dimensions: str | Column) -> DataFrame:
    """query_id, the dimensions, and what the log rows of that query add up to.

    Columns nobody reads are pruned from the scan and the shuffle.
    """
    elapsed = F.col("total_elapsed_time")
    return queries.groupBy("query_id", *dimensions).agg(
        F.count(F.lit(1)).alias("query_rows"),
        F.sum(cloud_credits()).cast(CREDIT_SUM_TYPE).alias("cloud_credits"),
        exact_total(elapsed).cast(TIME_SUM_TYPE).alias("elapsed"),
        F.count(elapsed).alias("elapsed_rows"),
        F.count_if(F.col("execution_status") == "SUCCESS").alias("succeeded"),
    )


def times(rows: str, value: str) -> Column:
    """A per-query sum repeated once for each of ``rows`` rows of the other log."""
    return F.col(rows).cast(COUNT_TYPE) * F.col(value)
