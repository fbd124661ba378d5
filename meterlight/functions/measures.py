"""Column expressions shared by the analyses.

Sums run in exact types (integers and decimals) and become doubles once, at the end, so results do
not depend on the order in which partitions are merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("decimal(18,9)"))


def compute_credits() -> Column:
    return or_zero(F.col("credits_attributed_compute"))


def cloud_credits() -> Column:
    return or_zero(F.col("credits_used_cloud_services"))


def exact_total(value: Column) -> Column:
    """Sum of a BIGINT column that may pass 2^63 over a large log."""
    return F.sum(value.cast("decimal(20,0)"))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; NULL when ``whole`` is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def mean(value: Column) -> Column:
    """Average of a BIGINT column from its exact sum."""
    return ratio(exact_total(value), F.count(value))


def share(condition: Column) -> Column:
    """Share of the rows that meet a condition (NULL counts as not met)."""
    return ratio(F.count_if(condition), F.count(F.lit(1)))


def failed() -> Column:
    return F.col("execution_status") != "SUCCESS"


def spilled_locally() -> Column:
    return F.col("bytes_spilled_to_local_storage") > 0


def spilled_remotely() -> Column:
    return F.col("bytes_spilled_to_remote_storage") > 0


def spilled() -> Column:
    return spilled_locally() | spilled_remotely()
