"""RANK over a whole frame, top ranks only, ties included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.session import broadcast_rows


def top_ranks(df: DataFrame, metric: str, count: int, name: str = "rank") -> DataFrame:
    """Rows whose rank by ``metric`` (largest first) is at most ``count``.

    Any number of rows may tie, so the rows themselves never meet in one task: only the ``count``
    largest distinct values do, and rows find their rank by value. The broadcast side is those
    values, at most ``count`` rows.
    """
    values = (
        df.where(F.col(metric).isNotNull())
        .groupBy(metric)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .orderBy(F.col(metric).desc())
        .limit(count)
    )
    larger = W.orderBy(F.col(metric).desc()).rowsBetween(W.unboundedPreceding, -1)
    ranks = values.select(
        metric, (F.coalesce(F.sum("_rows").over(larger), F.lit(0)) + 1).alias(name)
    ).where(F.col(name) <= count)
    return df.join(broadcast_rows(ranks, count), metric)
