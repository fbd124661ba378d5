"""Exact interpolated percentiles without bringing a group's values to one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the values are counted by
value, and the wanted ranks are then found digit by digit: first among buckets of 2^40 values, then
of 2^20, then among single values. Every window holds the buckets of one digit only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_DIGIT_BITS = 20
_SHIFTS = (40, 20, 0)


def count_values(
    df: DataFrame, keys: Sequence[str], value: str, repeats: str | None = None
) -> DataFrame:
    """keys, value, n: how often each non-NULL value occurs per group.

    A row counts as often as its column ``repeats`` says, if there is one.

    The coalesce never applies. It declares the value as not nullable, which keeps the optimizer
    from adding a NULL filter of its own for each later step, so that all steps share one shuffle of
    the counts.
    """
    number = F.coalesce(F.col(value).cast("bigint"), F.lit(0).cast("bigint"))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, number.alias("value"))
        .agg((F.count(F.lit(1)) if repeats is None else F.sum(repeats)).alias("n"))
    )


def _buckets(counts: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    if shift == 0:
        return counts.withColumnRenamed("value", "bucket")
    return counts.groupBy(*keys, F.shiftright("value", shift).alias("bucket")).agg(
        F.sum("n").alias("n")
    )


def _holds(rank: Column, upto: Column) -> Column:
    return (rank < upto) & (rank >= upto - F.col("n"))


def _first_ranks(buckets: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """The top buckets that hold the rank below and the rank above the percentile's place."""
    group = W.partitionBy(*keys)
    running = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    place = (F.sum("n").over(group) - 1) * F.lit(float(fraction))
    upto = F.col("upto")
    sides = F.array(
        F.struct(F.lit("low").alias("side"), F.floor("place").alias("rank")),
        F.struct(F.lit("high").alias("side"), F.ceil("place").alias("rank")),
    )
    return (
        buckets.withColumn("place", place)
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("target", F.explode(sides))
        .where(_holds(F.col("target.rank"), upto))
        .select(
            *keys,
            F.col("target.side").alias("side"),
            (F.col("target.rank") - (upto - F.col("n"))).alias("rank"),
            (F.col("place") - F.floor("place")).alias("weight"),
            "bucket",
        )
    )


def _narrow(buckets: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sub-bucket of each target's bucket that holds its rank.

    Without keys there are exactly two targets, which is bound enough to broadcast them; with keys
    their number is that of the groups, and AQE decides by the measured size.
    """
    wanted = targets.withColumnRenamed("bucket", "parent")
    wanted = (wanted if keys else F.broadcast(wanted)).alias("wanted")
    parts = buckets.alias("parts")
    match = F.shiftright("parts.bucket", _DIGIT_BITS) == F.col("wanted.parent")
    for key in keys:
        match = match & F.col(f"parts.{key}").eqNullSafe(F.col(f"wanted.{key}"))
    running = (
        W.partitionBy(*keys, "side")
        .orderBy("bucket")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        parts.join(wanted, match)
        .select(*(F.col(f"parts.{key}").alias(key) for key in keys),
                "side", "rank", "weight", "bucket", "n")
        .withColumn("upto", F.sum("n").over(running))
        .where(_holds(F.col("rank"), F.col("upto")))
        .select(*keys, "side", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"),
                "weight", "bucket")
    )


def percentile_of_counts(
    counts: DataFrame, keys: Sequence[str], fraction: float, name: str
) -> DataFrame:
    """keys and the interpolated percentile of what ``count_values`` counted."""
    targets = _first_ranks(_buckets(counts, keys, _SHIFTS[0]), keys, fraction)
    for shift in _SHIFTS[1:]:
        targets = _narrow(_buckets(counts, keys, shift), targets, keys)
    low = F.max(F.when(F.col("side") == "low", F.col("bucket")))
    high = F.max(F.when(F.col("side") == "high", F.col("bucket")))
    return targets.groupBy(*keys).agg((low + (high - low) * F.max("weight")).alias(name))


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str
) -> DataFrame:
    """keys and the interpolated percentile of a BIGINT column; NULL values do not count."""
    return percentile_of_counts(count_values(df, keys, value), keys, fraction, name)
