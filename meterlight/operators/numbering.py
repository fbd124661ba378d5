"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterlight.session import new_shared_path


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str
) -> DataFrame:
    """``row_number`` per group in the given order, with a large group spread over many tasks.

    A window would sort each group in one task. Instead all rows are range-partitioned by group and
    order and written once to the shared folder, so that their places are settled and outlive an
    executor. A row's number is its place within its partition plus the group's rows in earlier
    partitions; what tells so is one row per group and partition. The copy stays until
    ``remove_copies`` deletes it. ``order`` must tell all rows of a group apart for the numbers to be repeatable.
    """
    spark = df.sparkSession
    keys = [F.col(column) for column in group]
    path = new_shared_path(spark, "numbered")
    (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    placed = spark.read.parquet(path)
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    rows = placed.alias("rows")
    shifts = shifts.alias("shifts")
    match = F.col("rows._part") == F.col("shifts._part")
    for column in group:
        match = match & F.col(f"rows.{column}").eqNullSafe(F.col(f"shifts.{column}"))
    return rows.join(shifts, match).select(
        *(F.col(f"rows.{column}") for column in df.columns),
        (F.col("_place") + F.col("_shift") + 1).alias(name),
    )
