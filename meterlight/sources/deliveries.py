"""Deliveries of log rows, late and repeated ones too, merged into logs stored by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.session import delete_path, new_shared_path
from meterlight.sources.logs import with_day, write_days


def _read_days(spark: SparkSession, path: str) -> DataFrame | None:
    """The log at ``path``, or ``None`` if nothing is stored there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _on_days(day: str, days: Sequence[date | None]) -> Column:
    known = [d for d in days if d is not None]
    wanted = F.col(day).isin(known) if known else F.lit(False)
    return wanted | F.col(day).isNull() if None in days else wanted


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    path = new_shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _latest(rows: DataFrame, keys: Sequence[str], version: str | None, columns: list[str]) -> DataFrame:
    """One row per key: the one of the latest version; of equal ones the delivered one.

    What is left equal is told apart by the row's text. Rows with a NULL in the key are the same
    only if all their columns are. Versions of a key combine on the map side.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    unknown = F.lit(False)
    for key in keys:
        unknown = unknown | F.col(key).isNull()
    order = ([F.col(version)] if version else []) + [F.col("_delivered"), F.col("_text")]
    return (
        rows.withColumn("_text", text)
        .groupBy(*keys, F.when(unknown, F.col("_text")).alias("_unknown"))
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def merge_log(delivery: DataFrame, path: str, keys: Sequence[str], version: str | None = None) -> list[date | None]:
    """Merge a delivery into the log that ``store_log`` or this keeps at ``path``; returns the days touched.

    ``keys`` tell a row of the log: what has the same key is the same row, delivered again or
    corrected, and the one with the highest ``version`` stays. Without a version, or among equal
    ones, the delivered row replaces the stored one. So a delivery merged twice changes nothing, and
    deliveries with versions may come in any order. A corrected row may move to another day.

    Only the days of delivered rows, and those that held an older version of them, are read and
    written again. The merged days are stored in the shared folder before they replace the old
    ones; a merge that fails on the way is repeated with the same delivery. One merge at a time.
    """
    spark = delivery.sparkSession
    dated, day = with_day(delivery)
    if day is None:
        raise ValueError("a log needs start_time or usage_date to be merged by day")
    columns = list(dated.columns)
    arrived = _kept(dated.withColumn("_delivered", F.lit(1)), "delivery")
    touched = {row[0] for row in arrived.select(day).distinct().collect()}
    stored = _read_days(spark, path)
    rows = arrived
    if stored is not None:
        if sorted(stored.columns) != sorted(columns):
            raise ValueError(f"the log at {path} has other columns than the delivery")
        if not {"start_time", day} & set(keys):
            # One row per day: an older version may lie on another one.
            older = stored.join(arrived.select(*keys).distinct(), list(keys), "left_semi")
            touched |= {row[0] for row in older.select(day).distinct().collect()}
        old = stored.where(_on_days(day, sorted(touched, key=str))).select(*columns)
        rows = old.withColumn("_delivered", F.lit(0)).union(arrived)
    merged = _kept(_latest(rows, keys, version, columns), "merged-days")
    write_days(merged, path, day, only_these=True)
    left = {row[0] for row in merged.select(day).distinct().collect()}
    for emptied in touched - left:
        _drop_day(spark, path, day, emptied)
    return sorted(touched, key=str)


def replace_days(delivery: DataFrame, path: str) -> list[date | None]:
    """For logs whose rows have no key: a delivery holds all rows of its days and replaces them.

    Delivered again, it changes nothing. Returns the days.
    """
    dated, day = with_day(delivery)
    if day is None:
        raise ValueError("a log needs start_time or usage_date to be replaced by day")
    arrived = _kept(dated, "delivery")
    write_days(arrived, path, day, only_these=True)
    return sorted({row[0] for row in arrived.select(day).distinct().collect()}, key=str)


def _drop_day(spark: SparkSession, path: str, day: str, value: date | None) -> None:
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else value.isoformat()
    delete_path(spark, f"{path.rstrip('/')}/{day}={name}")
