"""Declared schemas of the usage logs, and the check every load goes through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CREDITS = T.DecimalType(18, 9)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


QUERY_HISTORY = _struct(
    ("query_id", T.StringType()),
    ("user_name", T.StringType()),
    ("warehouse_id", T.LongType()),
    ("warehouse_name", T.StringType()),
    ("query_type", T.StringType()),
    ("execution_status", T.StringType()),
    ("error_code", T.StringType()),
    ("start_time", T.TimestampNTZType()),
    ("total_elapsed_time", T.LongType()),
    ("compilation_time", T.LongType()),
    ("credits_used_cloud_services", CREDITS),
    ("bytes_scanned", T.LongType()),
    ("bytes_spilled_to_local_storage", T.LongType()),
    ("bytes_spilled_to_remote_storage", T.LongType()),
)

ATTRIBUTION = _struct(
    ("query_id", T.StringType()),
    ("user_name", T.StringType()),
    ("warehouse_name", T.StringType()),
    ("start_time", T.TimestampNTZType()),
    ("credits_attributed_compute", CREDITS),
)

METERING = _struct(
    ("service_type", T.StringType()),
    ("usage_date", T.DateType()),
    ("credits_used", T.DecimalType(19, 9)),
    ("credits_used_compute", CREDITS),
    ("credits_used_cloud_services", CREDITS),
)

AI_FUNCTIONS = _struct(
    ("query_id", T.StringType()),
    ("warehouse_id", T.LongType()),
    ("function_name", T.StringType()),
    ("model_name", T.StringType()),
    ("tokens", T.LongType()),
    ("token_credits", CREDITS),
)

AI_ANALYST = _struct(
    ("username", T.StringType()),
    ("start_time", T.TimestampNTZType()),
    ("request_count", T.LongType()),
    ("credits", CREDITS),
)

STORAGE_SNAPSHOTS = _struct(
    ("source", T.StringType()),
    ("snapshot_date", T.DateType()),
    ("bytes", T.LongType()),
)


def conform(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Declared columns first, in the declared types; further columns pass through."""
    missing = [field.name for field in schema if field.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    found = {field.name: field.dataType for field in df.schema}
    declared = [
        field.name
        if found[field.name] == field.dataType
        else F.col(field.name).cast(field.dataType).alias(field.name)
        for field in schema
    ]
    extra = [column for column in df.columns if column not in schema.names]
    if df.columns == [*schema.names, *extra] and all(isinstance(c, str) for c in declared):
        return df
    return df.select(*declared, *extra)
