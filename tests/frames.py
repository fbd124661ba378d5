"""Hand-made usage logs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from types import SimpleNamespace

from meterlight import schemas
from meterlight.views import UsageViews

NOON = dt.datetime(2024, 1, 6, 12)


def query(query_id, **changes):
    row = {
        "query_id": query_id,
        "user_name": "A",
        "warehouse_id": 1,
        "warehouse_name": "W1",
        "query_type": "SELECT",
        "execution_status": "SUCCESS",
        "error_code": None,
        "start_time": NOON,
        "total_elapsed_time": 1000,
        "compilation_time": 10,
        "credits_used_cloud_services": Decimal("0.5"),
        "bytes_scanned": 100,
        "bytes_spilled_to_local_storage": 0,
        "bytes_spilled_to_remote_storage": 0,
    }
    return row | changes


def entry(query_id, credits="1.0", **changes):
    row = {
        "query_id": query_id,
        "user_name": "A",
        "warehouse_name": "W1",
        "start_time": NOON,
        "credits_attributed_compute": None if credits is None else Decimal(credits),
    }
    return row | changes


def metering(service, day, credits):
    amount = None if credits is None else Decimal(credits)
    return {
        "service_type": service,
        "usage_date": dt.date.fromisoformat(day),
        "credits_used": amount,
        "credits_used_compute": amount,
        "credits_used_cloud_services": Decimal(0),
    }


def _frame(spark, rows, schema):
    return spark.createDataFrame([tuple(row[n] for n in schema.names) for row in rows], schema)


def views(spark, queries=(), entries=(), meter=(), ai=(), chats=(), snapshots=(), user=None):
    logs = SimpleNamespace(
        query_history=_frame(spark, queries, schemas.QUERY_HISTORY),
        attribution=_frame(spark, entries, schemas.ATTRIBUTION),
        metering=_frame(spark, meter, schemas.METERING),
        ai_functions=_frame(spark, ai, schemas.AI_FUNCTIONS),
        ai_analyst=_frame(spark, chats, schemas.AI_ANALYST),
        storage_snapshots=_frame(spark, snapshots, schemas.STORAGE_SNAPSHOTS),
    )
    logs.attribution_starts_with_query = False
    logs.attribution_credits = logs.attribution.select("query_id", "credits_attributed_compute")
    return UsageViews(logs, user=user)  # no user: the administrator


def rows(df):
    return [tuple(row) for row in df.collect()]
