"""Usage logs derived from the sample tables (events, lineitem, documents, conversations)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from meterlight import schemas

# Fixed values of the sample mapping.
QUERY_TYPES = {"click": "SELECT", "view": "SHOW", "purchase": "INSERT", "signup": "MERGE"}
OTHER_QUERY_TYPE = "UPDATE"
SERVICES = (
    "WAREHOUSE_METERING",
    "AI_SERVICES",
    "DATA_QUALITY_MONITORING",
    "SERVERLESS_TASK",
    "COPY_FILES",
    "AUTO_CLUSTERING",
    "TELEMETRY_DATA_INGEST",
    "PIPE",
    "REPLICATION",
)
UNMETERED_SERVICE = 8
AI_FUNCTION_NAMES = ("COMPLETE", "SUMMARIZE", "TRANSLATE")
MIB = 1024 * 1024

_USER_NAME = "concat('USER_', user_id)"
_WAREHOUSE_NAME = "concat('WH_', user_id % 5)"
_ATTRIBUTED = "if(l_discount = 0, NULL, CAST(l_quantity * 0.01D AS DECIMAL(18,9)))"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _names_by_number(number: str, names: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN {place} THEN '{name}'" for place, name in enumerate(names))
    return f"CASE {number} {cases} END"


def _query_type() -> str:
    cases = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in QUERY_TYPES.items())
    return f"CASE event_type {cases} ELSE '{OTHER_QUERY_TYPE}' END"


def load_query_history(spark: SparkSession, folder: str) -> DataFrame:
    spills_locally = "user_id % 5 <> 4 AND event_id % 10 = 0"
    spills_remotely = "event_id % 40 = 0 OR (user_id % 5 = 0 AND event_id % 8 = 0)"
    frame = _table(spark, folder, "events").selectExpr(
        "concat('q-', event_id) AS query_id",
        f"{_USER_NAME} AS user_name",
        "user_id % 5 AS warehouse_id",
        f"{_WAREHOUSE_NAME} AS warehouse_name",
        f"{_query_type()} AS query_type",
        "if(event_type = 'error', 'FAIL', 'SUCCESS') AS execution_status",
        "if(event_type = 'error', concat('E', event_id % 7), NULL) AS error_code",
        "ts AS start_time",
        "CAST(floor(value * 1000) AS BIGINT) AS total_elapsed_time",
        "event_id % 400 AS compilation_time",
        "if(event_id % 11 = 0, NULL, CAST((event_id % 1000) * 0.000001 AS DECIMAL(18,9)))"
        " AS credits_used_cloud_services",
        f"(event_id % 1000) * {MIB} AS bytes_scanned",
        f"if({spills_locally}, (event_id % 50) * {MIB}, 0) AS bytes_spilled_to_local_storage",
        f"if({spills_remotely}, (event_id % 30) * {MIB}, 0) AS bytes_spilled_to_remote_storage",
    )
    return schemas.conform(frame, schemas.QUERY_HISTORY, "query_history")


def load_attribution(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").select("event_id", "user_id", "ts")
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    frame = lines.join(events, lines.l_orderkey == events.event_id, "left").selectExpr(
        "concat('q-', l_orderkey) AS query_id",
        f"{_USER_NAME} AS user_name",
        f"{_WAREHOUSE_NAME} AS warehouse_name",
        "ts AS start_time",
        f"{_ATTRIBUTED} AS credits_attributed_compute",
    )
    return schemas.conform(frame, schemas.ATTRIBUTION, "attribution")


def load_attribution_credits(spark: SparkSession, folder: str) -> DataFrame:
    """The attribution log without who, where and when.

    A line has at most one session (an event id names one event), so leaving the session columns
    out leaves out the join that only they need.
    """
    return _table(spark, folder, "lineitem").selectExpr(
        "concat('q-', l_orderkey) AS query_id", f"{_ATTRIBUTED} AS credits_attributed_compute"
    )


def load_metering(spark: SparkSession, folder: str) -> DataFrame:
    service = f"l_suppkey % {len(SERVICES)}"
    compute = (
        f"if({service} = {UNMETERED_SERVICE}, NULL, CAST(l_quantity * 0.1D AS DECIMAL(18,9)))"
    )
    cloud = "CAST(l_tax AS DECIMAL(18,9))"
    frame = _table(spark, folder, "lineitem").selectExpr(
        f"{_names_by_number(service, SERVICES)} AS service_type",
        "CAST(l_shipdate AS DATE) AS usage_date",
        f"{compute} + {cloud} AS credits_used",
        f"{compute} AS credits_used_compute",
        f"{cloud} AS credits_used_cloud_services",
    )
    return schemas.conform(frame, schemas.METERING, "metering")


def load_ai_functions(spark: SparkSession, folder: str) -> DataFrame:
    function = f"doc_id % {len(AI_FUNCTION_NAMES)}"
    frame = _table(spark, folder, "documents").selectExpr(
        "concat('q-', doc_id) AS query_id",
        "doc_id % 5 AS warehouse_id",
        f"{_names_by_number(function, AI_FUNCTION_NAMES)} AS function_name",
        "concat('model-', lang) AS model_name",
        "n_chars AS tokens",
        f"CAST(n_chars * (1 + {function}) * 0.0001 AS DECIMAL(18,9)) AS token_credits",
    )
    return schemas.conform(frame, schemas.AI_FUNCTIONS, "ai_functions")


def load_ai_analyst(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").select("event_id", "user_id", "ts")
    asked = _table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn")
    frame = asked.join(events, asked.conv_id == events.event_id).selectExpr(
        f"{_USER_NAME} AS username",
        "ts AS start_time",
        "1L AS request_count",
        "CAST((turn + 1) * 0.01 AS DECIMAL(18,9)) AS credits",
    )
    return schemas.conform(frame, schemas.AI_ANALYST, "ai_analyst")


def load_storage_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").select("event_id", "ts")
    stored = _table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    daily = stored.join(events, stored.doc_id == events.event_id).selectExpr(
        "source", "CAST(ts AS DATE) AS snapshot_date", "n_chars"
    )
    frame = daily.groupBy("source", "snapshot_date").agg({"n_chars": "sum"}).toDF(
        "source", "snapshot_date", "bytes"
    )
    return schemas.conform(frame, schemas.STORAGE_SNAPSHOTS, "storage_snapshots")


class SampleLogs:
    """The usage logs of one sample folder, with the same attributes as ``StoredLogs``."""

    # The sample finds an attribution row's start by a join, which would cost more than it saves.
    attribution_starts_with_query = False

    def __init__(self, spark: SparkSession, folder: str):
        self._at = (spark, folder)

    def has(self, name: str) -> bool:
        return True

    @cached_property
    def query_history(self) -> DataFrame:
        return load_query_history(*self._at)

    @cached_property
    def attribution(self) -> DataFrame:
        return load_attribution(*self._at)

    @cached_property
    def attribution_credits(self) -> DataFrame:
        return load_attribution_credits(*self._at)

    @cached_property
    def metering(self) -> DataFrame:
        return load_metering(*self._at)

    @cached_property
    def ai_functions(self) -> DataFrame:
        return load_ai_functions(*self._at)

    @cached_property
    def ai_analyst(self) -> DataFrame:
        return load_ai_analyst(*self._at)

    @cached_property
    def storage_snapshots(self) -> DataFrame:
        return load_storage_snapshots(*self._at)
