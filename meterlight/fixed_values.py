"""Results must carry exactly these, so they are stated as plain text."""

# Query profile link: base, organisation, "/", account, middle, query id, end.
LINK_BASE = "https://app.snowflake.com/"
LINK_MIDDLE = "/#/compute/history/queries/"
LINK_END = "/profile"

# Key figures of the account overview: output column -> service type, in display order.
SERVICE_KPIS = {
    "warehouse_credits": "WAREHOUSE_METERING",
    "data_quality_credits": "DATA_QUALITY_MONITORING",
    "ai_credits": "AI_SERVICES",
    "serverless_task_credits": "SERVERLESS_TASK",
    "copy_files_credits": "COPY_FILES",
    "auto_clustering_credits": "AUTO_CLUSTERING",
    "telemetry_credits": "TELEMETRY_DATA_INGEST",
}

# Default date windows: days added to today for (start, end).
DEFAULT_WINDOWS = {"admin": (-7, 1), "user": (-5, 0)}

# Decimal places of the displayed key figures.
ADMIN_PLACES = 1
USER_PLACES = {
    "total_queries": 0,
    "compute_credits": 3,
    "cs_credits": 3,
    "avg_execution_seconds": 2,
}
