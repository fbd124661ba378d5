"""Governed results as SQL table functions with date parameters, in the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterlight.sources.logs import DAY_COLUMN
from meterlight.views import UsageViews

_RULES = "end_rule IN ('midnight', 'whole_day')"
_IN_RANGE = """start_time >= from_date AND CASE end_rule WHEN 'midnight' THEN start_time <= to_date
           ELSE start_time < DATE_ADD(to_date, 1) END"""
# A row that exists only to fail: bad arguments raise, whatever the logs hold.
_CHECKED = """{body}
  UNION ALL
  SELECT {nulls} WHERE NOT IF(from_date <= to_date AND {rules}, TRUE,
    RAISE_ERROR('a range needs a start and an end, in this order, and a known end rule'))
"""
_RANGED = "from_date DATE, to_date DATE, end_rule STRING DEFAULT 'midnight'"
_DATED = "from_date DATE, to_date DATE"

_USER_OVERVIEW = """
  WITH ranged AS (SELECT * FROM {queries} WHERE {in_range}),
  history AS (
    SELECT query_id, COUNT(*) AS entries,
           CAST(SUM(COALESCE(credits_used_cloud_services, 0)) AS DECIMAL(25, 9)) AS cloud,
           CAST(SUM(CAST(total_elapsed_time AS DECIMAL(20, 0))) AS DECIMAL(25, 0)) AS elapsed,
           COUNT(total_elapsed_time) AS timed
    FROM ranged GROUP BY query_id
  ),
  credits AS (
    SELECT query_id, COUNT(*) AS entries,
           CAST(SUM(COALESCE(credits_attributed_compute, 0)) AS DECIMAL(25, 9)) AS compute
    FROM {attribution} LEFT SEMI JOIN ranged USING (query_id)
    GROUP BY query_id
  )
  SELECT COUNT(*) AS total_queries,
         CAST(ROUND(SUM(CAST(h.entries AS DECIMAL(12, 0)) * c.compute), 3) AS DOUBLE),
         CAST(ROUND(SUM(CAST(c.entries AS DECIMAL(12, 0)) * h.cloud), 3) AS DOUBLE),
         ROUND(CAST(SUM(CAST(c.entries AS DECIMAL(12, 0)) * h.elapsed) AS DOUBLE)
           / NULLIF(CAST(SUM(c.entries * h.timed) AS DOUBLE), 0) / 1000, 2)
  FROM history h JOIN credits c ON h.query_id = c.query_id
"""

_WAREHOUSE_DAILY = """
  SELECT warehouse_name, CAST(start_time AS DATE),
         CAST(SUM(COALESCE(credits_attributed_compute, 0)) AS DOUBLE)
  FROM {attribution} WHERE {attribution_in_range}
  GROUP BY warehouse_name, CAST(start_time AS DATE)
"""

_SPILL_DAILY = """
  SELECT CAST(start_time AS DATE), COUNT(*),
         CAST(SUM(CAST(bytes_spilled_to_local_storage AS DECIMAL(20, 0))) AS DOUBLE),
         CAST(SUM(CAST(bytes_spilled_to_remote_storage AS DECIMAL(20, 0))) AS DOUBLE)
  FROM {queries}
  WHERE {in_range} AND (bytes_spilled_to_local_storage > 0 OR bytes_spilled_to_remote_storage > 0)
  GROUP BY CAST(start_time AS DATE)
"""

_ADMIN_OVERVIEW = """
  SELECT service_type, CAST(SUM(credits_used) AS DOUBLE), CAST(SUM(credits_used_compute) AS DOUBLE),
         CAST(SUM(credits_used_cloud_services) AS DOUBLE)
  FROM {metering} WHERE usage_date BETWEEN from_date AND to_date
  GROUP BY service_type
"""

# Parameters, columns and body of each function.
_FUNCTIONS = {
    "user_overview": (
        _RANGED,
        "total_queries BIGINT, compute_credits DOUBLE, cs_credits DOUBLE, avg_execution_seconds DOUBLE",
        _USER_OVERVIEW,
    ),
    "warehouse_daily": (
        _RANGED, "warehouse_name STRING, usage_date DATE, credits DOUBLE", _WAREHOUSE_DAILY
    ),
    "spill_daily": (
        _RANGED,
        "usage_date DATE, spilled_queries BIGINT, bytes_local DOUBLE, bytes_remote DOUBLE",
        _SPILL_DAILY,
    ),
}
_ACCOUNT_FUNCTIONS = {
    "admin_overview": (
        _DATED,
        "service_type STRING, total_credits DOUBLE, current_compute DOUBLE, "
        "current_cloud_services DOUBLE",
        _ADMIN_OVERVIEW,
    ),
}


def _in_range(frame: DataFrame) -> str:
    """The range on ``start_time``, and on the folders' day where the log is stored by day."""
    days = f"{DAY_COLUMN} BETWEEN from_date AND to_date AND " if DAY_COLUMN in frame.columns else ""
    return days + _IN_RANGE


def register_functions(views: UsageViews, prefix: str = "") -> list[str]:
    """Temporary table functions over the governed views; their names are returned.

    ``SELECT * FROM user_overview(DATE'2024-01-05', DATE'2024-01-10', end_rule => 'whole_day')``
    gives what the function of that name gives for the views' caller; likewise ``warehouse_daily``,
    ``spill_daily`` and, for the administrator only, ``admin_overview`` (without an order). Dates
    become literals of the plan: they reach the scan, and logs stored by day are read for their days
    only. Missing or reversed dates and unknown end rules make the query fail. Views that have a
    range already raise ``ValueError``. The frames beneath are temporary views, ``<prefix>_..._by_day``.
    """
    frames = views.frames_by_day()
    names = {name: f"{prefix}_{name}_by_day" for name in frames}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(names[name])
    spark = frames["queries"].sparkSession
    functions = _FUNCTIONS | (_ACCOUNT_FUNCTIONS if "metering" in frames else {})
    for name, (parameters, columns, body) in functions.items():
        text = body.format(
            **names,
            in_range=_in_range(frames["queries"]),
            attribution_in_range=_in_range(frames["attribution"]),
        )
        rules = _RULES if "end_rule" in parameters else "TRUE"
        nulls = ", ".join(["NULL"] * (columns.count(",") + 1))
        text = _CHECKED.format(body=text, nulls=nulls, rules=rules)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) "
            f"RETURNS TABLE ({columns}) RETURN {text}"
        )
    return [prefix + name for name in functions]
