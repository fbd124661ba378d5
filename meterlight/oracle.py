"""The same results as DuckDB SQL over the sample tables, to check against.

The usage logs are common table expressions; each text takes the ones it reads. Joins and
percentiles are written the plain way, row by row.
"""

from __future__ import annotations

from meterlight.fixed_values import LINK_BASE, LINK_END, LINK_MIDDLE, SERVICE_KPIS

MIB = 1048576

_LOGS = {
    "qh": f"""
        SELECT 'q-' || event_id AS query_id,
               'USER_' || user_id AS user_name,
               CAST(user_id % 5 AS BIGINT) AS warehouse_id,
               'WH_' || (user_id % 5) AS warehouse_name,
               CASE event_type WHEN 'click' THEN 'SELECT' WHEN 'view' THEN 'SHOW'
                    WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'MERGE'
                    ELSE 'UPDATE' END AS query_type,
               CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
               CASE WHEN event_type = 'error' THEN 'E' || (event_id % 7) END AS error_code,
               ts AS start_time,
               CAST(FLOOR(value * 1000) AS BIGINT) AS total_elapsed_time,
               CAST(event_id % 400 AS BIGINT) AS compilation_time,
               CASE WHEN event_id % 11 = 0 THEN NULL
                    ELSE CAST((event_id % 1000) * 0.000001 AS DECIMAL(18,9))
                    END AS credits_used_cloud_services,
               CAST((event_id % 1000) * {MIB} AS BIGINT) AS bytes_scanned,
               CAST(CASE WHEN user_id % 5 <> 4 AND event_id % 10 = 0
                    THEN (event_id % 50) * {MIB} ELSE 0 END AS BIGINT)
                    AS bytes_spilled_to_local_storage,
               CAST(CASE WHEN event_id % 40 = 0 OR (user_id % 5 = 0 AND event_id % 8 = 0)
                    THEN (event_id % 30) * {MIB} ELSE 0 END AS BIGINT)
                    AS bytes_spilled_to_remote_storage
        FROM events""",
    "qv": f"""
        SELECT *, '{LINK_BASE}' || 'ORG' || '/' || 'ACC' || '{LINK_MIDDLE}' || query_id
               || '{LINK_END}' AS query_id_url
        FROM qh""",
    "qa": """
        SELECT 'q-' || l_orderkey AS query_id,
               CASE WHEN e.user_id IS NOT NULL THEN 'USER_' || e.user_id END AS user_name,
               CASE WHEN e.user_id IS NOT NULL THEN 'WH_' || (e.user_id % 5) END
                 AS warehouse_name,
               e.ts AS start_time,
               CASE WHEN l_discount = 0 THEN NULL
                    ELSE CAST(l_quantity * 0.01 AS DECIMAL(18,9)) END
                 AS credits_attributed_compute
        FROM lineitem l LEFT JOIN events e ON l.l_orderkey = e.event_id""",
    "md": """
        SELECT service_type, usage_date, compute + cloud AS credits_used,
               compute AS credits_used_compute, cloud AS credits_used_cloud_services
        FROM (SELECT CASE l_suppkey % 9
                       WHEN 0 THEN 'WAREHOUSE_METERING' WHEN 1 THEN 'AI_SERVICES'
                       WHEN 2 THEN 'DATA_QUALITY_MONITORING' WHEN 3 THEN 'SERVERLESS_TASK'
                       WHEN 4 THEN 'COPY_FILES' WHEN 5 THEN 'AUTO_CLUSTERING'
                       WHEN 6 THEN 'TELEMETRY_DATA_INGEST' WHEN 7 THEN 'PIPE'
                       WHEN 8 THEN 'REPLICATION' END AS service_type,
                     CAST(l_shipdate AS DATE) AS usage_date,
                     CASE WHEN l_suppkey % 9 = 8 THEN NULL
                       ELSE CAST(l_quantity * 0.1 AS DECIMAL(18,9)) END AS compute,
                     CAST(l_tax AS DECIMAL(18,9)) AS cloud
              FROM lineitem)""",
    "al": """
        SELECT 'q-' || doc_id AS query_id,
               CAST(doc_id % 5 AS BIGINT) AS warehouse_id,
               CASE doc_id % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'SUMMARIZE'
                    WHEN 2 THEN 'TRANSLATE' END AS function_name,
               'model-' || lang AS model_name,
               CAST(n_chars AS BIGINT) AS tokens,
               CAST(n_chars * (1 + doc_id % 3) * 0.0001 AS DECIMAL(18,9)) AS token_credits
        FROM documents""",
    "ai": """
        SELECT qv.*, al.function_name, al.model_name, al.tokens, al.token_credits
        FROM qv JOIN al ON qv.query_id = al.query_id""",
    "an": """
        SELECT 'USER_' || e.user_id AS username, e.ts AS start_time,
               CAST(1 AS BIGINT) AS request_count,
               CAST((c.turn + 1) * 0.01 AS DECIMAL(18,9)) AS credits
        FROM conversations c JOIN events e ON c.conv_id = e.event_id
        WHERE c.role = 'user'""",
    "st": """
        SELECT source, CAST(e.ts AS DATE) AS snapshot_date, CAST(SUM(n_chars) AS BIGINT) AS bytes
        FROM documents d JOIN events e ON d.doc_id = e.event_id
        GROUP BY 1, 2""",
    "pq": """
        SELECT query_id, SUM(COALESCE(credits_attributed_compute, 0)) AS credits
        FROM qa GROUP BY query_id""",
    "fits": """
        SELECT service_type, slope, (sy - slope * sx) / n AS intercept
        FROM (SELECT *, (n * sxy - sx * sy) / NULLIF(n * sxx - sx * sx, 0) AS slope
              FROM (SELECT service_type, CAST(COUNT(*) AS DOUBLE) AS n,
                           CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(y) AS DOUBLE) AS sy,
                           CAST(SUM(x * y) AS DOUBLE) AS sxy, CAST(SUM(x * x) AS DOUBLE) AS sxx
                    FROM (SELECT service_type,
                                 DATEDIFF('day', DATE '1998-03-01', usage_date) AS x,
                                 CAST(SUM(credits_used) AS DECIMAL(27,9)) AS y
                          FROM md
                          WHERE usage_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'
                          GROUP BY service_type, usage_date)
                    WHERE y IS NOT NULL GROUP BY service_type))""",
    "projected": """
        SELECT service_type, ROUND(slope, 4) AS slope,
               ROUND(intercept + slope * 38.0::DOUBLE, 4) AS projected_credits
        FROM fits""",
    "rules": """
        SELECT 'RIGHT_SIZE' AS rule, warehouse_name AS subject,
               AVG(CASE WHEN bytes_spilled_to_remote_storage > 0 THEN 1.0::DOUBLE ELSE 0 END)
                 AS evidence
        FROM qh WHERE warehouse_name IS NOT NULL GROUP BY warehouse_name
        HAVING AVG(CASE WHEN bytes_spilled_to_remote_storage > 0 THEN 1.0::DOUBLE ELSE 0 END) > 0.05
        UNION ALL
        SELECT 'ERRORS', user_name,
               AVG(CASE WHEN execution_status <> 'SUCCESS' THEN 1.0::DOUBLE ELSE 0 END)
        FROM qh WHERE user_name IS NOT NULL GROUP BY user_name
        HAVING AVG(CASE WHEN execution_status <> 'SUCCESS' THEN 1.0::DOUBLE ELSE 0 END) > 0.25
        UNION ALL
        SELECT 'SPILL', query_id, CAST(bytes_spilled_to_remote_storage AS DOUBLE)
        FROM qh WHERE bytes_spilled_to_remote_storage >= 20 * 1048576 AND query_id IS NOT NULL""",
    "dearest": """
        SELECT qh.*, CAST(pq.credits AS DOUBLE) AS cost
        FROM qh JOIN pq ON qh.query_id = pq.query_id
        ORDER BY pq.credits DESC, qh.query_id LIMIT 20""",
}

# What each log is built from, in the order the expressions must appear.
_NEEDS = {
    "qv": ["qh"],
    "ai": ["qh", "qv", "al"],
    "pq": ["qa"],
    "fits": ["md"],
    "projected": ["md", "fits"],
    "rules": ["qh"],
    "dearest": ["qh", "qa", "pq"],
}


def _sql(logs: str, body: str) -> str:
    wanted: list[str] = []
    for log in logs.split():
        for name in [*_NEEDS.get(log, []), log]:
            if name not in wanted:
                wanted.append(name)
    return "WITH " + ",\n".join(f"{name} AS ({_LOGS[name]})" for name in wanted) + "\n" + body


def _plain(*columns: str) -> str:
    return ", ".join(f"CAST({column} AS DOUBLE) AS {column}" for column in columns)


_DAYS = "start_time >= DATE '2024-01-05' AND start_time <= DATE '2024-01-10'"
_MONTH = "usage_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'"
_LOCAL = "bytes_spilled_to_local_storage"
_REMOTE = "bytes_spilled_to_remote_storage"
_SPILLED = f"({_LOCAL} > 0 OR {_REMOTE} > 0)"
_QH_PLAIN = f"* REPLACE ({_plain('credits_used_cloud_services')})"
_QA_PLAIN = f"* REPLACE ({_plain('credits_attributed_compute')})"
_AN_PLAIN = f"* REPLACE ({_plain('credits')})"
_MD_PLAIN = "service_type, usage_date, " + _plain(
    "credits_used", "credits_used_compute", "credits_used_cloud_services"
)
_AI_PLAIN = f"* REPLACE ({_plain('credits_used_cloud_services', 'token_credits')})"
_CC = "COALESCE(credits_attributed_compute, 0)"

_HISTORY_DAYS = "CAST(hist.start_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'"
_FULL_DAYS = "CAST(start_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'"
_TREND_DAYS = "CAST(start_time AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'"
_FIRST_DAYS = "hist.start_time BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'"


def _overview(condition: str) -> str:
    return (
        "SELECT COUNT(DISTINCT hist.query_id) AS total_queries, "
        "CAST(ROUND(SUM(IFNULL(part.credits_attributed_compute, 0)), 3) AS DOUBLE) "
        "AS compute_credits, "
        "CAST(ROUND(SUM(IFNULL(hist.credits_used_cloud_services, 0)), 3) AS DOUBLE) AS cs_credits, "
        "ROUND(AVG(hist.total_elapsed_time) / 1000, 2) AS avg_execution_seconds "
        f"FROM qa AS part, qh AS hist WHERE part.query_id = hist.query_id AND {condition}"
    )


def _shown_overview(condition: str) -> str:
    return (
        "SELECT FORMAT('{:,}', total_queries) AS total_queries, "
        "FORMAT('{:,.3f}', compute_credits) AS compute_credits, "
        "FORMAT('{:,.3f}', cs_credits) AS cs_credits, "
        "FORMAT('{:,.2f}', avg_execution_seconds) AS avg_execution_seconds FROM ("
        f"{_overview(condition)})"
    )


def _kpis(days: str) -> str:
    figures = ", ".join(
        f"CAST(COALESCE(SUM(credits_used) FILTER (service_type = '{service}'), 0) AS DOUBLE)"
        f" AS {name}"
        for name, service in SERVICE_KPIS.items()
    )
    return (
        "SELECT CAST(COALESCE(SUM(credits_used), 0) AS DOUBLE) AS total_credits, "
        f"{figures} FROM md WHERE {days} HAVING COUNT(*) > 0"
    )


def _dearest_columns(more: str = "") -> str:
    return (
        f"SELECT query_id, user_name, warehouse_name, query_type, cost AS credits{more} FROM dearest"
    )


# Windows see the whole log; a range is cut from what they give.
_TREND = (
    "SELECT warehouse_name, usage_date, CAST(SUM(credits) OVER (PARTITION BY warehouse_name "
    "ORDER BY usage_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) "
    "AS credits_7d FROM (SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, "
    f"SUM({_CC}) AS credits FROM qa WHERE warehouse_name IS NOT NULL GROUP BY 1, 2)"
)
_COST_DAILY = (
    "SELECT usage_date, CAST(credits AS DOUBLE) AS credits, "
    "CAST(credits - LAG(credits) OVER (ORDER BY usage_date) AS DOUBLE) AS delta FROM ("
    "SELECT usage_date, SUM(credits_used) AS credits FROM md GROUP BY 1)"
)
_GROWTH = (
    "SELECT source, snapshot_date, bytes, LAG(bytes) OVER (PARTITION BY source "
    "ORDER BY snapshot_date NULLS LAST) AS previous_bytes FROM st"
)

ORACLE_SQL: dict[str, str] = {
    "scan_metering": _sql("md", f"SELECT {_MD_PLAIN} FROM md"),
    "stored_log_merged": _sql("qh", f"SELECT {_QH_PLAIN} FROM qh"),
    "scan_query_history": _sql("qh", f"SELECT {_QH_PLAIN} FROM qh"),
    "scan_attribution": _sql("qa", f"SELECT {_QA_PLAIN} FROM qa"),
    "scan_ai_functions": _sql("al", f"SELECT * REPLACE ({_plain('token_credits')}) FROM al"),
    "scan_ai_analyst": _sql("an", f"SELECT {_AN_PLAIN} FROM an"),
    "view_attribution": _sql("qa", f"SELECT {_QA_PLAIN} FROM qa"),
    "view_attribution_rls": _sql("qa", f"SELECT {_QA_PLAIN} FROM qa WHERE user_name = 'USER_3'"),
    "view_analyst": _sql("an", f"SELECT {_AN_PLAIN} FROM an"),
    "view_analyst_rls": _sql("an", f"SELECT {_AN_PLAIN} FROM an WHERE username = 'USER_3'"),
    "view_query_history": _sql("qv", f"SELECT {_QH_PLAIN} FROM qv"),
    "view_query_history_rls": _sql("qv", f"SELECT {_QH_PLAIN} FROM qv WHERE user_name = 'USER_3'"),
    "ai_query_view": _sql("ai", f"SELECT {_AI_PLAIN} FROM ai"),
    "ai_query_view_rls": _sql("ai", f"SELECT {_AI_PLAIN} FROM ai WHERE user_name = 'USER_3'"),
    "row_access": _sql(
        "qh", "SELECT query_id, user_name, start_time FROM qh WHERE user_name = 'USER_3'"
    ),
    "row_access_session": _sql(
        "qh", "SELECT query_id, start_time FROM qh WHERE user_name = 'USER_3'"
    ),
    "profile_url": _sql("qv", "SELECT query_id, query_id_url FROM qv"),
    "profile_url_prefix": _sql(
        "qh",
        "SELECT query_id, 'https://example.test/connection"
        f"{LINK_MIDDLE}' || query_id || '{LINK_END}' AS query_id_url FROM qh",
    ),
    "filter_date_range": _sql("md", f"SELECT {_MD_PLAIN} FROM md WHERE {_MONTH}"),
    "filter_ts_range": _sql("qh", f"SELECT query_id, user_name, start_time FROM qh WHERE {_DAYS}"),
    "filter_ts_whole_day": _sql(
        "qh",
        "SELECT query_id, user_name, start_time FROM qh "
        "WHERE CAST(start_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'",
    ),
    "default_range": _sql(
        "qh",
        "SELECT kind, start_date, end_date, CAST(DATEDIFF('day', start_date, end_date) + 1 "
        "AS BIGINT) AS days, (SELECT COUNT(*) FROM qh WHERE CAST(start_time AS DATE) "
        "BETWEEN start_date AND end_date) AS queries "
        "FROM (SELECT 'admin' AS kind, DATE '2024-01-10' - 7 AS start_date, "
        "DATE '2024-01-10' + 1 AS end_date "
        "UNION ALL SELECT 'user', DATE '2024-01-10' - 5, DATE '2024-01-10')",
    ),
    "join_history_attribution": _sql(
        "qh qa",
        "SELECT q.query_id, q.start_time, total_elapsed_time, "
        + _plain("credits_used_cloud_services", "credits_attributed_compute")
        + " FROM qh q JOIN qa ON q.query_id = qa.query_id",
    ),
    "count_distinct_queries": _sql(
        "qa", "SELECT COUNT(DISTINCT query_id) AS total_queries FROM qa"
    ),
    "sum_coalesce": _sql(
        "qh qa",
        f"SELECT CAST(SUM({_CC}) AS DOUBLE) AS compute_credits, "
        "CAST(SUM(COALESCE(credits_used_cloud_services, 0)) AS DOUBLE) AS cs_credits "
        "FROM qh q JOIN qa ON q.query_id = qa.query_id",
    ),
    "avg_elapsed": _sql(
        "qh qa",
        "SELECT AVG(total_elapsed_time) / 1000 AS avg_execution_seconds "
        "FROM qh q JOIN qa ON q.query_id = qa.query_id",
    ),
    "scalar_round": _sql(
        "qa",
        f"SELECT query_id, CAST(ROUND({_CC}, 3) AS DOUBLE) AS credits_3, "
        f"CAST(ROUND({_CC}, 2) AS DOUBLE) AS credits_2 FROM qa",
    ),
    "admin_overview": _sql(
        "md",
        "SELECT service_type, CAST(SUM(credits_used) AS DOUBLE) AS total_credits, "
        "CAST(SUM(credits_used_compute) AS DOUBLE) AS current_compute, "
        "CAST(SUM(credits_used_cloud_services) AS DOUBLE) AS current_cloud_services "
        f"FROM md WHERE {_MONTH} GROUP BY service_type "
        "ORDER BY total_credits DESC NULLS LAST, service_type",
    ),
    "service_kpis": _sql("md", _kpis(_MONTH)),
    "service_kpis_empty": _sql(
        "md", _kpis("usage_date BETWEEN DATE '2030-01-05' AND DATE '2030-01-10'")
    ),
    "format_kpis": _sql(
        "md",
        "SELECT "
        + ", ".join(
            f"FORMAT('{{:,.1f}}', {name}) AS {name}" for name in ["total_credits", *SERVICE_KPIS]
        )
        + f" FROM ({_kpis(_MONTH)})",
    ),
    "user_overview": _sql("qh qa", _overview(_FIRST_DAYS)),
    "user_overview_rls": _sql(
        "qh qa",
        _overview(f"{_FIRST_DAYS} AND hist.user_name = 'USER_3' AND part.user_name = 'USER_3'"),
    ),
    "user_overview_whole_day": _sql("qh qa", _overview(_HISTORY_DAYS)),
    "user_overview_empty": _sql(
        "qh qa", _overview("hist.start_time BETWEEN DATE '2030-01-05' AND DATE '2030-01-10'")
    ),
    "user_overview_sql": _sql("qh qa", _overview(_FIRST_DAYS)),
    "user_overview_sql_whole_day": _sql("qh qa", _overview(_HISTORY_DAYS)),
    "stored_user_overview": _sql("qh qa", _overview(_FIRST_DAYS)),
    "stored_user_overview_by_id": _sql(
        "qh qa",
        _overview(f"{_FIRST_DAYS} AND hist.user_name = 'USER_3' AND part.user_name = 'USER_3'"),
    ),
    "format_overview": _sql("qh qa", _shown_overview(_FIRST_DAYS)),
    "format_overview_whole_day": _sql("qh qa", _shown_overview(_HISTORY_DAYS)),
    "warehouse_daily": _sql(
        "qa",
        "SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, "
        f"CAST(SUM({_CC}) AS DOUBLE) AS credits FROM qa WHERE {_DAYS} GROUP BY 1, 2",
    ),
    "warehouse_daily_kept": _sql(
        "qa",
        "SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, "
        f"CAST(SUM({_CC}) AS DOUBLE) AS credits FROM qa WHERE {_DAYS} GROUP BY 1, 2",
    ),
    "distinct_queries_kept": _sql(
        "qh", f"SELECT COUNT(DISTINCT query_id) AS total_queries FROM qh WHERE {_TREND_DAYS}"
    ),
    "failing_users_kept": _sql(
        "qh",
        "SELECT error_code, warehouse_name, COUNT(DISTINCT user_name) AS users FROM qh "
        f"WHERE execution_status <> 'SUCCESS' AND {_TREND_DAYS} GROUP BY 1, 2",
    ),
    "spill_daily_kept": _sql(
        "qh",
        "SELECT CAST(start_time AS DATE) AS usage_date, COUNT(*) AS spilled_queries, "
        f"CAST(SUM({_LOCAL}) AS DOUBLE) AS bytes_local, "
        f"CAST(SUM({_REMOTE}) AS DOUBLE) AS bytes_remote "
        f"FROM qh WHERE {_SPILLED} AND {_TREND_DAYS} GROUP BY 1",
    ),
    "cost_daily_kept": _sql(
        "md",
        f"SELECT * FROM ({_COST_DAILY}) "
        "WHERE usage_date BETWEEN DATE '1998-03-05' AND DATE '1998-03-20'",
    ),
    "warehouse_hourly": _sql(
        "qa",
        "SELECT warehouse_name, HOUR(start_time) AS hour_of_day, "
        f"CAST(SUM({_CC}) AS DOUBLE) AS credits FROM qa "
        "WHERE warehouse_name IS NOT NULL GROUP BY 1, 2",
    ),
    "warehouse_trend": _sql("qa", _TREND),
    "warehouse_trend_range": _sql(
        "qa",
        f"SELECT * FROM ({_TREND}) "
        "WHERE usage_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'",
    ),
    "warehouse_efficiency": _sql(
        "qh",
        "SELECT warehouse_name, COUNT(*) AS queries, AVG(total_elapsed_time) AS avg_elapsed_ms, "
        "CAST(SUM(bytes_scanned) AS DOUBLE) AS bytes_scanned FROM qh GROUP BY 1",
    ),
    "success_rate": _sql(
        "qh",
        "SELECT warehouse_name, AVG(CASE WHEN execution_status = 'SUCCESS' THEN 1.0::DOUBLE "
        "ELSE 0 END) AS success_rate FROM qh GROUP BY 1",
    ),
    "cost_per_query": _sql(
        "qh pq",
        "SELECT warehouse_name, COUNT(DISTINCT q.query_id) AS queries, "
        "CAST(SUM(credits) AS DOUBLE) AS credits, "
        "CAST(SUM(credits) AS DOUBLE) / NULLIF(COUNT(DISTINCT q.query_id), 0) "
        "AS credits_per_query FROM qh q JOIN pq ON q.query_id = pq.query_id GROUP BY 1",
    ),
    "right_sizing": _sql(
        "qh",
        "SELECT *, CASE WHEN remote_spill_share > 0.05 THEN 'SIZE_UP' "
        "WHEN local_spill_share < 0.01 THEN 'SIZE_DOWN' ELSE 'KEEP' END AS action FROM ("
        f"SELECT warehouse_name, AVG(CASE WHEN {_REMOTE} > 0 THEN 1.0::DOUBLE ELSE 0 END) "
        f"AS remote_spill_share, AVG(CASE WHEN {_LOCAL} > 0 THEN 1.0::DOUBLE ELSE 0 END) "
        "AS local_spill_share FROM qh GROUP BY 1)",
    ),
    "ai_by_function": _sql(
        "ai",
        "SELECT function_name, model_name, COUNT(*) AS calls, "
        "CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(token_credits) AS DOUBLE) AS credits "
        "FROM ai GROUP BY 1, 2",
    ),
    "ai_by_function_range": _sql(
        "ai",
        "SELECT function_name, model_name, COUNT(*) AS calls, "
        "CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(token_credits) AS DOUBLE) AS credits "
        f"FROM ai WHERE {_DAYS} GROUP BY 1, 2",
    ),
    "ai_daily_range": _sql(
        "ai",
        "SELECT CAST(start_time AS DATE) AS usage_date, CAST(SUM(tokens) AS BIGINT) AS tokens, "
        f"CAST(SUM(token_credits) AS DOUBLE) AS credits FROM ai WHERE {_FULL_DAYS} GROUP BY 1",
    ),
    "ai_daily": _sql(
        "ai",
        "SELECT CAST(start_time AS DATE) AS usage_date, CAST(SUM(tokens) AS BIGINT) AS tokens, "
        "CAST(SUM(token_credits) AS DOUBLE) AS credits FROM ai GROUP BY 1",
    ),
    "analyst_daily": _sql(
        "an",
        "SELECT username, CAST(start_time AS DATE) AS usage_date, "
        "CAST(SUM(request_count) AS BIGINT) AS requests, CAST(SUM(credits) AS DOUBLE) AS credits "
        "FROM an GROUP BY 1, 2",
    ),
    "ai_model_cost": _sql(
        "al",
        "SELECT model_name, CAST(SUM(token_credits) AS DOUBLE) * 1e6 / NULLIF(SUM(tokens), 0) "
        "AS credits_per_million_tokens FROM al GROUP BY 1",
    ),
    "ai_query_details": _sql(
        "ai",
        "SELECT query_id, user_name, function_name, model_name, tokens, "
        "CAST(token_credits AS DOUBLE) AS credits, total_elapsed_time, query_id_url FROM ai",
    ),
    "ai_function_perf": _sql(
        "ai",
        "SELECT function_name, AVG(total_elapsed_time) AS avg_elapsed_ms, "
        "ROUND(QUANTILE_CONT(total_elapsed_time, 0.95), 4) AS p95_elapsed_ms FROM ai GROUP BY 1",
    ),
    "spill_queries": _sql(
        "qh",
        f"SELECT query_id, {_LOCAL} AS bytes_local, {_REMOTE} AS bytes_remote "
        f"FROM qh WHERE {_SPILLED}",
    ),
    "spill_by_warehouse": _sql(
        "qh",
        f"SELECT warehouse_name, COUNT(*) AS queries, CAST(SUM({_LOCAL}) AS DOUBLE) "
        f"AS bytes_local, CAST(SUM({_REMOTE}) AS DOUBLE) AS bytes_remote "
        f"FROM qh WHERE {_SPILLED} GROUP BY 1",
    ),
    "spill_impact": _sql(
        "qh",
        f"SELECT {_SPILLED} AS spilled, COUNT(*) AS queries, "
        "AVG(total_elapsed_time) AS avg_elapsed_ms FROM qh GROUP BY 1",
    ),
    "spill_daily": _sql(
        "qh",
        "SELECT CAST(start_time AS DATE) AS usage_date, COUNT(*) AS spilled_queries, "
        f"CAST(SUM({_LOCAL}) AS DOUBLE) AS bytes_local, "
        f"CAST(SUM({_REMOTE}) AS DOUBLE) AS bytes_remote "
        f"FROM qh WHERE {_SPILLED} GROUP BY 1",
    ),
    "query_details": _sql("qv", f"SELECT {_QH_PLAIN} FROM qv WHERE {_DAYS}"),
    "error_tracking": _sql(
        "qh",
        "SELECT error_code, warehouse_name, COUNT(*) AS queries, "
        "COUNT(DISTINCT user_name) AS users FROM qh "
        "WHERE execution_status <> 'SUCCESS' GROUP BY 1, 2",
    ),
    "top_queries": _sql("dearest", _dearest_columns()),
    "top_queries_all": _sql(
        "pq al",
        "SELECT query_id, kind, CAST(credits AS DOUBLE) AS credits FROM ("
        "SELECT query_id, 'WAREHOUSE' AS kind, CAST(credits AS DECIMAL(38,9)) AS credits FROM pq "
        "UNION ALL SELECT query_id, 'AI', CAST(SUM(token_credits) AS DECIMAL(38,9)) "
        "FROM al GROUP BY query_id) ORDER BY credits DESC NULLS LAST, query_id, kind LIMIT 25",
    ),
    "top_query_resources": _sql(
        "dearest",
        _dearest_columns(
            f", bytes_scanned, {_LOCAL} AS bytes_local, {_REMOTE} AS bytes_remote, "
            "total_elapsed_time"
        ),
    ),
    "cloud_services_by_type": _sql(
        "qh",
        "SELECT query_type, CAST(SUM(COALESCE(credits_used_cloud_services, 0)) AS DOUBLE) "
        "AS cloud_credits FROM qh GROUP BY 1",
    ),
    "compilation_share": _sql(
        "qh",
        "SELECT query_type, AVG(compilation_time) AS avg_compilation_ms, "
        "CAST(SUM(compilation_time) AS DOUBLE) / NULLIF(SUM(total_elapsed_time), 0) "
        "AS compilation_share FROM qh GROUP BY 1",
    ),
    "scan_patterns": _sql(
        "qh",
        "SELECT user_name, CAST(SUM(bytes_scanned) AS DOUBLE) AS total_bytes, "
        "AVG(bytes_scanned) AS avg_bytes, MAX(bytes_scanned) AS max_bytes FROM qh GROUP BY 1",
    ),
    "large_queries": _sql(
        "qh",
        "SELECT query_id, user_name, warehouse_name, bytes_scanned FROM qh WHERE bytes_scanned "
        ">= (SELECT ROUND(QUANTILE_CONT(bytes_scanned, 0.95), 4) FROM qh)",
    ),
    "failure_rollup": _sql(
        "qh",
        "SELECT warehouse_name, query_type, "
        "CAST(GROUPING(warehouse_name, query_type) AS BIGINT) AS level, COUNT(*) AS queries, "
        "AVG(CASE WHEN execution_status <> 'SUCCESS' THEN 1.0::DOUBLE ELSE 0 END) "
        "AS failure_rate FROM qh GROUP BY ROLLUP (warehouse_name, query_type)",
    ),
    "cost_daily": _sql("md", f"SELECT * FROM ({_COST_DAILY}) WHERE {_MONTH}"),
    "cost_daily_range": _sql(
        "md",
        f"SELECT * FROM ({_COST_DAILY}) "
        "WHERE usage_date BETWEEN DATE '1998-03-05' AND DATE '1998-03-20'",
    ),
    "cost_by_category": _sql(
        "md",
        "SELECT service_type, CAST(spent AS DOUBLE) AS credits, "
        "CAST(spent AS DOUBLE) / NULLIF(CAST(SUM(spent) OVER () AS DOUBLE), 0) AS share FROM ("
        "SELECT service_type, SUM(credits_used) AS spent FROM md GROUP BY 1)",
    ),
    "cost_cumulative": _sql(
        "md",
        "SELECT usage_date, CAST(SUM(credits) OVER (ORDER BY usage_date ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS credits_to_date FROM ("
        f"SELECT usage_date, SUM(credits_used) AS credits FROM md WHERE {_MONTH} GROUP BY 1)",
    ),
    "top_users": _sql(
        "qa",
        "SELECT user_name, CAST(spent AS DOUBLE) AS credits, spending_rank FROM ("
        "SELECT *, RANK() OVER (ORDER BY spent DESC) AS spending_rank FROM ("
        f"SELECT user_name, SUM({_CC}) AS spent FROM qa WHERE user_name IS NOT NULL GROUP BY 1)) "
        "WHERE spending_rank <= 10",
    ),
    "user_efficiency": _sql(
        "qh pq",
        "SELECT user_name, COUNT(*) AS queries, "
        "CAST(SUM(COALESCE(credits, 0)) AS DOUBLE) / COUNT(*) AS credits_per_query, "
        "AVG(total_elapsed_time) AS avg_elapsed_ms, "
        "AVG(CASE WHEN execution_status = 'SUCCESS' THEN 1.0::DOUBLE ELSE 0 END) AS success_rate "
        "FROM qh q LEFT JOIN pq ON q.query_id = pq.query_id GROUP BY 1",
    ),
    "user_activity": _sql(
        "qh",
        "SELECT user_name, EXTRACT(ISODOW FROM start_time) AS weekday, "
        "HOUR(start_time) AS hour_of_day, COUNT(*) AS queries FROM qh GROUP BY 1, 2, 3",
    ),
    "storage_growth": _sql("st", _GROWTH),
    "storage_growth_range": _sql(
        "st",
        f"SELECT * FROM ({_GROWTH}) "
        "WHERE snapshot_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'",
    ),
    "cost_forecast": _sql("projected", "SELECT * FROM projected"),
    "cost_trend": _sql(
        "fits",
        "SELECT service_type, ROUND(slope, 4) AS slope, CASE WHEN slope > 0.01 THEN 'UP' "
        "WHEN slope < -0.01 THEN 'DOWN' ELSE 'FLAT' END AS trend FROM fits",
    ),
    "budget_scenarios": _sql(
        "projected",
        "SELECT scenario, factor, total AS projected_credits, ROUND(total * factor, 4) "
        "AS budget_credits FROM (SELECT CAST(SUM(CAST(projected_credits AS DECIMAL(25,4))) "
        "AS DOUBLE) AS total FROM projected), (VALUES ('LOW', 0.8::DOUBLE), "
        "('BASE', 1.0::DOUBLE), ('HIGH', 1.2::DOUBLE)) AS cases(scenario, factor)",
    ),
    "recommendations": _sql("rules", "SELECT rule, subject, evidence FROM rules"),
    "recommendation_plan": _sql(
        "rules",
        "SELECT CAST(CASE rule WHEN 'RIGHT_SIZE' THEN 1 WHEN 'ERRORS' THEN 2 ELSE 3 END AS BIGINT) "
        "AS step, CASE rule WHEN 'RIGHT_SIZE' THEN 'LOW' WHEN 'ERRORS' THEN 'MEDIUM' "
        "ELSE 'HIGH' END AS effort, rule, ROW_NUMBER() OVER (PARTITION BY rule "
        "ORDER BY evidence DESC, subject) AS position, subject, evidence FROM rules",
    ),
    "potential_savings": _sql(
        "qh pq",
        "SELECT rule, CAST(spent AS DOUBLE) AS credits, ROUND(CAST(spent AS DOUBLE) * fraction, 4) "
        "AS saved_credits FROM ("
        "SELECT 'ERRORS' AS rule, 0.5::DOUBLE AS fraction, SUM(credits) AS spent "
        "FROM qh q JOIN pq ON q.query_id = pq.query_id WHERE execution_status <> 'SUCCESS' "
        "UNION ALL SELECT 'SPILL', 0.2::DOUBLE, SUM(credits) "
        f"FROM qh q JOIN pq ON q.query_id = pq.query_id WHERE {_SPILLED})",
    ),
    "export_roundtrip": _sql(
        "qa",
        "SELECT warehouse_name, usage_date, credits, file_format FROM ("
        "SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, "
        f"CAST(SUM({_CC}) AS DOUBLE) AS credits FROM qa GROUP BY 1, 2), "
        "(VALUES ('parquet'), ('csv')) AS formats(file_format)",
    ),
}

# The same rows, asked for in another way.
ORACLE_SQL |= {
    "sql_user_overview": ORACLE_SQL["user_overview_rls"],
    "sql_user_overview_whole_day": ORACLE_SQL["user_overview_whole_day"],
    "sql_admin_overview": ORACLE_SQL["admin_overview"],
    "sql_warehouse_daily": ORACLE_SQL["warehouse_daily"],
    "sql_spill_daily": ORACLE_SQL["spill_daily_kept"],
    "export_verified": _sql(
        "qa",
        "SELECT warehouse_name, CAST(start_time AS DATE) AS usage_date, "
        f"CAST(SUM({_CC}) AS DOUBLE) AS credits FROM qa GROUP BY 1, 2",
    ),
    "profile_url_session": _sql(
        "qh",
        f"SELECT query_id, '{LINK_BASE}' || 'SESSION_ORG' || '/' || 'SESSION_ACC' "
        f"|| '{LINK_MIDDLE}' || query_id || '{LINK_END}' AS query_id_url FROM qh",
    ),
}
