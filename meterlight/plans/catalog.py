"""Every result by name, over the sample tables with the fixed test parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlight.functions.dates import WHOLE_DAY, in_date_range, in_ts_range
from meterlight.functions.links import declare_account, profile_url
from meterlight.operators.governance import ADMINISTRATOR, row_access
from meterlight.plans import accounts, ai, overview, pieces, planning, queries, warehouse
from meterlight.plans.by_day import DailyState, DistinctDays, failing_users, query_ids
from meterlight.plans.export import FORMATS, export_result, read_export
from meterlight.plans.pieces import plain_credits
from meterlight.plans.sql_functions import register_functions
from meterlight.session import new_shared_path
from meterlight.sources import sample
from meterlight.sources.deliveries import merge_log
from meterlight.sources.logs import StoredLogs, store_log
from meterlight.views import UsageViews

Query = Callable[[SparkSession, str], DataFrame]

DAYS = ("2024-01-05", "2024-01-10")
NO_DAYS = ("2030-01-05", "2030-01-10")
MONTH = ("1998-03-01", "1998-03-31")
PART_OF_MONTH = ("1998-03-05", "1998-03-20")
TREND_DAYS = ("2024-01-10", "2024-01-20")
SNAPSHOT_DAYS = ("2024-01-02", "2024-01-03")
LINK_PREFIX = "https://example.test/connection"
USER = "USER_3"
TODAY = "2024-01-10"
HORIZON = 38


@dataclass(frozen=True)
class Analysis:
    """A function of the views, and what it is called with."""

    result: Callable[..., DataFrame]
    args: tuple = ()
    options: Mapping[str, object] = field(default_factory=dict)

    def query(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.result(_views(spark, folder), *self.args, **self.options)


def _views(spark: SparkSession, folder: str) -> UsageViews:
    return UsageViews(sample.SampleLogs(spark, folder), user=ADMINISTRATOR)


def _load(loader: Query) -> Query:
    return lambda spark, folder: plain_credits(loader(spark, folder))


def _view(name: str, user: str | None = None) -> Query:
    return lambda spark, folder: plain_credits(
        getattr(_views(spark, folder).scoped(user=user), name)
    )


def _query_ids(spark: SparkSession, folder: str) -> DataFrame:
    return sample.load_query_history(spark, folder).select("query_id", "user_name", "start_time")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return _views(spark, folder).queries.select("query_id", "query_id_url")


def _row_access(spark: SparkSession, folder: str) -> DataFrame:
    return row_access(_query_ids(spark, folder), "user_name", USER)


def _row_access_session(spark: SparkSession, folder: str) -> DataFrame:
    """One user's queries are given to the session's user, who then asks for them."""
    mine = F.when(F.col("user_name") == USER, F.current_user()).otherwise(F.col("user_name"))
    ids = _query_ids(spark, folder).withColumn("user_name", mine)
    return row_access(ids, "user_name", F.current_user()).select("query_id", "start_time")


def _links_with_prefix(spark: SparkSession, folder: str) -> DataFrame:
    link = profile_url("query_id", prefix=LINK_PREFIX)
    return _query_ids(spark, folder).select("query_id", link.alias("query_id_url"))


def _stored_user_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The personal overview from logs written by day, which are stored as this is built."""
    logs, places = sample.SampleLogs(spark, folder), {}
    for name in ("query_history", "attribution"):
        places[name] = new_shared_path(spark, "by-day")
        store_log(getattr(logs, name), places[name])
    stored = UsageViews(StoredLogs(spark, places, by_day=True), user=ADMINISTRATOR)
    return overview.user_overview(stored, *DAYS)


def _delivered(spark: SparkSession, folder: str) -> tuple[UsageViews, list, str]:
    """The query log as merged from deliveries: a draft, late days, a correction, one of them twice.

    Also the days that each delivery touched, and the log's place.
    """
    log = sample.SampleLogs(spark, folder).query_history
    path = new_shared_path(spark, "delivered")
    even = F.pmod(F.xxhash64("query_id"), F.lit(2)) == 0
    draft = log.where(even).withColumns(
        {"total_elapsed_time": F.lit(-1).cast("bigint"), "execution_status": F.lit("RUNNING")}
    )
    # A draft says that a query began two days later than it did.
    draft = draft.withColumn("start_time", F.col("start_time") + F.expr("INTERVAL 2 DAYS"))
    touched = [merge_log(part, path, ["query_id"]) for part in (draft, log.where(~even), log.where(even))]
    touched.append(merge_log(log.where(even), path, ["query_id"]))
    logs = StoredLogs(spark, {"query_history": path}, by_day=True)
    return UsageViews(logs, user=ADMINISTRATOR), touched, path


def _stored_log_merged(spark: SparkSession, folder: str) -> DataFrame:
    views, _, path = _delivered(spark, folder)
    return plain_credits(views.queries.drop("query_id_url"))


def _stored_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """One user's overview from stored logs, whose query ids are looked up first."""
    logs, places = sample.SampleLogs(spark, folder), {}
    for name in ("query_history", "attribution"):
        places[name] = new_shared_path(spark, "by-id")
        store_log(getattr(logs, name), places[name])
    stored = StoredLogs(spark, places, by_day=True, find_by_id=True)
    return overview.user_overview(UsageViews(stored, user=ADMINISTRATOR), *DAYS, USER)


def _spill_daily_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Spilling per day from kept days, refreshed after each delivery of the log."""
    views, touched, _ = _delivered(spark, folder)
    kept = DailyState(views, new_shared_path(spark, "kept-spill"), queries.spill_daily)
    kept.refresh(touched[0] + touched[1])
    kept.refresh(touched[2])
    return kept.between(*TREND_DAYS, end_rule=WHOLE_DAY)


def _warehouse_daily_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Credits per warehouse and day from kept days; the last day ends at midnight."""
    views = _views(spark, folder)
    kept = DailyState(views, new_shared_path(spark, "kept-warehouses"), warehouse.warehouse_daily)
    first, last = (date.fromisoformat(day) for day in DAYS)
    days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    kept.refresh(days[3:])
    kept.refresh(days[:4])
    return kept.between(*DAYS)


def _cost_daily_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Cost per day and its change from kept days; the day before the range is one folder."""
    kept = DailyState(_views(spark, folder), new_shared_path(spark, "kept-cost"), accounts.day_cost)
    first = date.fromisoformat(MONTH[0])
    kept.refresh(first + timedelta(days=k) for k in range(31))
    days = kept.between(*PART_OF_MONTH).union(kept.last_before(PART_OF_MONTH[0]))
    return in_date_range(accounts.cost_changes(days), "usage_date", *PART_OF_MONTH)


def _distinct_kept(rows: Callable[..., DataFrame], by: tuple[str, ...], name: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Distinct values from daily bitmaps, of a log that is delivered in parts and corrected."""
        views, touched, _ = _delivered(spark, folder)
        kept = DistinctDays(views, new_shared_path(spark, "kept-distinct"), rows, by)
        kept.refresh(touched[1])
        kept.refresh(touched[0] + touched[2])
        return kept.between(*TREND_DAYS, name=name)

    return query


def _month(spark: SparkSession, folder: str) -> DataFrame:
    return plain_credits(in_date_range(sample.load_metering(spark, folder), "usage_date", *MONTH))


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return in_ts_range(_query_ids(spark, folder), "start_time", *DAYS)


def _whole_days(spark: SparkSession, folder: str) -> DataFrame:
    return in_ts_range(_query_ids(spark, folder), "start_time", *DAYS, end_rule=WHOLE_DAY)


def _export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Daily warehouse credits of the whole log, written and read back in each format.

    Each file but the first is written from the one before it, so the result is computed once.
    """
    result = warehouse.warehouse_daily(_views(spark, folder))
    path, schema = new_shared_path(spark, "export"), result.schema
    read = []
    for file_format in FORMATS:
        place = f"{path}/{file_format}"
        export_result(read[-1] if read else result, place, file_format)
        read.append(read_export(spark, place, schema, file_format))
    named = [df.withColumn("file_format", F.lit(name)) for name, df in zip(FORMATS, read)]
    return reduce(DataFrame.unionByName, named)


def _export_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Daily warehouse credits, exported with a manifest and held against it when read."""
    result = warehouse.warehouse_daily(_views(spark, folder))
    path = new_shared_path(spark, "export-verified")
    export_result(result, path, "csv", "NULL", manifest=True)
    return read_export(spark, path, result.schema, "csv", "NULL", verify=True)


def _sql_function(text: str, user: str | None = ADMINISTRATOR) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """A governed result asked for in SQL, by a table function."""
        views = UsageViews(sample.SampleLogs(spark, folder), user=user)
        register_functions(views, "usage_")
        return spark.sql(text)

    return query


def _session_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links that follow the organisation and account of the SQL session."""
    declare_account(spark, "SESSION_ORG", "SESSION_ACC")
    logs = sample.SampleLogs(spark, folder)
    views = UsageViews(logs, user=ADMINISTRATOR, account_of_session=True)
    return views.queries.select("query_id", "query_id_url")


# Results over governed views: how each is called with the fixed parameters.
ANALYSES: dict[str, Analysis] = {
    # filters, ranges
    "default_range": Analysis(pieces.default_ranges, (TODAY,)),
    # joins, aggregates, scalars
    "join_history_attribution": Analysis(pieces.join_history_attribution),
    "count_distinct_queries": Analysis(pieces.count_distinct_queries),
    "sum_coalesce": Analysis(pieces.sum_coalesce),
    "avg_elapsed": Analysis(pieces.avg_elapsed),
    "scalar_round": Analysis(pieces.scalar_round),
    # overviews
    "admin_overview": Analysis(overview.admin_overview, MONTH),
    "service_kpis": Analysis(overview.service_kpis, MONTH),
    "service_kpis_empty": Analysis(overview.service_kpis, NO_DAYS),
    "format_kpis": Analysis(overview.displayed_kpis, MONTH),
    "user_overview": Analysis(overview.user_overview, DAYS),
    "user_overview_rls": Analysis(overview.user_overview, (*DAYS, USER)),
    "user_overview_whole_day": Analysis(overview.user_overview, DAYS, {"end_rule": WHOLE_DAY}),
    "user_overview_empty": Analysis(overview.user_overview, NO_DAYS),
    "user_overview_sql": Analysis(overview.user_overview_sql, DAYS),
    "user_overview_sql_whole_day": Analysis(
        overview.user_overview_sql, DAYS, {"end_rule": WHOLE_DAY}
    ),
    "format_overview": Analysis(overview.displayed_overview, DAYS),
    "format_overview_whole_day": Analysis(
        overview.displayed_overview, DAYS, {"end_rule": WHOLE_DAY}
    ),
    # warehouses
    "warehouse_daily": Analysis(warehouse.warehouse_daily, DAYS),
    "warehouse_hourly": Analysis(warehouse.warehouse_hourly),
    "warehouse_trend": Analysis(warehouse.warehouse_trend),
    "warehouse_trend_range": Analysis(warehouse.warehouse_trend, TREND_DAYS),
    "warehouse_efficiency": Analysis(warehouse.warehouse_efficiency),
    "success_rate": Analysis(warehouse.success_rate),
    "cost_per_query": Analysis(warehouse.cost_per_query),
    "right_sizing": Analysis(warehouse.right_sizing),
    # AI
    "ai_by_function": Analysis(ai.ai_by_function),
    "ai_by_function_range": Analysis(ai.ai_by_function, DAYS),
    "ai_daily": Analysis(ai.ai_daily),
    "ai_daily_range": Analysis(ai.ai_daily, DAYS, {"end_rule": WHOLE_DAY}),
    "analyst_daily": Analysis(ai.analyst_daily),
    "ai_model_cost": Analysis(ai.ai_model_cost),
    "ai_query_details": Analysis(ai.ai_query_details),
    "ai_function_perf": Analysis(ai.ai_function_perf),
    # queries
    "spill_queries": Analysis(queries.spill_queries),
    "spill_by_warehouse": Analysis(queries.spill_by_warehouse),
    "spill_impact": Analysis(queries.spill_impact),
    "spill_daily": Analysis(queries.spill_daily),
    "query_details": Analysis(queries.query_details, DAYS),
    "error_tracking": Analysis(queries.error_tracking),
    "top_queries": Analysis(queries.top_queries),
    "top_queries_all": Analysis(queries.top_queries_all),
    "top_query_resources": Analysis(queries.top_query_resources),
    "cloud_services_by_type": Analysis(queries.cloud_services_by_type),
    "compilation_share": Analysis(queries.compilation_share),
    "scan_patterns": Analysis(queries.scan_patterns),
    "large_queries": Analysis(queries.large_queries),
    "failure_rollup": Analysis(queries.failure_rollup),
    # accounts
    "cost_daily": Analysis(accounts.cost_daily, MONTH),
    "cost_daily_range": Analysis(accounts.cost_daily, PART_OF_MONTH),
    "cost_by_category": Analysis(accounts.cost_by_category),
    "cost_cumulative": Analysis(accounts.cost_cumulative, MONTH),
    "top_users": Analysis(accounts.top_users),
    "user_efficiency": Analysis(accounts.user_efficiency),
    "user_activity": Analysis(accounts.user_activity),
    "storage_growth": Analysis(accounts.storage_growth),
    "storage_growth_range": Analysis(accounts.storage_growth, SNAPSHOT_DAYS),
    # planning
    "cost_forecast": Analysis(planning.cost_forecast, MONTH, {"horizon": HORIZON}),
    "cost_trend": Analysis(planning.cost_trend, MONTH),
    "budget_scenarios": Analysis(planning.budget_scenarios, MONTH, {"horizon": HORIZON}),
    "recommendations": Analysis(planning.recommendations),
    "recommendation_plan": Analysis(planning.recommendation_plan),
    "potential_savings": Analysis(planning.potential_savings),
}

QUERIES: dict[str, Query] = {
    "scan_metering": _load(sample.load_metering),
    "scan_query_history": _load(sample.load_query_history),
    "scan_attribution": _load(sample.load_attribution),
    "scan_ai_functions": _load(sample.load_ai_functions),
    "scan_ai_analyst": _load(sample.load_ai_analyst),
    "view_attribution": _view("attribution"),
    "view_attribution_rls": _view("attribution", USER),
    "view_analyst": _view("analyst"),
    "view_analyst_rls": _view("analyst", USER),
    "view_query_history": _view("queries"),
    "view_query_history_rls": _view("queries", USER),
    "ai_query_view": _view("ai_queries"),
    "ai_query_view_rls": _view("ai_queries", USER),
    "row_access": _row_access,
    "row_access_session": _row_access_session,
    "profile_url": _links,
    "profile_url_prefix": _links_with_prefix,
    "stored_user_overview": _stored_user_overview,
    "stored_user_overview_by_id": _stored_by_id,
    "stored_log_merged": _stored_log_merged,
    "spill_daily_kept": _spill_daily_kept,
    "warehouse_daily_kept": _warehouse_daily_kept,
    "cost_daily_kept": _cost_daily_kept,
    "distinct_queries_kept": _distinct_kept(query_ids, (), "total_queries"),
    "failing_users_kept": _distinct_kept(failing_users, ("error_code", "warehouse_name"), "users"),
    "export_verified": _export_verified,
    "profile_url_session": _session_links,
    "sql_user_overview": _sql_function(
        "SELECT * FROM usage_user_overview(DATE'2024-01-05', DATE'2024-01-10')", USER
    ),
    "sql_user_overview_whole_day": _sql_function(
        "SELECT * FROM usage_user_overview(DATE'2024-01-05', DATE'2024-01-10', 'whole_day')"
    ),
    "sql_admin_overview": _sql_function(
        "SELECT * FROM usage_admin_overview(DATE'1998-03-01', DATE'1998-03-31')"
    ),
    "sql_warehouse_daily": _sql_function(
        "SELECT * FROM usage_warehouse_daily(DATE'2024-01-05', DATE'2024-01-10')"
    ),
    "sql_spill_daily": _sql_function(
        "SELECT * FROM usage_spill_daily(DATE'2024-01-10', DATE'2024-01-20', end_rule => 'whole_day')"
    ),
    "filter_date_range": _month,
    "filter_ts_range": _days,
    "filter_ts_whole_day": _whole_days,
    "export_roundtrip": _export_roundtrip,
    **{name: analysis.query for name, analysis in ANALYSES.items()},
}
