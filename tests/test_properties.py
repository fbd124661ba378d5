"""What must hold between results, and the known values of the samples."""

import datetime as dt

import pytest
from frames import entry, query, rows, views
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from meterlight import ADMINISTRATOR, SampleLogs, UsageViews
from meterlight.functions.measures import compute_credits
from meterlight.plans import overview, warehouse
from meterlight.plans.catalog import DAYS, QUERIES
from meterlight.plans.export import export_result, read_export, to_client



def test_warehouse_days_add_up(spark, medium):
    scope = UsageViews(SampleLogs(spark, medium), user=ADMINISTRATOR).scoped(*DAYS)
    whole = scope.attribution.agg(F.sum(compute_credits()).cast("double")).first()[0]
    parts = QUERIES["warehouse_daily"](spark, medium).agg(F.sum("credits")).first()[0]
    assert parts == pytest.approx(whole)


def test_key_figures_add_up(spark, medium):
    total = QUERIES["service_kpis"](spark, medium).first()["total_credits"]
    parts = QUERIES["admin_overview"](spark, medium).agg(F.sum("total_credits")).first()[0]
    assert total == pytest.approx(parts)


def test_callers_share_out_the_log(spark, small):
    logs = UsageViews(SampleLogs(spark, small), user=ADMINISTRATOR)
    everything = logs.attribution.select("query_id", "user_name")
    users = [r[0] for r in everything.select("user_name").distinct().collect() if r[0]]
    seen = sum(logs.scoped(user=user).attribution.count() for user in users)
    nobody = everything.where(F.col("user_name").isNull()).count()
    assert seen + nobody == everything.count()
    mine = logs.scoped(user=users[0]).attribution.select("query_id", "user_name")
    assert mine.exceptAll(everything).count() == 0


def test_midnight_is_part_of_the_whole_day(spark, medium):
    midnight = QUERIES["filter_ts_range"](spark, medium)
    whole = QUERIES["filter_ts_whole_day"](spark, medium)
    assert midnight.exceptAll(whole).count() == 0
    assert (midnight.count(), whole.count()) == (1615, 1945)


KNOWN = {
    "user_overview": (1586, 1552.8, 3.29, 47.79),
    "user_overview_rls": (5, 3.81, 0.004, 79.22),
    "user_overview_empty": (0, None, None, None),
    "service_kpis": (1711.61, 203.53, 229.48, 175.49, 245.41, 245.53, 162.52, 187.45),
}
COUNTS = {
    "scan_query_history": 10000,
    "scan_attribution": 60000,
    "scan_metering": 60000,
    "scan_ai_functions": 1000,
    "scan_ai_analyst": 279,
    "admin_overview": 9,
    "ai_query_view": 1000,
    "ai_query_view_rls": 5,
    "view_query_history_rls": 59,
    "view_attribution_rls": 218,
    "view_analyst_rls": 8,
    "spill_queries": 899,
    "recommendations": 172,
}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_known_values(spark, medium, name):
    assert rows(QUERIES[name](spark, medium)) == [KNOWN[name]]


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_known_counts(spark, medium, name):
    assert QUERIES[name](spark, medium).count() == COUNTS[name]


def test_known_plans(spark, medium):
    saved = {r["rule"]: r["saved_credits"] for r in
             QUERIES["potential_savings"](spark, medium).collect()}
    assert saved == {"ERRORS": 973.56, "SPILL": 172.04}
    actions = {r["warehouse_name"]: r["action"] for r in
               QUERIES["right_sizing"](spark, medium).collect()}
    assert actions == {"WH_0": "SIZE_UP", "WH_1": "KEEP", "WH_2": "KEEP", "WH_3": "KEEP",
                       "WH_4": "SIZE_DOWN"}


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == [
        "total_queries", "compute_credits", "cs_credits", "avg_execution_seconds"
    ]
    assert rows(frame) == [(176, 169.77, 0.137, 49.46)]


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_exports_come_back(spark, tmp_path, file_format):
    frame = spark.createDataFrame(
        [(None, dt.datetime(2024, 1, 5, 1, 2, 3, 456789), 0.1, 1),
         ("", None, None, None),
         (' a "b", \n c\\', dt.datetime(2024, 1, 5), 1e-300, -5)],
        "s string, t timestamp_ntz, d double, n bigint",
    )
    path = f"{tmp_path}/{file_format}"
    export_result(frame, path, file_format, null_text="\\N")
    back = read_export(spark, path, frame.schema, file_format, null_text="\\N")
    assert sorted(rows(back), key=repr) == sorted(rows(frame), key=repr)
    assert to_client(back).shape == (3, 4)
    with pytest.raises(Exception, match="(?i)exist"):
        export_result(frame, path, file_format)


def test_unknown_export_formats_raise(spark):
    with pytest.raises(ValueError):
        export_result(spark.range(1), "/tmp/never-written", "xls")


ids = st.sampled_from(["a", "b", "c", None])
amounts = st.one_of(st.none(), st.integers(0, 10**6).map(lambda n: f"{n / 1000:.3f}"))


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    history=st.lists(st.tuples(ids, st.one_of(st.none(), st.integers(0, 10**6))), max_size=12),
    entries=st.lists(st.tuples(ids, amounts), max_size=12),
)
def test_overview_is_the_plain_join(spark, history, entries):
    logs = views(spark, [query(i, total_elapsed_time=t) for i, t in history],
                 [entry(i, c) for i, c in entries])
    joined = logs.queries.join(logs.attribution_credits, "query_id")
    plain = joined.agg(
        F.count_distinct("query_id"),
        F.round(F.sum(compute_credits()), 3).cast("double"),
        F.round(F.sum("credits_used_cloud_services"), 3).cast("double"),
        F.round(F.avg("total_elapsed_time") / 1000, 2),
    )
    assert rows(overview.user_overview(logs)) == rows(plain)
    by_warehouse = joined.groupBy("warehouse_name").agg(
        F.count_distinct("query_id"), F.sum(compute_credits()).cast("double")
    )
    found = [row[:3] for row in rows(warehouse.cost_per_query(logs))]
    assert sorted(found) == sorted(rows(by_warehouse))
