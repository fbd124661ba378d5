"""Stored logs by day, ranges around windows, early filters, callers and links."""

import datetime as dt
import re

import pytest
from frames import NOON, entry, metering, query, rows, views
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlight import ADMINISTRATOR, SampleLogs, StoredLogs, UsageViews, remove_copies
from meterlight.functions.links import profile_url
from meterlight.operators.governance import ai_query_view
from meterlight.plans import accounts, ai, overview, planning, queries, warehouse
from meterlight.plans.export import export_result, read_export, to_client
from meterlight.sources.logs import store_log

DAYS = ("2024-01-05", "2024-01-10")
LOGS = ("query_history", "attribution", "ai_functions", "ai_analyst")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def places(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    sample = SampleLogs(spark, small)
    for name in LOGS:
        store_log(getattr(sample, name), f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in LOGS}


@pytest.fixture(scope="module")
def stored(spark, places):
    return UsageViews(StoredLogs(spark, places, by_day=True), user=ADMINISTRATOR)


def test_zoned_logs_keep_their_rows_by_day(spark, small, tmp_path):
    log = SampleLogs(spark, small).query_history
    zoned = log.withColumn("start_time", F.col("start_time").cast("timestamp"))
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        store_log(zoned, f"{tmp_path}/by_day")
        plain = zoned.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
        plain.write.parquet(f"{tmp_path}/plain")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    found = {}
    for name, by_day in (("by_day", True), ("plain", False)):
        logs = StoredLogs(spark, {"query_history": f"{tmp_path}/{name}"}, by_day=by_day)
        frame = queries.query_details(UsageViews(logs, user=ADMINISTRATOR), *DAYS)
        assert "start_date" not in frame.columns
        found[name] = sorted(rows(frame.select("query_id", "start_time")))
    assert found["by_day"] == found["plain"] and found["plain"]


def test_a_column_of_the_days_name_is_just_a_column(spark, small, tmp_path):
    log = SampleLogs(spark, small).query_history.withColumn("start_date", F.lit(dt.date(1990, 1, 1)))
    with pytest.raises(ValueError):
        store_log(log, f"{tmp_path}/refused")
    log.write.parquet(f"{tmp_path}/foreign")
    logs = StoredLogs(spark, {"query_history": f"{tmp_path}/foreign"})
    frame = queries.query_details(UsageViews(logs, user=ADMINISTRATOR), *DAYS)
    sample = UsageViews(SampleLogs(spark, small), user=ADMINISTRATOR)
    assert frame.count() == queries.query_details(sample, *DAYS).count()
    assert "start_date" in frame.columns


def test_sql_overview_reads_its_days_only(spark, places, stored):
    def folders(views):
        return re.findall(r"PartitionFilters: \[(.*?)\]", plan(overview.user_overview_sql(views, *DAYS)))

    assert any("start_date" in part for part in folders(stored))
    starts = StoredLogs(spark, places, attribution_starts_with_query=True, by_day=True)
    together = folders(UsageViews(starts, user=ADMINISTRATOR))
    assert together and all("start_date" in part for part in together)
    assert rows(overview.user_overview_sql(stored, *DAYS)) == rows(overview.user_overview(stored, *DAYS))


@pytest.mark.parametrize(
    "result",
    [
        overview.user_overview,
        queries.top_queries,
        queries.top_query_resources,
        warehouse.cost_per_query,
        accounts.user_efficiency,
        planning.potential_savings,
    ],
)
def test_attribution_is_filtered_before_it_is_summed(spark, stored, result):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        text = plan(result(stored, *DAYS)).split("Initial Plan")[-1]
        whole = plan(result(stored))
    finally:
        for key in settings:
            spark.conf.unset(key)
    filtered = set(re.findall(r"might_contain\(.*?xxhash64\((query_id#\d+)", text))
    scanned = re.findall(r"FileScan parquet \[(query_id#\d+),[^\]]*attributed_compute", text)
    assert scanned and set(scanned) <= filtered
    if result is overview.user_overview:
        assert "LeftSemi" in text and "LeftSemi" not in whole


def test_windows_reach_back_before_a_range(stored, spark, small):
    sample = UsageViews(SampleLogs(spark, small), user=ADMINISTRATOR)
    for logs in (sample, stored):
        trend = warehouse.warehouse_trend(logs)
        first, last = dt.date(2024, 1, 10), dt.date(2024, 1, 20)
        expected = trend.where(F.col("usage_date").between(F.lit(first), F.lit(last)))
        assert sorted(rows(warehouse.warehouse_trend(logs, first, last))) == sorted(rows(expected))
        assert sorted(rows(warehouse.warehouse_trend(logs.scoped(first, last)))) == sorted(rows(expected))


def test_the_day_before_a_range_is_the_last_one_logged(spark):
    meter = [metering("S", "2024-01-01", "5"), metering("S", "2024-01-07", "7")]
    meter += [metering("S", "2024-01-08", "4"), metering("S", "2024-01-20", "1")]
    found = rows(accounts.cost_daily(views(spark, meter=meter), "2024-01-07", "2024-01-10"))
    assert found == [(dt.date(2024, 1, 7), 7.0, 2.0), (dt.date(2024, 1, 8), 4.0, -3.0)]
    assert rows(accounts.cost_daily(views(spark, meter=meter), "2024-01-01", "2024-01-02")) == [
        (dt.date(2024, 1, 1), 5.0, None)
    ]


def test_end_rules_are_kept_checked_and_passed_on(spark):
    logs = views(spark, [query("a"), query("b", start_time=dt.datetime(2024, 1, 10, 9))])
    whole = logs.scoped(end_rule="whole_day")
    assert queries.query_details(whole, *DAYS).count() == 2
    assert queries.query_details(logs.scoped(*DAYS, end_rule="whole_day").scoped(*DAYS)).count() == 2
    assert queries.query_details(logs, *DAYS).count() == 1
    assert queries.query_details(logs, *DAYS, end_rule="whole_day").count() == 2
    with pytest.raises(ValueError):
        logs.scoped(end_rule="never")


def test_shares_come_from_one_scan_and_subjects_are_named(stored, spark):
    assert plan(planning.recommendations(stored)).count("FileScan") == 2
    big = 30 * planning.MIB
    log = [query(None, user_name=None, warehouse_name=None, execution_status="FAIL",
                 bytes_spilled_to_remote_storage=big), query("x", bytes_spilled_to_remote_storage=big)]
    found = rows(planning.recommendations(views(spark, log)))
    assert sorted(found) == [("RIGHT_SIZE", "W1", 1.0), ("SPILL", "x", float(big))]


def test_copies_can_be_removed(spark, stored):
    remove_copies(spark)
    assert planning.recommendation_plan(stored).count() > 0
    gone = remove_copies(spark, "numbered")
    assert len(gone) == 1 and remove_copies(spark, "numbered") == []


def test_the_session_user_is_the_caller_unless_another_is_named(spark, small):
    logs = SampleLogs(spark, small)
    assert UsageViews(logs).queries.count() == 0
    assert "current_user()" in UsageViews(logs).queries._jdf.queryExecution().logical().toString()
    assert UsageViews(logs, user=ADMINISTRATOR).queries.count() > 0
    with pytest.raises(PermissionError):
        UsageViews(logs).metering
    with pytest.raises(PermissionError):
        UsageViews(logs).scoped(user="USER_3")


def test_links_with_a_prefix_of_their_own(spark):
    one = spark.sql("select 'q' as query_id")
    link = one.select(profile_url("query_id", prefix="https://h/x")).first()[0]
    assert link.startswith("https://h/x/") and link.endswith("q/profile")
    logs = views(spark, [query("a")])
    named = UsageViews(logs._logs, user=ADMINISTRATOR, prefix="https://h/x")
    assert named.queries.first()["query_id_url"].startswith("https://h/x/")


def test_columns_that_both_ai_logs_have(spark):
    calls = spark.createDataFrame(
        [("a", 1, "F", "late", "e")], "query_id string, warehouse_id long, function_name string,"
        " start_time string, ai_start_time string"
    )
    found = ai_query_view(views(spark, [query("a")]).queries, calls).first()
    assert found["start_time"] == NOON and found["ai_ai_start_time"] == "late"
    assert found["ai_start_time"] == "e" and found["function_name"] == "F"


def test_ai_sums_count_repeated_queries_as_a_join_does(spark):
    log = [query("a", total_elapsed_time=10), query("a", total_elapsed_time=10), query("b")]
    calls = [dict(query_id=q, warehouse_id=1, function_name=f, model_name="m", tokens=t, token_credits=None)
             for q, f, t in (("a", "F", 5), ("a", "F", 7), ("b", "F", 1), ("z", "F", 99), ("b", None, 2))]
    logs = views(spark, log, ai=calls)
    assert sorted(rows(ai.ai_by_function(logs)), key=repr) == sorted(
        [("F", "m", 5, 25, None), (None, "m", 1, 2, None)], key=repr
    )
    assert [row[1] for row in rows(ai.ai_daily(logs))] == [27]
    joined = logs.ai_queries.groupBy("function_name").agg(F.avg("total_elapsed_time"))
    means = {row[0]: row[1] for row in rows(ai.ai_function_perf(logs))}
    assert means == dict(rows(joined))


def test_savings_by_the_thresholds_of_the_recommendations(spark):
    big = 25 * planning.MIB
    log = [query("f1", execution_status="FAIL"), query("ok", user_name="A")]
    log += [query("f2", user_name="B", execution_status="FAIL")] + [query(f"b{k}", user_name="B") for k in range(9)]
    log += [query("s1", user_name="C", bytes_spilled_to_remote_storage=big)]
    log += [query("s2", user_name="C", bytes_spilled_to_local_storage=9)]
    logs = views(spark, log, [entry(q, "1.0") for q in ("f1", "f2", "s1", "s2")])
    wide = {row[0]: row[1] for row in rows(planning.potential_savings(logs))}
    narrow = planning.potential_savings(logs, failures_above=0.25, spill_bytes_from=20 * planning.MIB)
    assert wide == {"ERRORS": 2.0, "SPILL": 2.0}
    assert {row[0]: row[1] for row in rows(narrow)} == {"ERRORS": 1.0, "SPILL": 1.0}


def test_trend_is_told_by_the_slope_before_rounding(spark):
    meter = [metering("S", "2024-01-01", "1"), metering("S", "2024-01-02", "1.01004")]
    assert rows(planning.cost_trend(views(spark, meter=meter), "2024-01-01", "2024-01-03")) == [
        ("S", 0.01, "UP")
    ]


def test_listings_do_not_go_to_the_client(spark):
    assert len(to_client(spark.range(5))) == 5
    with pytest.raises(ValueError):
        to_client(spark.range(6), at_most=5)


def test_text_without_line_ends_can_be_read_in_parts(spark, tmp_path):
    frame = spark.createDataFrame([("a,b", 1), ('c"d', 2)], "t string, n long")
    export_result(frame, f"{tmp_path}/x", "csv")
    schema = T.StructType(frame.schema.fields)
    assert sorted(rows(read_export(spark, f"{tmp_path}/x", schema, "csv", line_ends=False))) == sorted(rows(frame))
