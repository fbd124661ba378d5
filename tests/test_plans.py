"""What the plans must and must not hold."""

import re

import pytest
from frames import entry, query, rows, views
from pyspark.sql import functions as F

from meterlight import ADMINISTRATOR, SampleLogs, StoredLogs, UsageViews
from meterlight.functions.measures import compute_credits
from meterlight.plans import accounts, catalog, overview, queries, warehouse
from meterlight.sources.logs import store_log

QUERIES = catalog.QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_workers_and_no_cross_joins(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize(
    "name, column",
    [
        ("user_overview", "ts"),
        ("user_overview_sql", "ts"),
        ("filter_ts_range", "ts"),
        ("filter_ts_whole_day", "ts"),
        ("warehouse_daily", "ts"),
        ("query_details", "ts"),
        ("default_range", "ts"),
        ("admin_overview", "l_shipdate"),
        ("service_kpis", "l_shipdate"),
        ("cost_daily", "l_shipdate"),
        ("cost_forecast", "l_shipdate"),
    ],
)
def test_date_bounds_reach_the_scan(spark, small, name, column):
    pushed = " ".join(re.findall(r"PushedFilters: \[.*?\], ReadSchema",
                                 plan(QUERIES[name](spark, small))))
    assert f"GreaterThanOrEqual({column}," in pushed
    assert re.search(rf"LessThan(OrEqual)?\({column},", pushed)


def test_scans_read_only_what_they_need(spark, small):
    text = plan(QUERIES["success_rate"](spark, small))
    assert re.findall(r"ReadSchema: struct<(.*?)>", text) == ["user_id:bigint,event_type:string"]


def test_kpis_scan_once(spark, small):
    assert plan(QUERIES["service_kpis"](spark, small)).count("FileScan") == 1


def test_overview_shuffles_each_log_once(spark, small):
    """A range adds the shuffle of its queries' ids, which keeps other attribution out of the sum."""
    logs = UsageViews(SampleLogs(spark, small), user=ADMINISTRATOR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(overview.user_overview(logs))
        ranged = plan(QUERIES["user_overview"](spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(query_id") == 2
    assert text.count("Exchange ") == 3
    assert ranged.count("Exchange hashpartitioning(query_id") == 3


def test_credits_alone_need_no_session_join(spark, small):
    assert "Join" not in plan(QUERIES["count_distinct_queries"](spark, small))


def test_percentile_steps_share_the_counts(spark, small):
    frame = QUERIES["ai_function_perf"](spark, small)
    frame.collect()
    final = plan(frame).split("Initial Plan")[0]
    assert final.count("FileScan") == 2
    assert "ReusedExchange" in final


def test_hot_keys_give_the_same_results(spark):
    """A third of all rows under one query, one user and one warehouse."""
    history = [query(f"q{i}", user_name=f"U{i % 7}", warehouse_name=f"W{i % 3}",
                     total_elapsed_time=i, bytes_scanned=i) for i in range(200)]
    history += [query("hot", user_name="U0", warehouse_name="W0", total_elapsed_time=5,
                      bytes_scanned=77) for _ in range(100)]
    entries = [entry(f"q{i % 200}", "0.25", user_name=f"U{i % 7}") for i in range(400)]
    entries += [entry("hot", "0.01", user_name="U0") for _ in range(200)]
    logs = views(spark, history, entries)
    joined = logs.queries.join(logs.attribution_credits, "query_id")

    plain = joined.agg(
        F.count_distinct("query_id"),
        F.sum(compute_credits()).cast("double"),
        F.sum("credits_used_cloud_services").cast("double"),
        F.round(F.avg("total_elapsed_time") / 1000, 2),
    )
    assert rows(overview.user_overview(logs)) == rows(plain)

    by_warehouse = joined.groupBy("warehouse_name").agg(
        F.count_distinct("query_id"), F.sum(compute_credits()).cast("double")
    )
    found = [row[:3] for row in rows(warehouse.cost_per_query(logs))]
    assert sorted(found) == sorted(rows(by_warehouse))

    by_user = {r[0]: r for r in rows(accounts.user_efficiency(logs))}
    assert by_user["U0"][1] == 129
    limit = rows(queries.large_queries(logs))
    assert min(row[3] for row in limit) >= 185


def test_stored_logs_give_the_sample_results(spark, small, tmp_path):
    sample = SampleLogs(spark, small)
    names = ("query_history", "attribution", "metering", "ai_functions", "ai_analyst")
    places = {name: f"{tmp_path}/{name}" for name in names}
    for name in names:
        log = getattr(sample, name)
        log.withColumn("note", F.lit("more")).write.parquet(places[name])
    stored = UsageViews(StoredLogs(spark, places), user=ADMINISTRATOR)
    days = ("2024-01-05", "2024-01-10")
    assert rows(overview.user_overview(stored, *days, "USER_3")) == rows(
        QUERIES["user_overview_rls"](spark, small)
    )
    assert rows(overview.service_kpis(stored, "1998-03-01", "1998-03-31")) == rows(
        QUERIES["service_kpis"](spark, small)
    )
    assert "note" in queries.query_details(stored).columns
    stored.queries.createOrReplaceTempView("stored_queries")
    named = StoredLogs(spark, places | {"query_history": "stored_queries"})
    by_name = UsageViews(named, user=ADMINISTRATOR)
    assert rows(overview.user_overview(by_name, *days)) == rows(
        QUERIES["user_overview"](spark, small)
    )


def test_logs_stored_by_day_are_pruned(spark, small, tmp_path):
    sample = SampleLogs(spark, small)
    names = ("query_history", "attribution", "metering", "ai_functions", "ai_analyst")
    places = {name: f"{tmp_path}/{name}" for name in names}
    for name in names:
        log = getattr(sample, name)
        if name == "metering":  # two months of it, to write fewer folders
            log = log.where("usage_date BETWEEN '1998-02-15' AND '1998-04-15'")
        store_log(log, places[name])
    stored = UsageViews(StoredLogs(spark, places, by_day=True), user=ADMINISTRATOR)
    days, month = ("2024-01-05", "2024-01-10"), ("1998-03-01", "1998-03-31")
    overview_frame = overview.user_overview(stored, *days)
    assert rows(overview_frame) == rows(QUERIES["user_overview"](spark, small))
    assert "start_date" in " ".join(re.findall(r"PartitionFilters: \[.*?\]", plan(overview_frame)))
    kpis = overview.service_kpis(stored, *month)
    assert rows(kpis) == rows(QUERIES["service_kpis"](spark, small))
    assert "usage_date" in " ".join(re.findall(r"PartitionFilters: \[.*?\]", plan(kpis)))
    starts = StoredLogs(spark, places, attribution_starts_with_query=True, by_day=True)
    together = UsageViews(starts, user=ADMINISTRATOR)
    for user in (None, "USER_3"):
        frame = overview.user_overview(together, *days, user)
        assert rows(frame) == rows(overview.user_overview(stored, *days, user))
        pruned = re.findall(r"PartitionFilters: \[.*?\]", plan(frame))
        assert all("start_date" in part for part in pruned)
        assert "start_date" not in re.findall(
            r"PartitionFilters: \[.*?\]", plan(overview.user_overview(stored, *days, user))
        )[1]
    mine = overview.user_overview(stored, *days, "USER_3")
    assert rows(mine) == rows(QUERIES["user_overview_rls"](spark, small))
    assert plan(mine).count("EqualTo(user_name,USER_3)") >= 2
    assert "start_date" not in overview.user_overview(stored).columns
    whole = queries.query_details(stored.scoped(*days, end_rule="whole_day"))
    assert whole.count() == QUERIES["filter_ts_whole_day"](spark, small).count()


def test_registered_views_answer_sql(spark, small):
    logs = UsageViews(SampleLogs(spark, small), user=ADMINISTRATOR)
    assert len(logs.register("all_")) == 5
    assert len(logs.scoped(user="USER_3").register("my_")) == 4
    text = """
        with spent as (
            select query_id, coalesce(credits_attributed_compute, 0) as credits
            from {0}query_attribution_history
        )
        select count(distinct query_id), round(cast(sum(credits) as double), 3),
               round(cast(sum(coalesce(credits_used_cloud_services, 0)) as double), 3),
               round(mean(total_elapsed_time) / 1000, 2)
        from {0}query_history natural join spent
        where start_time between date'2024-01-05' and date'2024-01-10'"""
    for prefix, name in (("all_", "user_overview"), ("my_", "user_overview_rls")):
        assert rows(spark.sql(text.format(prefix))) == rows(QUERIES[name](spark, small))
