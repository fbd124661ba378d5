"""Edge rows: NULLs, ties, fan-out, range ends, empty input, and what must raise."""

import datetime as dt
from decimal import Decimal

import pytest
from frames import NOON, entry, metering, query, rows, views
from pyspark.sql import functions as F

from meterlight import schemas
from meterlight.functions.dates import (
    WHOLE_DAY,
    check_range,
    default_range,
    in_date_range,
    in_ts_range,
)
from meterlight.functions.display import format_kpis
from meterlight.functions.links import profile_url
from meterlight.operators.governance import row_access
from meterlight.plans import accounts, overview, planning, queries, warehouse


def test_row_access_matches_the_caller_only(spark):
    users = spark.createDataFrame([("A",), ("B",), (None,)], "user_name string")
    assert rows(row_access(users, "user_name", "A")) == [("A",)]
    assert rows(row_access(users, "user_name", "C")) == []
    assert row_access(users, "user_name", None).count() == 3


def test_row_access_takes_the_session_user(spark):
    me = spark.range(1).select(F.current_user()).first()[0]
    users = spark.createDataFrame([(me,), ("somebody else",)], "user_name string")
    assert rows(row_access(users, "user_name", F.current_user())) == [(me,)]


def test_link_is_null_when_a_part_is(spark):
    parts = spark.createDataFrame(
        [("q1", "acc"), (None, "acc"), ("q1", None), ("a/b", "acc")], "id string, account string"
    )
    links = [
        row[0]
        for row in parts.select(profile_url("id", "org", F.col("account"), "https://h/")).collect()
    ]
    assert links == [
        "https://h/org/acc/#/compute/history/queries/q1/profile",
        None,
        None,
        "https://h/org/acc/#/compute/history/queries/a/b/profile",
    ]


def test_range_ends(spark):
    start, end = dt.date(2024, 1, 5), dt.date(2024, 1, 10)
    moments = [
        dt.datetime(2024, 1, 4, 23, 59, 59, 999999),
        dt.datetime(2024, 1, 5),
        dt.datetime(2024, 1, 10),
        dt.datetime(2024, 1, 10, 0, 0, 0, 1),
        dt.datetime(2024, 1, 10, 23, 59, 59, 999999),
        dt.datetime(2024, 1, 11),
        None,
    ]
    frame = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert [r[0] for r in in_ts_range(frame, "t", start, end).collect()] == moments[1:3]
    whole = in_ts_range(frame, "t", start, end, WHOLE_DAY)
    assert [r[0] for r in whole.collect()] == moments[1:5]
    days = frame.select(F.col("t").cast("date").alias("d"))
    assert in_date_range(days, "d", start, end).count() == 4


def test_range_validity():
    day = dt.date(2024, 1, 5)
    assert check_range("2024-01-05", day) == (day, day)
    for bad in [(None, day), (day, None), (day, dt.date(2024, 1, 4))]:
        with pytest.raises(ValueError):
            check_range(*bad)
    with pytest.raises(ValueError):
        in_ts_range(None, "t", day, dt.date(2024, 1, 4))


def test_default_ranges():
    today = dt.date(2024, 3, 1)
    assert default_range("admin", today) == (dt.date(2024, 2, 23), dt.date(2024, 3, 2))
    assert default_range("user", today) == (dt.date(2024, 2, 25), today)


def test_analyses_refuse_bad_ranges(spark):
    logs = views(spark)
    for bad in [("2024-01-10", "2024-01-05"), ("2024-01-10", None), (None, "2024-01-10")]:
        with pytest.raises(ValueError):
            overview.user_overview(logs, *bad)


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="user_name"):
        schemas.conform(spark.range(1).withColumnRenamed("id", "query_id"),
                        schemas.QUERY_HISTORY, "query_history")


def test_extra_columns_pass_through(spark):
    frame = spark.createDataFrame([("W", None, None, None, None, "more")],
                                  "service_type string, usage_date date, credits_used double, "
                                  "credits_used_compute double, "
                                  "credits_used_cloud_services double, note string")
    shaped = schemas.conform(frame, schemas.METERING, "metering")
    assert shaped.columns == [*schemas.METERING.names, "note"]


def test_metering_has_no_users(spark):
    with pytest.raises(PermissionError):
        overview.admin_overview(views(spark, user="A"))


def test_views_keep_their_caller_and_their_range(spark):
    logs = views(spark, [query("a"), query("b", start_time=NOON + dt.timedelta(days=9))],
                 [entry("a"), entry("b")], user="A")
    with pytest.raises(PermissionError):
        overview.user_overview(logs, user="B")
    narrowed = logs.scoped("2024-01-06", "2024-01-07")
    assert rows(overview.user_overview(narrowed, user="A"))[0][0] == 1
    assert rows(overview.user_overview(logs))[0][0] == 2


def test_display(spark):
    figures = spark.createDataFrame(
        [(1234.25, 0.25, 1234567, None)], "a double, b double, c bigint, d double"
    )
    assert rows(format_kpis(figures, {"a": 1, "b": 1, "c": 0, "d": 1})) == [
        ("1,234.2", "0.2", "1,234,567", None)
    ]


def test_overview_repeats_cloud_credits_per_entry(spark):
    logs = views(
        spark,
        [
            query("none"),
            query("one", total_elapsed_time=2000),
            query("three", total_elapsed_time=6000, credits_used_cloud_services=Decimal("0.25")),
        ],
        [entry("one", "1.0"), *(entry("three", "0.5") for _ in range(3))],
    )
    # one + three * 3 joined rows
    assert rows(overview.user_overview(logs)) == [(2, 2.5, 1.25, 5.0)]


def test_overview_with_repeated_query_rows_equals_the_plain_join(spark):
    history = [query("q"), query("q", total_elapsed_time=None),
               query("q", total_elapsed_time=4000, credits_used_cloud_services=None),
               query("r", total_elapsed_time=None)]
    entries = [entry("q", "0.1"), entry("q", None), entry("r", "2"), entry(None, "9")]
    logs = views(spark, [*history, query(None)], entries)
    joined = logs.queries.join(logs.attribution_credits, "query_id").agg(
        F.count_distinct("query_id"),
        F.sum(F.coalesce("credits_attributed_compute", F.lit(0))).cast("double"),
        F.sum(F.coalesce("credits_used_cloud_services", F.lit(0))).cast("double"),
        F.avg("total_elapsed_time") / 1000,
    )
    assert rows(overview.user_overview(logs)) == rows(joined)


def test_overview_credits(spark):
    some = [query("q", credits_used_cloud_services=None)]
    only_null = views(spark, some, [entry("q", None)])
    assert rows(overview.user_overview(only_null)) == [(1, 0.0, 0.0, 1.0)]
    tie = views(spark, some, [entry("q", "0.0005")])
    assert rows(overview.user_overview(tie))[0][1] == 0.001
    assert rows(overview.user_overview(views(spark))) == [(0, None, None, None)]


def test_overview_sees_the_callers_rows(spark):
    logs = views(
        spark,
        [query("a"), query("b", user_name="B"), query("n", user_name=None)],
        [entry("a"), entry("b", user_name="B"), entry("n", user_name=None)],
    )
    assert rows(overview.user_overview(logs, user="B"))[0][0] == 1
    assert rows(overview.user_overview(logs, user="nobody")) == [(0, None, None, None)]
    assert rows(overview.user_overview(logs))[0][0] == 3
    days = ("2024-01-05", "2024-01-07")
    for user in ("B", None):
        assert rows(overview.user_overview_sql(logs, *days, user)) == rows(
            overview.user_overview(logs, *days, user)
        )


def test_kpis(spark):
    assert rows(overview.service_kpis(views(spark))) == []
    day = "2024-01-05"
    unlisted = views(spark, meter=[metering("PIPE", day, "2"), metering(None, day, "3")])
    assert rows(overview.service_kpis(unlisted)) == [(5.0, *[0.0] * 7)]
    all_null = views(spark, meter=[metering("COPY_FILES", day, None)])
    assert rows(overview.service_kpis(all_null)) == [(0.0, *[0.0] * 7)]


def test_admin_overview_keeps_null_totals_last(spark):
    day = "2024-01-05"
    logs = views(spark, meter=[metering("X", day, None), metering("Y", day, "1"),
                               metering("Z", day, "5"), metering("A", day, "1")])
    found = [row[:2] for row in rows(overview.admin_overview(logs))]
    assert found == [("Z", 5.0), ("A", 1.0), ("Y", 1.0), ("X", None)]


def test_trend_of_one_day_and_of_no_credits(spark):
    logs = views(spark, meter=[
        metering("ONE", "2024-01-05", "3"),
        metering("NONE", "2024-01-05", None),
        metering("UP", "2024-01-05", "1"),
        metering("UP", "2024-01-06", "2"),
        metering("UP", "2024-01-08", "4"),
    ])
    days = ("2024-01-05", "2024-01-10")
    assert sorted(rows(planning.cost_forecast(logs, *days, horizon=10))) == [
        ("ONE", None, None), ("UP", 1.0, 11.0)
    ]
    assert sorted(rows(planning.cost_trend(logs, *days))) == [
        ("ONE", None, "FLAT"), ("UP", 1.0, "UP")
    ]


def test_top_users_keep_ties(spark):
    spent = {"a": "5", "b": "5", "c": "4", "d": "4", "e": "4", "f": "1"}
    logs = views(spark, entries=[entry("q", c, user_name=u) for u, c in spent.items()])
    found = {(r[0], r[2]) for r in rows(accounts.top_users(logs, count=3))}
    assert found == {("a", 1), ("b", 1), ("c", 3), ("d", 3), ("e", 3)}
    assert {r[0] for r in rows(accounts.top_users(logs, count=2))} == {"a", "b"}


def test_top_queries_count_every_row_of_a_repeated_query(spark):
    history = [query("x"), query("x", user_name="B"), query("y"), query("z")]
    logs = views(spark, history, [entry("x", "3"), entry("y", "2"), entry("z", "1"),
                                  entry("not logged", "9")])
    found = [(r[0], r[1], r[4]) for r in rows(queries.top_queries(logs, count=3))]
    assert found == [("x", "A", 3.0), ("x", "B", 3.0), ("y", "A", 2.0)]


def test_efficiency_counts_queries_without_attribution(spark):
    logs = views(spark, [query("x"), query("y", execution_status="FAIL"),
                         query(None, user_name="B")], [entry("x", "1"), entry("x", "2")])
    assert sorted(rows(accounts.user_efficiency(logs))) == [
        ("A", 2, 1.5, 1000.0, 0.5), ("B", 1, 0.0, 1000.0, 1.0)
    ]


def test_right_sizing_thresholds(spark):
    logs = views(spark, [
        query("a", bytes_spilled_to_remote_storage=1),
        query("b", warehouse_name="W2"),
        query("c", warehouse_name="W3", bytes_spilled_to_local_storage=1),
    ])
    found = {(r[0], r[3]) for r in rows(warehouse.right_sizing(logs))}
    assert found == {("W1", "SIZE_UP"), ("W2", "SIZE_DOWN"), ("W3", "KEEP")}
    lax = {r[3] for r in rows(warehouse.right_sizing(logs, size_up_above=1.0, size_down_below=0))}
    assert lax == {"KEEP"}


def test_trailing_week_has_gaps(spark):
    entries = [entry("q", "1", start_time=NOON + dt.timedelta(days=d)) for d in (0, 6, 7, 20)]
    trend = warehouse.warehouse_trend(views(spark, entries=entries))
    assert [r[2] for r in sorted(rows(trend))] == [1.0, 2.0, 2.0, 1.0]


def test_byte_totals_may_pass_a_bigint(spark):
    huge = 2**62
    logs = views(spark, [query(str(i), bytes_scanned=huge) for i in range(4)])
    assert rows(warehouse.warehouse_efficiency(logs))[0][3] == float(4 * huge)


def test_failures_are_raised(spark):
    logs = views(spark, [query("x")])
    with pytest.raises(Exception, match="no_such"):
        logs.queries.select("no_such").collect()
