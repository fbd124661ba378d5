"""Logs kept over many days: lookup by id, merged deliveries, kept results, SQL functions, manifests."""

import datetime as dt
import inspect
import re
from decimal import Decimal

import pytest
from frames import _frame, entry, metering, query, rows, views
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from meterlight import ADMINISTRATOR, SampleLogs, StoredLogs, UsageViews, schemas
from meterlight.functions.dates import WHOLE_DAY
from meterlight.functions.links import declare_account
from meterlight.plans import accounts, ai, catalog, overview, queries, warehouse
from meterlight.plans.by_day import DailyState, DistinctDays, failing_users, query_ids, stretches
from meterlight.plans.export import export_result, read_export
from meterlight.plans.sql_functions import register_functions
from meterlight.sources import logs as log_module
from meterlight.sources.deliveries import merge_log, replace_days
from meterlight.sources.logs import last_day_before, store_log, with_ids

FIRST = dt.datetime(2024, 1, 1, 9)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_rows(df, column):
    """Rows that the scans which read ``column`` put out when ``df`` ran."""
    total = 0

    def walk(node):
        nonlocal total
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec" and column in node.toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return total


@pytest.fixture(scope="module")
def many_days(spark, tmp_path_factory):
    """Sixty days of 400 queries each; attribution of a query is logged on its day and the next."""
    folder = tmp_path_factory.mktemp("many")
    at = F.lit(FIRST) + F.make_dt_interval(F.floor(F.col("id") / 400).cast("int"))
    ids = spark.range(24_000)
    history = ids.select(
        F.sha1(F.col("id").cast("string")).alias("query_id"),
        F.concat(F.lit("U"), F.col("id") % 40).alias("user_name"),
        at.cast("timestamp_ntz").alias("start_time"),
        F.lit(1000).cast("long").alias("total_elapsed_time"),
        F.lit("0.5").cast("decimal(18,9)").alias("credits_used_cloud_services"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.QUERY_HISTORY
          if f.name not in ("query_id", "user_name", "start_time", "total_elapsed_time", "credits_used_cloud_services")),
    ).select(*schemas.QUERY_HISTORY.names)
    later = F.explode(F.array(F.lit(0), F.lit(1))).alias("later")
    attribution = history.select("query_id", "user_name", "start_time", later).select(
        "query_id",
        "user_name",
        F.lit("W").alias("warehouse_name"),
        (F.col("start_time") + F.make_dt_interval(F.col("later"))).alias("start_time"),
        F.lit("1.5").cast("decimal(18,9)").alias("credits_attributed_compute"),
    )
    places = {"query_history": f"{folder}/qh", "attribution": f"{folder}/qa"}
    store_log(history, places["query_history"])
    store_log(attribution, places["attribution"])
    return places


def overview_of(spark, places, **options):
    stored = StoredLogs(spark, places, by_day=True, **options)
    return overview.user_overview(UsageViews(stored, user=ADMINISTRATOR), "2024-01-20", "2024-01-20", "U7", WHOLE_DAY)


def test_ids_reach_the_scan_and_skip_row_groups(spark, many_days):
    plain, found = overview_of(spark, many_days), overview_of(spark, many_days, find_by_id=True)
    assert rows(found) == rows(plain) == [(10, 30.0, 10.0, 1.0)]
    pushed = " ".join(re.findall(r"PushedFilters: \[.*?\], ReadSchema", plan(found)))
    assert "In(query_id" in pushed
    everything = scanned_rows(plain, "credits_attributed_compute")
    assert everything >= 1200  # the user's rows of all days at least
    # Row groups of two of the sixty-one days hold the ids.
    assert 20 <= scanned_rows(found, "credits_attributed_compute") <= everything / 20


def test_a_long_list_of_ids_is_a_join(spark, many_days, monkeypatch):
    monkeypatch.setattr(log_module, "LISTED_IDS", 5)
    found = overview_of(spark, many_days, find_by_id=True)
    assert "In(query_id" not in plan(found) and rows(found) == [(10, 30.0, 10.0, 1.0)]


def test_no_ids_no_rows(spark, many_days):
    log = spark.read.parquet(many_days["attribution"])
    nobody = spark.createDataFrame([(None,)], "query_id string")
    assert with_ids(log, nobody).count() == 0


@pytest.mark.parametrize("result", [ai.ai_by_function, ai.ai_daily, ai.ai_function_perf])
def test_ai_calls_are_filtered_before_they_are_summed(spark, small, tmp_path, result):
    logs, places = SampleLogs(spark, small), {}
    for name in ("query_history", "ai_functions"):
        places[name] = str(tmp_path / name)
        store_log(getattr(logs, name), places[name])
    settings = {
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        # The AI log has no day of its own.
        stored = StoredLogs(spark, places, by_day=("query_history",))
        ranged = UsageViews(stored, user=ADMINISTRATOR)
        text = plan(result(ranged, *catalog.DAYS))
        # The semi-join stands below the partial sum over the AI log, and a Bloom filter at its scan.
        assert "LeftSemi" in text and "might_contain" in text
        assert "LeftSemi" not in plan(result(ranged))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


ANALYSES = [
    f
    for module in (overview, warehouse, ai, queries, accounts)
    for f in vars(module).values()
    if inspect.isfunction(f) and f.__module__ == module.__name__ and "end_rule" in inspect.signature(f).parameters
]


@pytest.mark.parametrize("result", ANALYSES, ids=lambda f: f.__name__)
def test_every_analysis_follows_the_end_rule(spark, result):
    late = dt.datetime(2024, 1, 6, 12)
    made = views(
        spark,
        [query("a", start_time=late, execution_status="FAIL", bytes_spilled_to_local_storage=5,
               total_elapsed_time=9000, compilation_time=7),
         query("b", start_time=dt.datetime(2024, 1, 6))],
        [entry("a", start_time=late), entry("b", start_time=dt.datetime(2024, 1, 6))],
    )
    made._logs.ai_functions = spark.createDataFrame(
        [("a", 1, "F", "M", 5, Decimal(1)), ("b", 1, "F", "M", 5, Decimal(1))], schemas.AI_FUNCTIONS
    )
    made._logs.ai_analyst = spark.createDataFrame(
        [("A", late, 1, Decimal(1)), ("A", dt.datetime(2024, 1, 6), 1, Decimal(1))], schemas.AI_ANALYST
    )
    days = ("2024-01-06", "2024-01-06")
    answers = {rule: rows(result(made, *days, end_rule=rule)) for rule in (None, "midnight", WHOLE_DAY)}
    assert answers[None] == answers["midnight"]
    # Trends are over whole days; the two calls cost the same.
    if result.__name__ not in ("warehouse_trend", "ai_model_cost"):
        assert answers[WHOLE_DAY] != answers["midnight"], result.__name__
    with pytest.raises(ValueError):
        result(made, *days, end_rule="noon")


def history(spark, *changes):
    return _frame(spark, [query(**c) for c in changes], schemas.QUERY_HISTORY)


def kept(spark, path, *columns):
    log = spark.read.parquet(path)
    return sorted(rows(log.select(*columns)), key=str)


def test_deliveries_late_twice_and_corrected(spark, tmp_path):
    path = str(tmp_path / "log")
    day = [dt.datetime(2024, 1, d, 12) for d in range(1, 6)]
    shown = ("query_id", "start_time", "total_elapsed_time", "start_date")
    one = history(spark, {"query_id": "a", "start_time": day[0]}, {"query_id": "b", "start_time": day[1]},
                  {"query_id": None, "start_time": day[1]}, {"query_id": "n", "start_time": None})
    assert merge_log(one, path, ["query_id"]) == [day[0].date(), day[1].date(), None]
    before = kept(spark, path, *shown)
    assert len(before) == 4
    assert merge_log(one, path, ["query_id"]) == [day[0].date(), day[1].date(), None]
    assert kept(spark, path, *shown) == before
    # b moves to another day with a new time, and its old day keeps the row without an id.
    two = history(spark, {"query_id": "b", "start_time": day[3], "total_elapsed_time": 7},
                  {"query_id": "n", "start_time": day[2]})
    assert merge_log(two, path, ["query_id"]) == [d.date() for d in day[1:4]] + [None]
    assert [r[:3] for r in kept(spark, path, *shown)] == [
        ("a", day[0], 1000), ("b", day[3], 7), ("n", day[2], 1000), (None, day[1], 1000)
    ]
    # The day without rows has no folder any more.
    assert not (tmp_path / "log" / "start_date=__HIVE_DEFAULT_PARTITION__").exists()
    stored = StoredLogs(spark, {"query_history": path}, by_day=True)
    assert UsageViews(stored, user=ADMINISTRATOR).scoped("2024-01-04", "2024-01-05").queries.count() == 1


def test_versions_win_in_any_order(spark, tmp_path):
    def version(number, *changes):
        return history(spark, *changes).withColumn("version", F.lit(number))

    a1 = version(1, {"query_id": "a", "total_elapsed_time": 1}, {"query_id": "b", "total_elapsed_time": 1})
    a2 = version(2, {"query_id": "a", "total_elapsed_time": 2})
    both = version(3, {"query_id": "c", "total_elapsed_time": 3}).union(
        version(4, {"query_id": "c", "total_elapsed_time": 4})
    )
    found = []
    for k, order in enumerate(([a1, a2, both], [both, a2, a1], [a2, a1, a2, both, a1])):
        path = str(tmp_path / str(k))
        for part in order:
            merge_log(part, path, ["query_id"], "version")
        found.append(kept(spark, path, "query_id", "total_elapsed_time"))
    assert found == [[("a", 2), ("b", 1), ("c", 4)]] * 3


def test_deliveries_of_another_form_are_refused(spark, tmp_path):
    path = str(tmp_path / "log")
    merge_log(history(spark, {"query_id": "a"}), path, ["query_id"])
    with pytest.raises(ValueError):
        merge_log(history(spark, {"query_id": "a"}).drop("error_code"), path, ["query_id"])
    with pytest.raises(ValueError):
        merge_log(spark.range(1), path, ["id"])


def test_whole_days_replace_days(spark, tmp_path):
    path = str(tmp_path / "qa")
    one = _frame(spark, [entry("a"), entry("a"), entry("b", start_time=dt.datetime(2024, 1, 8))], schemas.ATTRIBUTION)
    two = _frame(spark, [entry("a")], schemas.ATTRIBUTION)
    for _ in range(2):
        replace_days(one, path)
    assert spark.read.parquet(path).count() == 3
    assert replace_days(two, path) == [dt.date(2024, 1, 6)]
    assert kept(spark, path, "query_id") == [("a",), ("b",)]


def test_an_empty_delivery_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    merge_log(history(spark, {"query_id": "a"}), path, ["query_id"])
    assert merge_log(history(spark, {"query_id": "a"}).where("false"), path, ["query_id"]) == []
    assert kept(spark, path, "query_id") == [("a",)]


def test_stretches():
    day = [dt.date(2024, 2, d) for d in (27, 28, 29)]
    march = dt.date(2024, 3, 1)
    assert stretches([march, day[0], day[2], day[2]]) == [(day[0], day[0]), (day[2], march)]
    assert stretches([]) == []


@pytest.mark.parametrize("measure", [warehouse.warehouse_daily, queries.spill_daily, ai.ai_daily])
def test_kept_days_equal_the_full_computation(spark, tmp_path, measure):
    place = str(tmp_path / "qh")
    days = [dt.datetime(2024, 1, d, 12) for d in range(1, 8)]
    made = lambda k, d, **c: query(f"q{k}", start_time=d, bytes_spilled_to_local_storage=k, **c)
    whole = _frame(spark, [made(k, d) for k, d in enumerate(days)], schemas.QUERY_HISTORY)
    merge_log(whole, place, ["query_id"])
    entries = _frame(spark, [entry(f"q{k}", start_time=d) for k, d in enumerate(days)], schemas.ATTRIBUTION)
    store_log(entries, str(tmp_path / "qa"))
    calls = spark.createDataFrame([(f"q{k}", 1, "F", "M", k, Decimal(k)) for k in range(8)], schemas.AI_FUNCTIONS)
    store_log(calls, str(tmp_path / "ai"))
    logs = {"query_history": place, "attribution": str(tmp_path / "qa"), "ai_functions": str(tmp_path / "ai")}

    def now():
        stored = StoredLogs(spark, logs, by_day=("query_history", "attribution"))
        return UsageViews(stored, user=ADMINISTRATOR)

    state = DailyState(now(), str(tmp_path / "kept"), measure)
    assert rows(state.between("2024-01-01", "2024-01-31", WHOLE_DAY)) == []
    state.refresh(d.date() for d in days)
    for _ in range(2):
        for span in (("2024-01-01", "2024-01-31"), ("2024-01-02", "2024-01-05")):
            for rule in (WHOLE_DAY, "midnight"):
                full = measure(now(), *span, end_rule=rule)
                assert sorted(rows(state.between(*span, rule)), key=str) == sorted(rows(full), key=str)
        # A correction moves one query to another day; its old day has none left.
        touched = merge_log(history(spark, made(3, days[0], total_elapsed_time=5)), place, ["query_id"])
        state = DailyState(now(), str(tmp_path / "kept"), measure)
        state.refresh(touched)
        state.refresh(touched)


def test_the_day_before_comes_from_folder_names(spark, tmp_path):
    path = str(tmp_path / "md")
    log = _frame(spark, [metering("S", f"2024-01-{d:02}", str(d)) for d in (1, 3, 9, 12)], schemas.METERING)
    store_log(log, path)
    stored = StoredLogs(spark, {"metering": path}, by_day=True)
    result = accounts.cost_daily(UsageViews(stored, user=ADMINISTRATOR), "2024-01-05", "2024-01-31")
    assert sorted(rows(result)) == [(dt.date(2024, 1, 9), 9.0, 6.0), (dt.date(2024, 1, 12), 12.0, 3.0)]
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(result))
    assert any("= 2024-01-03" in f and ">=" not in f for f in filters)
    read = spark.read.parquet(path)
    assert last_day_before(read, "usage_date", dt.date(2024, 1, 1)) is None
    first = accounts.cost_daily(UsageViews(stored, user=ADMINISTRATOR), "2024-01-01", "2024-01-02")
    assert rows(first) == [(dt.date(2024, 1, 1), 1.0, None)]


def test_distinct_counts_add_up_over_days(spark, tmp_path):
    days = [dt.datetime(2024, 1, d, 12) for d in range(1, 6)]
    users = ["A", "B", "A", None, "C"]
    place = str(tmp_path / "qh")
    made = [query(f"q{k % 3}", start_time=d, user_name=u, execution_status="FAIL", error_code=f"E{k % 2}")
            for k, (d, u) in enumerate(zip(days, users, strict=True))]
    store_log(_frame(spark, made, schemas.QUERY_HISTORY), place)
    logs = UsageViews(StoredLogs(spark, {"query_history": place}, by_day=True), user=ADMINISTRATOR)
    ids = DistinctDays(logs, str(tmp_path / "ids"), query_ids)
    hit = DistinctDays(logs, str(tmp_path / "users"), failing_users, ("error_code",))
    assert rows(ids.between("2024-01-01", "2024-01-05")) == [(0,)]
    for part in (days[3:], days[:2], days):
        ids.refresh(d.date() for d in part)
        hit.refresh(d.date() for d in part)
    for a in range(1, 6):
        for b in range(a, 6):
            span = (f"2024-01-{a:02}", f"2024-01-{b:02}")
            log = logs.scoped(*span, end_rule=WHOLE_DAY).queries
            expected = log.select("query_id").distinct().count()
            assert rows(ids.between(*span)) == [(expected,)]
            full = log.groupBy("error_code").agg(F.count_distinct("user_name").alias("n"))
            assert sorted(rows(hit.between(*span))) == sorted(rows(full))
    numbers = spark.read.parquet(str(tmp_path / "ids" / "numbers"))
    assert sorted(r["number"] for r in numbers.collect()) == [0, 1, 2]


def test_bitmaps_beyond_one_bucket(spark, tmp_path):
    place = str(tmp_path / "qh")
    history = spark.range(70_000).select(
        F.concat(F.lit("q"), F.col("id")).alias("query_id"),
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.QUERY_HISTORY if f.name not in ("query_id", "start_time")),
        (F.lit(FIRST) + F.make_dt_interval((F.col("id") % 2).cast("int"))).cast("timestamp_ntz").alias("start_time"),
    )
    store_log(history.select(*schemas.QUERY_HISTORY.names), place)
    logs = UsageViews(StoredLogs(spark, {"query_history": place}, by_day=True), user=ADMINISTRATOR)
    ids = DistinctDays(logs, str(tmp_path / "ids"), query_ids)
    ids.refresh([dt.date(2024, 1, 1), dt.date(2024, 1, 2)])
    assert rows(ids.between("2024-01-01", "2024-01-02")) == [(70_000,)]
    assert rows(ids.between("2024-01-02", "2024-01-02")) == [(35_000,)]


def test_sql_functions_prune_and_refuse(spark, many_days):
    stored = StoredLogs(spark, many_days, by_day=True)
    mine = UsageViews(stored, user="U7")
    names = register_functions(mine, "mine_")
    assert names == ["mine_user_overview", "mine_warehouse_daily", "mine_spill_daily"]
    found = spark.sql("SELECT * FROM mine_user_overview(DATE'2024-01-20', DATE'2024-01-20', end_rule => 'whole_day')")
    assert rows(found) == rows(overview_of(spark, many_days))
    filters = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(found))
    assert any("start_date" in f and "2024-01-20" in f for f in filters)
    for call in ("DATE'2024-01-20', DATE'2024-01-19'", "NULL, DATE'2024-01-19'", "DATE'2024-01-01', DATE'2024-01-19', 'noon'"):
        with pytest.raises(SparkRuntimeException):
            spark.sql(f"SELECT * FROM mine_user_overview({call})").collect()
    with pytest.raises(ValueError):
        register_functions(mine.scoped("2024-01-01", "2024-01-02"))


def test_links_follow_session_variables(spark):
    made = views(spark, [query("a")])
    followed = lambda: UsageViews(made._logs, user=ADMINISTRATOR, account_of_session=True)
    declare_account(spark, "O1", "A1")
    assert "/O1/A1/" in followed().scoped("2024-01-05", "2024-01-10").queries.first()["query_id_url"]
    spark.sql("SET VARIABLE usage_account = 'A2'")
    assert "/O1/A2/" in followed().queries.first()["query_id_url"]
    declare_account(spark)
    assert followed().queries.first()["query_id_url"] is None


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_exports_are_held_against_their_manifest(spark, tmp_path, file_format):
    frame = spark.createDataFrame([(k, f"t{k}", float(k)) for k in range(50)], "a long, b string, c double")
    path = tmp_path / "export"
    export_result(frame.repartition(3, "a"), str(path), file_format, "NULL", manifest=True)
    read = lambda: read_export(spark, str(path), frame.schema, file_format, "NULL", verify=True)
    assert sorted(rows(read())) == sorted(rows(frame))
    files = sorted(f for f in path.iterdir() if f.name.startswith("part-") and f.stat().st_size)
    held = files[0].read_bytes()
    files[0].unlink()
    with pytest.raises(ValueError, match="differs"):
        read()
    files[0].write_bytes(held)
    # Another file's rows under this name.
    crc = path / f".{files[0].name}.crc"
    if crc.exists():
        crc.unlink()
    files[0].write_bytes(files[1].read_bytes())
    with pytest.raises(ValueError, match=files[0].name):
        read()
    files[0].write_bytes(held)
    assert read().count() == 50
    (path / "part-more.parquet").write_bytes(held)
    with pytest.raises(ValueError, match="part-more"):
        read()


def test_an_export_without_a_manifest_is_not_complete(spark, tmp_path):
    frame = spark.range(3)
    export_result(frame, str(tmp_path / "x"))
    assert read_export(spark, str(tmp_path / "x"), frame.schema).count() == 3
    with pytest.raises(ValueError, match="no manifest"):
        read_export(spark, str(tmp_path / "x"), frame.schema, verify=True)
    export_result(frame.where("false"), str(tmp_path / "none"), manifest=True)
    assert read_export(spark, str(tmp_path / "none"), frame.schema, verify=True).count() == 0
