"""All results on samples where single keys hold a third of all rows and any column may be NULL."""

import duckdb
import pytest
from test_oracle import TABLES, compare

from meterlight.plans.catalog import QUERIES


def replaced(**columns):
    return "* REPLACE (" + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + ")"


HOT = {
    # one query with a third of all attribution, one supplier (service) with a third of metering
    "lineitem": replaced(
        l_orderkey="CASE WHEN l_partkey % 3 = 0 THEN 40 WHEN l_partkey % 29 = 0 THEN NULL "
        "ELSE l_orderkey END",
        l_suppkey="CASE WHEN l_partkey % 3 = 1 THEN 9 WHEN l_partkey % 23 = 0 THEN NULL "
        "ELSE l_suppkey END",
        l_quantity="CASE WHEN l_partkey % 19 <> 0 THEN l_quantity END",
        l_discount="CASE WHEN l_partkey % 17 <> 0 THEN l_discount END",
        l_tax="CASE WHEN l_partkey % 13 <> 0 THEN l_tax END",
        l_shipdate="CASE WHEN l_partkey % 31 <> 0 THEN l_shipdate END",
    ),
    # one user, and so one warehouse, with a third of all queries
    "events": replaced(
        user_id="CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 19 = 0 THEN NULL "
        "ELSE user_id END",
        event_type="CASE WHEN event_id % 23 <> 0 THEN event_type END",
        ts="CASE WHEN event_id % 17 <> 0 THEN ts END",
        value="CASE WHEN event_id % 13 <> 0 THEN value END",
    ),
    # one query with a third of all AI calls, one source with a third of all storage
    "documents": replaced(
        doc_id="CASE WHEN doc_id % 3 = 0 THEN 40 WHEN doc_id % 29 = 0 THEN NULL ELSE doc_id END",
        source="CASE WHEN doc_id % 3 = 1 THEN 'hot' WHEN doc_id % 7 = 0 THEN NULL "
        "ELSE source END",
        lang="CASE WHEN doc_id % 11 <> 0 THEN lang END",
        n_chars="CASE WHEN doc_id % 13 <> 0 THEN n_chars END",
    ),
    # one chat with a third of all turns
    "conversations": replaced(
        conv_id="CASE WHEN conv_id % 3 = 0 THEN 40 WHEN conv_id % 7 = 0 THEN NULL "
        "ELSE conv_id END",
        turn="CASE WHEN conv_id % 5 <> 0 THEN turn END",
    ),
}


@pytest.fixture(scope="module")
def skewed(small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for table in TABLES:
        columns = HOT.get(table, "*")
        duckdb.sql(
            f"COPY (SELECT {columns} FROM '{small}/{table}.parquet') "
            f"TO '{folder}/{table}.parquet' (FORMAT parquet)"
        )
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_skewed(spark, skewed, name):
    compare(spark, skewed, name)


@pytest.fixture(scope="module")
def in_many_files(spark, skewed, tmp_path_factory):
    """The skewed tables as twelve files each, so that many tasks read them."""
    folder = tmp_path_factory.mktemp("files")
    for table in HOT:
        rows = spark.read.parquet(f"{skewed}/{table}.parquet")
        rows.repartition(12).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["join_history_attribution", "scan_attribution", "warehouse_daily", "warehouse_trend",
     "top_users", "scan_ai_analyst", "ai_query_view"],
)
def test_hot_rows_are_split_over_tasks(spark, in_many_files, name):
    """AQE splits the hot id of every join of raw log rows (thresholds scaled down to the sample)."""
    small_parts = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64b",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {key: spark.conf.get(key) for key in small_parts}
    for key, value in small_parts.items():
        spark.conf.set(key, value)
    try:
        frame = QUERIES[name](spark, in_many_files)
        frame.collect()
        text = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in text.split("Initial Plan")[0]
