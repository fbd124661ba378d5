"""Every analysis on empty logs and on logs whose rows are all NULL: answers, no failures."""

import pytest
from frames import rows, views

from meterlight import schemas
from meterlight.plans.catalog import ANALYSES

LOGS = {
    "queries": schemas.QUERY_HISTORY,
    "entries": schemas.ATTRIBUTION,
    "meter": schemas.METERING,
    "ai": schemas.AI_FUNCTIONS,
    "chats": schemas.AI_ANALYST,
    "snapshots": schemas.STORAGE_SNAPSHOTS,
}
# Rows without any log row: totals over everything, and the cases that are told apart.
ROWS = {
    "user_overview": 1,
    "user_overview_rls": 1,
    "user_overview_empty": 1,
    "user_overview_whole_day": 1,
    "user_overview_sql": 1,
    "user_overview_sql_whole_day": 1,
    "format_overview": 1,
    "format_overview_whole_day": 1,
    "sum_coalesce": 1,
    "avg_elapsed": 1,
    "count_distinct_queries": 1,
    "default_range": 2,
    "budget_scenarios": 3,
}


@pytest.fixture(scope="module")
def null_rows(spark):
    return views(
        spark, **{log: [dict.fromkeys(schema.names)] * 3 for log, schema in LOGS.items()}
    )


@pytest.fixture(scope="module")
def no_rows(spark):
    return views(spark)


@pytest.mark.parametrize("name", sorted(ANALYSES))
def test_answers(null_rows, no_rows, name):
    analysis = ANALYSES[name]
    nothing = analysis.result(no_rows, *analysis.args, **analysis.options)
    assert len(rows(nothing)) == ROWS.get(name, 0)
    rows(analysis.result(null_rows, *analysis.args, **analysis.options))
