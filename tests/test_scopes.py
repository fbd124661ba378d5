"""Every analysis for a date range and for one user, against DuckDB over the narrowed logs."""

import inspect

import pytest
from test_oracle import duck, normal

from meterlight import ADMINISTRATOR, SampleLogs, UsageViews, oracle
from meterlight.plans.catalog import ANALYSES, DAYS, USER

NAMES = sorted(
    name
    for name, analysis in ANALYSES.items()
    if not analysis.args and "user" in inspect.signature(analysis.result).parameters
)


def narrowed(name, days, user):
    """The analysis's SQL with the logs cut to the range and the user."""
    during = f"start_time >= DATE '{days[0]}' AND start_time <= DATE '{days[1]}'" if days else "1=1"

    def who(column):
        return f"{column} = '{user}'" if user else "1=1"

    def cut(log, column, when=during):
        return f"SELECT * FROM ({oracle._LOGS[log]}) WHERE {when} AND {who(column)}"

    attributed = "qa" if name == "top_queries_all" else f"({cut('qa', 'user_name', '1=1')})"
    logs = {
        "qh": cut("qh", "user_name"),
        "qa": cut("qa", "user_name"),
        "an": cut("an", "username"),
        "pq": oracle._LOGS["pq"].replace("FROM qa", f"FROM {attributed}"),
        "al": f"SELECT * FROM ({oracle._LOGS['al']}) WHERE query_id IN "
        f"(SELECT query_id FROM ({cut('qh', 'user_name')}))",
    }
    text = oracle.ORACLE_SQL[name]
    for log, body in logs.items():
        text = text.replace(f"{log} AS ({oracle._LOGS[log]})", f"{log} AS ({body})")
    assert text != oracle.ORACLE_SQL[name]
    return text


def after_the_window(name, days, user):
    """The analysis's SQL over all dates, and the range cut from its result."""
    text = narrowed(name, None, user) if user else oracle.ORACLE_SQL[name]
    during = f"usage_date BETWEEN DATE '{days[0]}' AND DATE '{days[1]}'" if days else "1=1"
    return f"SELECT * FROM ({text}) WHERE {during}"


@pytest.mark.parametrize("days, user", [(DAYS, None), (None, USER), (DAYS, USER)])
@pytest.mark.parametrize("name", NAMES)
def test_scope(spark, small, name, days, user):
    analysis = ANALYSES[name]
    start, end = days or (None, None)
    views = UsageViews(SampleLogs(spark, small), user=ADMINISTRATOR)
    result = analysis.result(views, start, end, user, **analysis.options)
    expected = after_the_window if name == "warehouse_trend" else narrowed
    answer = duck(small).execute(expected(name, days, user))
    columns = [part[0] for part in answer.description]
    found = normal(result.columns, [tuple(row) for row in result.collect()])
    assert found == normal(columns, answer.fetchall())
