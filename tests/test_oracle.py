"""Every registered result against DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from meterlight.oracle import ORACLE_SQL
from meterlight.plans.catalog import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, (decimal.Decimal, float)):
        number = float(value)
        return ("nan",) if math.isnan(number) else float(f"{number:.12g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda index: names[index])
    cells = [tuple(plain(row[index]) for index in order) for row in rows]
    return sorted(cells, key=repr)


SPARK_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def duck(folder):
    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def compare(spark, folder, name):
    result = QUERIES[name](spark, folder)
    answer = duck(folder).execute(ORACLE_SQL[name])
    columns = [part[0] for part in answer.description]
    kinds = {part[0]: str(part[1]) for part in answer.description}
    assert sorted(result.columns) == sorted(columns)
    assert {c: SPARK_KINDS[k] for c, k in result.dtypes} == kinds
    found = normal(result.columns, [tuple(row) for row in result.collect()])
    expected = normal(columns, answer.fetchall())
    assert len(found) == len(expected)
    assert found == expected


def test_every_result_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, medium, name):
    compare(spark, medium, name)
