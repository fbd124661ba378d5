"""The operators Spark has no distributed form of, against plain computations."""

import random

import numpy as np
import pytest
from frames import rows
from pyspark.sql import functions as F

from meterlight import session
from meterlight.operators.numbering import number_rows
from meterlight.operators.percentile import exact_percentile
from meterlight.operators.ranking import top_ranks


def _values(kind, size, rng):
    if kind == "small":
        return [rng.randint(-5, 5) for _ in range(size)]
    if kind == "wide":
        return [rng.randint(-(2**62), 2**62) for _ in range(size)]
    if kind == "hot":
        return [7 if rng.random() < 0.4 else rng.randint(0, 2**41) for _ in range(size)]
    return [rng.randint(2**40 - 3, 2**40 + 3) for _ in range(size)]


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.95, 1.0])
def test_percentile(spark, fraction):
    rng = random.Random(1)
    data = {
        group: _values(kind, size, rng)
        for group, (kind, size) in {
            "one": ("small", 1), "two": ("edge", 2), "small": ("small", 101),
            "hot": ("hot", 300), "edge": ("edge", 50), "wide": ("wide", 40), None: ("hot", 33),
        }.items()
    }
    pairs = [(g, v) for g, vs in data.items() for v in [*vs, None]]
    frame = spark.createDataFrame(pairs, "g string, v bigint")
    found = dict(rows(exact_percentile(frame, ["g"], "v", fraction, "p")))
    assert found.keys() == data.keys()
    for group, values in data.items():
        ordered = sorted(values)
        place = (len(ordered) - 1) * fraction
        low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        expected = low + (high - low) * (place - np.floor(place))
        assert found[group] == pytest.approx(expected, rel=1e-12)


def test_percentile_equals_the_builtin(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet").select(
        "event_type", F.floor(F.col("value") * 1000).alias("v")
    )
    found = exact_percentile(events, ["event_type"], "v", 0.95, "p")
    builtin = events.groupBy("event_type").agg(F.percentile("v", F.lit(0.95)).alias("p"))
    assert dict(rows(found)) == pytest.approx(dict(rows(builtin)))


def test_percentile_without_groups_and_without_rows(spark):
    numbers = spark.range(101).select(F.col("id").alias("v"))
    assert rows(exact_percentile(numbers, [], "v", 0.5, "p")) == [(50.0,)]
    assert rows(exact_percentile(numbers.where("v < 0"), [], "v", 0.5, "p")) == [(None,)]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_row_numbers(spark, monkeypatch, broadcast):
    monkeypatch.setattr(session, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "cold", None]), rng.randint(0, 3), f"s{i:05d}")
            for i in range(2000)]
    frame = spark.createDataFrame(data, "g string, v int, s string").repartition(5)
    order = [F.col("v").desc(), F.col("s").asc()]
    found = sorted(rows(number_rows(frame, ["g"], order, "n")), key=repr)
    expected = []
    for group in {row[0] for row in data}:
        members = sorted((r for r in data if r[0] == group), key=lambda r: (-r[1], r[2]))
        expected += [(*row, place) for place, row in enumerate(members, start=1)]
    assert found == sorted(expected, key=repr)


def test_row_numbers_spread_a_large_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(4000).select(F.lit("all").alias("g"), "id")
        numbered = number_rows(frame, ["g"], [F.col("id").desc()], "n")
        assert numbered.where(F.col("n") + F.col("id") != 4000).count() == 0
        assert numbered.inputFiles().__len__() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("broadcast", [0, 1000])
@pytest.mark.parametrize("count", [1, 3, 10, 50])
def test_top_ranks(spark, monkeypatch, count, broadcast):
    monkeypatch.setattr(session, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    data = [(i, rng.randint(0, 12)) for i in range(60)] + [(99, None)]
    found = set(rows(top_ranks(spark.createDataFrame(data, "id int, v int"), "v", count, "r")
                     .select("id", "r")))
    known = [(i, v) for i, v in data if v is not None]
    ranks = {(i, 1 + sum(w > v for _, w in known)) for i, v in known}
    assert found == {(i, r) for i, r in ranks if r <= count}
