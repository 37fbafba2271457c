"""Facts met with the intervals that hold them."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.operators import interval_join, intervals
from tests.test_plans import plan_of

FACTS, INTERVALS = "id long, k string, at double", "k string, name long, lo double, hi double"


def brute(facts, spans, keyed=True):
    return Counter(
        (i, name)
        for i, k, at in facts
        for key, name, lo, hi in spans
        if at is not None
        and (not keyed or (k == key and k is not None))
        and (lo is None or at >= lo)
        and (hi is None or at < hi)
    )


def made(seed, n=400):
    r = random.Random(seed)
    key = lambda: r.choice(["hot", "hot", "x", "y", None])
    facts = [(i, key(), r.choice([None, 0.0, -50.0, 100.0, r.uniform(-50, 100), float(r.randint(-50, 100))])) for i in range(n)]
    spans = []
    for name in range(n // 4):
        lo = r.choice([None, r.uniform(-80, 120), float(r.randint(-50, 100))])
        length = r.choice([None, 0.0, -3.0, 1e-9, 1.0, 40.0, 1e6])
        spans.append((key(), name, lo, None if length is None else (lo or 0.0) + length))
    return facts + facts[:5], spans + spans[:5]


@pytest.mark.parametrize("broadcast", [0, 1 << 30])
@pytest.mark.parametrize("keys", [["k"], []])
def test_equals_brute_force(spark, setting, broadcast, keys):
    setting("spark.riskloom.broadcastBytes", broadcast)
    facts, spans = made(len(keys))
    left = spark.createDataFrame(facts, FACTS)
    right = spark.createDataFrame(spans, INTERVALS)
    right = right if keys else right.withColumnRenamed("k", "other")
    rows = interval_join(left, right, "at", "lo", "hi", keys).collect()
    assert Counter((r["id"], r["name"]) for r in rows) == brute(facts, spans, bool(keys))


def test_hot_cell_is_split(spark, setting):
    setting("spark.riskloom.broadcastBytes", 0)
    setting("spark.riskloom.hotShare", 0.2)
    facts = spark.range(3000).select("id", F.lit("hot").alias("k"), F.when(F.col("id") < 2990, 5.0).otherwise(F.col("id").cast("double")).alias("at"))
    spans = spark.createDataFrame([("hot", 1, 4.0, 6.0), ("hot", 2, 5.0, None), ("x", 3, 0.0, 9.0)], INTERVALS)
    rows = interval_join(facts, spans, "at", "lo", "hi", ["k"])
    assert "_salt" in plan_of(rows) and "CartesianProduct" not in plan_of(rows) and "NestedLoop" not in plan_of(rows)
    assert {r["name"]: r["count"] for r in rows.groupBy("name").count().collect()} == {1: 2990, 2: 3000}


def test_facts_that_meet_nothing(spark):
    facts = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0), (3, None, 1.0), (4, "a", None), (5, "a", float("nan"))], FACTS)
    spans = spark.createDataFrame([("a", 7, 0.0, 2.0), ("a", 8, 1.0, 1.0), (None, 9, None, None)], INTERVALS)
    got = interval_join(facts, spans, "at", "lo", "hi", ["k"], id="id").collect()
    assert sorted((r["id"], r["name"]) for r in got if r["name"]) == [(1, 7)]
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5]


def test_times_and_empty_tables(spark):
    moment = dt.datetime(2024, 3, 31, 2, 30)
    facts = spark.createDataFrame([(1, moment)], "id long, at timestamp_ntz")
    spans = spark.createDataFrame(
        [(1, moment, moment + dt.timedelta(microseconds=1)), (2, moment - dt.timedelta(days=9), moment)],
        "name long, lo timestamp_ntz, hi timestamp_ntz",
    )
    assert [r["name"] for r in interval_join(facts, spans, "at", "lo", "hi").collect()] == [1]
    none, some = facts.filter("false"), spans.filter("false")
    assert interval_join(none, spans, "at", "lo", "hi").count() == 0
    assert interval_join(facts, some, "at", "lo", "hi").count() == 0
    assert interval_join(facts, some, "at", "lo", "hi", id="id").count() == 1
    with pytest.raises(TypeError):
        interval_join(facts.withColumn("at", F.to_date("at")), spans, "at", "lo", "hi")


def test_long_intervals_touch_two_cells(spark, monkeypatch):
    seen = []
    real = intervals.freeze_measured
    monkeypatch.setattr(intervals, "freeze_measured", lambda df: seen.append(real(df)) or seen[-1])
    facts = spark.range(1000).select("id", F.col("id").cast("double").alias("at"))
    spans = spark.range(500).select(F.col("id").alias("name"), F.lit(0.5).alias("lo"), (F.col("id") + 400.0).alias("hi"))
    assert interval_join(facts, spans, "at", "lo", "hi").count() == sum(399 + i for i in range(500))
    assert seen[0].rows <= 1000
