"""Trailing features of a stream: late facts, restarts, equal to the batch operator."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import trailing_features
from riskloom.streaming import run_available, trailing_stream

SCHEMA = "id long, who string, at timestamp_ntz, amount double"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


@pytest.fixture
def feed(spark, tmp_path):
    """Puts rows in the stream's folder as one file; gives the stream."""

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def stream(**options):
        return spark.readStream.schema(SCHEMA).options(**options).parquet(f"file://{tmp_path}/in")

    return put, stream


def got(run):
    return {(r["who"], (r["as_of"] - dt.date(2024, 1, 1)).days): (r["trailing_count"], r["trailing_sum"]) for r in run.df.collect()}


def test_closed_days_only(feed):
    put, stream = feed
    put([(1, "a", day(0, 5), 1.1), (2, "a", day(0, 23), 2.2), (3, "a", day(1), None), (4, None, day(0), 0.4), (5, "a", None, 9.0), (6, "b", day(4), 7.0)])
    run = run_available(trailing_stream(stream(), "who", "at", "amount", 2, 1, scale=2))
    # The last fact closes all up to day 3. None of these facts is on day 2, so none is told of on day 4.
    assert got(run) == {("a", 1): (2, 3.3), ("a", 2): (3, 3.3), ("a", 3): (1, 0.0), (None, 1): (1, 0.4), (None, 2): (1, 0.4)}
    assert run.late == 0


def test_late_facts_and_restart(feed, tmp_path):
    put, stream = feed
    where = f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    features = lambda: trailing_stream(stream(), "who", "at", "amount", 3, 2, scale=2)
    put([(1, "a", day(0), 1.0), (2, "a", day(5), 2.0)])
    first = run_available(features(), *where)
    assert got(first) == {("a", 1): (1, 1.0), ("a", 2): (1, 1.0), ("a", 3): (1, 1.0)} and first.late == 0
    # Day 4 is open still, day 1 is not.
    put([(3, "a", day(4), 4.0), (4, "a", day(1), 8.0), (5, "b", day(1), 8.0), (6, "a", day(9), 1.0)])
    second = run_available(features(), *where)
    assert second.late == 2
    assert got(second) == got(first) | {("a", 5): (1, 4.0), ("a", 6): (2, 6.0), ("a", 7): (2, 6.0)}
    # Nothing new, nothing twice.
    third = run_available(features(), *where)
    assert got(third) == got(second) and third.df.count() == second.df.count()


def test_shuffled_stream_equals_batch(spark, feed):
    put, stream = feed
    facts = [(i, f"w{i % 7 if i % 3 else 0}", day(i * 37 % 60, i % 24), i % 100 / 4) for i in range(900)]
    # Files of facts up to nine days out of order.
    facts.sort(key=lambda f: (f[2] + dt.timedelta(days=f[0] * 13 % 10), f[0]))
    for at in range(0, 900, 300):
        put(facts[at : at + 300])
    run = run_available(trailing_stream(stream(maxFilesPerTrigger=1), "who", "at", "amount", 5, 10, scale=2))
    assert run.late == 0
    # One more fact a day and entity asks the batch operator for the same days.
    asked = [(1000 + d * 7 + w, f"w{w}", day(d), None) for d in range(60) for w in range(7)]
    rows = spark.createDataFrame(asked, SCHEMA)
    per_day = spark.createDataFrame(facts, SCHEMA)
    batch = trailing_features(per_day.unionByName(rows), "who", "at", "amount", 5, scale=2).filter("id >= 1000")
    # The asking facts count themselves on the five days before.
    wanted = batch.withColumn("n", F.col("trailing_count") - F.least(F.lit(5), F.datediff(F.col("at"), F.lit("2024-01-01"))))
    want = {(r["who"], (r["at"] - day(0)).days): (r["n"], r["trailing_sum"]) for r in wanted.collect() if r["n"]}
    assert got(run) == {k: v for k, v in want.items() if k[1] <= 49}
    assert len(got(run)) > 200


def test_empty_stream(feed):
    put, stream = feed
    put([])
    run = run_available(trailing_stream(stream(), "who", "at", "amount", 2, 1))
    assert run.df.count() == 0 and run.late == 0
