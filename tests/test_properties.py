"""What must hold for any data. Each example is a few Spark jobs, so there are few."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom import operators as ops

few = settings(
    max_examples=3,
    phases=[Phase.generate],
    deadline=None,
    derandomize=True,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
scores = st.lists(
    st.tuples(st.integers(0, 1), st.integers(-20, 20)), min_size=2, max_size=60
).filter(lambda pairs: len({y for y, _ in pairs}) == 2)
numbers = st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60)


def only(df, column):
    return df.first()[column]


@few
@given(scores)
def test_auc_depends_on_order_alone(spark, pairs):
    df = spark.createDataFrame([(y, float(s)) for y, s in pairs], "y int, s double")
    value = only(ops.auc(df, "y", "s"), "auc")
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert value == pytest.approx(wins / (len(pos) * len(neg)))
    stretched = df.withColumn("s", F.exp(F.col("s") / 5) + F.col("s"))
    assert only(ops.auc(stretched, "y", "s"), "auc") == value
    turned = df.withColumn("s", -F.col("s"))
    assert only(ops.auc(turned, "y", "s"), "auc") + value == pytest.approx(1)
    assert only(ops.ks(turned, "y", "s"), "ks") == pytest.approx(only(ops.ks(df, "y", "s"), "ks"))


@few
@given(numbers)
def test_psi_of_a_distribution_with_itself_is_zero(spark, values):
    df = spark.createDataFrame([(v, new) for v in values for new in (False, True)], "v double, new boolean")
    assert only(ops.psi(df, "v", F.col("new")), "psi") == 0


@few
@given(numbers, st.integers(1, 12))
def test_bins_are_even_and_in_order(spark, values, k):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(3)
    found = ops.quantile_bin(df, "v", k, "id").orderBy("v", "id").collect()
    bins = [r["v_bin"] for r in found]
    assert bins == sorted(bins)
    sizes = [bins.count(b) for b in range(1, k + 1)]
    assert sum(sizes) == len(values)
    assert sizes == sorted(sizes, reverse=True)
    assert max(sizes) - min(sizes) <= 1


@few
@given(st.sets(st.integers(0, 10**12), min_size=1, max_size=80), st.integers(2, 6))
def test_folds_part_the_rows(spark, ids, k):
    df = spark.createDataFrame([(i, i % 2) for i in ids], "id bigint, y int")
    for folds in (ops.hash_split(df, "id", k), ops.stratified_folds(df, "y", "id", k)):
        again = folds.sparkSession.createDataFrame(df.collect(), df.schema).repartition(5)
        assert sorted(r["id"] for r in folds.collect()) == sorted(ids)
        assert folds.filter(~F.col("fold").between(0, k - 1)).count() == 0
    first = {r["id"]: r["fold"] for r in folds.collect()}
    second = {r["id"]: r["fold"] for r in ops.stratified_folds(again, "y", "id", k).collect()}
    assert first == second
    for y in (0, 1):
        sizes = [sum(f == g and i % 2 == y for i, f in first.items()) for g in range(k)]
        assert max(sizes) - min(sizes) <= 1


@few
@given(numbers, st.floats(0, 0.5))
def test_clipping_stays_between_its_quantiles(spark, values, low):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clipped = [r["v"] for r in ops.clip_quantiles(df, "v", low, 1 - low).collect()]
    assert min(values) <= min(clipped) and max(clipped) <= max(values)
    assert len(clipped) == len(values)
    again = [r["v"] for r in ops.clip_quantiles(df, "v", 0, 1).collect()]
    assert sorted(again) == pytest.approx(sorted(values))


@few
@given(scores)
def test_partitioning_changes_no_result(spark, pairs):
    df = spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(pairs)], "id int, y int, s double")

    def results(frame):
        gain = [tuple(r) for r in ops.gain_table(frame, "y", "s", "id", 4).orderBy("bin").collect()]
        rank = ops.rank_blend(frame, ["s"], [1.0], "id").orderBy("id").collect()
        return gain, [r["blend"] for r in rank], only(ops.auc(frame, "y", "s"), "auc")

    one, many = results(df.coalesce(1)), results(df.repartition(7))
    assert one == many
    assert all(math.isfinite(b) for b in one[1])
