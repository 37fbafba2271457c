"""What Spark is asked to run, for every registered query: the plans of its final result and
of every table it writes or row it fetches on the way."""

from __future__ import annotations

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from riskloom.plans import PLANS
from tests.conftest import DATA

QUERIES = {name: plan.run for name, plan in PLANS.items()}
# Fitting runs Spark's own jobs besides; these have a test of their own.
FITTING = {"fit_predict_logistic", "fit_predict_gbt", "oof_predict", "oof_predict_folds"}
TEXT_FREE = {
    "auc",
    "calibration",
    "chi_square",
    "gain_table",
    "group_rare",
    "ks",
    "target_encode_oof",
    "threshold_table",
    "woe_iv",
}


def plan_of(df):
    # Analysed anew: a plan that has run shows its final form as well.
    return df.filter("true")._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=sorted(QUERIES.keys() - FITTING))
def plans(request, spark, monkeypatch):
    seen = []

    def watch(owner, name, frame):
        real = getattr(owner, name)

        def run(self, *args, **kwargs):
            seen.append(plan_of(frame(self)))
            return real(self, *args, **kwargs)

        monkeypatch.setattr(owner, name, run)

    watch(DataFrame, "collect", lambda df: df)
    watch(DataFrame, "count", lambda df: df)
    watch(DataFrameWriter, "parquet", lambda writer: writer._df)
    watch(DataFrameWriter, "save", lambda writer: writer._df)
    result = QUERIES[request.param](spark, f"{DATA}/sf0.01")
    seen.append(plan_of(result))
    return request.param, seen


def test_plans(plans):
    name, seen = plans
    for plan in seen:
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), plan
        assert not re.search("PythonUDF|EvalPython|InPandas", plan), plan
        lines = plan.splitlines()
        for line, below in zip(lines, lines[1:]):
            if "Exchange SinglePartition" in line:
                # Nothing but aggregates comes together in one task: one row per partition
                # (no keys), or one per bucket, sort partition, bin or group of the result.
                assert re.search(r"Aggregate\(keys?=\[", below), plan
    if name in TEXT_FREE:
        assert not any(re.search(r"ReadSchema: struct<[^>]*\btext:", plan) for plan in seen)


def test_cutoff_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["entity_features"](spark, f"{DATA}/sf0.01"))
    assert "LessThan(o_orderdate,2000-01-01" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "ReadSchema: struct<c_custkey:bigint>" in plan


def test_events_of_other_types_are_not_shuffled(spark):
    plan = plan_of(QUERIES["last_event_asof"](spark, f"{DATA}/sf0.01"))
    assert re.search(r"PushedFilters: \[Or\(EqualTo\(event_type,click\),EqualTo\(event_type,view\)\)", plan)


def test_bucketed_order_scans_once(spark):
    """The bucket totals reuse the exchange of the counted values."""
    df = QUERIES["ks"](spark, f"{DATA}/sf0.01")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(FITTING))
def test_fitting_reads_the_tables_once_for_training(spark, monkeypatch, name):
    """Training rows are written narrow, and every stage of the fit reads what was written."""
    written = []
    real = DataFrameWriter.parquet

    def watch(writer, path, *args, **kwargs):
        written.append(writer._df.columns)
        return real(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watch)
    plan = plan_of(QUERIES[name](spark, f"{DATA}/sf0.001"))
    fits = 3 if name.startswith("oof") else 1
    assert sum(columns == ["lang", "source", "n_chars", "quality"] for columns in written) == fits
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"ReadSchema: struct<[^>]*\btext:", plan)


def test_only_narrow_rows_are_put_in_order(spark, monkeypatch):
    """Columns besides key, id and value stay out of the ordering shuffle."""
    from pyspark.sql import functions as F

    from riskloom.operators import rank_blend, stratified_folds

    rows = spark.range(200).select(
        "id", (F.col("id") % 2).alias("y"), F.rand(1).alias("s"), F.lit("wide").alias("payload")
    )
    seen = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(
        DataFrameWriter, "parquet", lambda w, *a, **k: (seen.append(w._df), real(w, *a, **k))[1]
    )
    for df in (rank_blend(rows, ["s"], [1.0], "id"), stratified_folds(rows, "y", "id", 5)):
        assert "payload" in df.columns and df.count() == 200
    assert seen and not any("payload" in df.columns for df in seen)
