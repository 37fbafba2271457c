"""Every registered query against its SQL on DuckDB, row for row."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from riskloom.plans import PLANS
from tests.conftest import DATA, TABLES

# Other scales by hand: TEST_SCALES=sf0.001,sf0.01,sf0.1
SCALES = os.environ.get("TEST_SCALES", "sf0.01").split(",")
# The corpus operators have tests of their own.
QUERIES = {name: plan.run for name, plan in PLANS.items()}
SQL = {name: sql for name, sql in contract.oracle_sql().items() if name in PLANS}


def tables(scale):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{scale}/{name}.parquet')"
        )
    return connection


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


def check(spark, name, scale):
    mine = QUERIES[name](spark, f"{DATA}/{scale}").toPandas()
    theirs = tables(scale).execute(SQL[name]).df()
    mine, theirs = ordered(mine), ordered(theirs)
    for column in mine.columns:
        if pd.api.types.is_datetime64_any_dtype(mine[column]):
            theirs[column] = theirs[column].astype(mine[column].dtype)
    pd.testing.assert_frame_equal(mine, theirs, check_exact=False, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("scale", SCALES)
def test_same_as_sql(spark, name, scale):
    check(spark, name, scale)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_models_score_every_row(spark, name):
    rows = QUERIES[name](spark, f"{DATA}/sf0.01").toPandas()
    assert len(rows) == {"oof_predict": 399}.get(name, 86)
    assert rows["doc_id"].is_unique
    assert rows["p"].between(0, 1).all()


def test_entry(spark):
    rows = contract.entry(spark).toPandas()
    assert len(rows) == 150
    assert list(rows.columns) == ["c_custkey", "fact_count", "fact_sum", "fact_mean", "fact_max"]
