"""Checking and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import (
    clip_quantiles,
    dominant_value,
    duplicate_keys,
    group_rare,
    impute_median,
    profile_columns,
    reference_gaps,
)
from riskloom.plans.plan import Plan
from riskloom.sources import read_table

_TYPED = ["l_orderkey", "l_returnflag", "l_shipdate"]
_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _customers_with_gaps(spark, folder):
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return customer.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(0)))


PLANS = {
    "profile_columns": Plan(
        lambda spark, folder: profile_columns(
            read_table(spark, folder, "lineitem"), _PROFILED, scale=2
        ),
        " UNION ALL ".join(
            f"""
            SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS nulls,
                   count(DISTINCT {c}) AS distinct_values,
                   min({c}) AS min_value, max({c}) AS max_value,
                   CAST(sum(CAST({c} AS DECIMAL(18, 2))) AS DOUBLE) / count({c}) AS mean_value
            FROM lineitem
            """
            for c in _PROFILED
        ),
    ),
    "profile_typed_columns": Plan(
        lambda spark, folder: profile_columns(
            read_table(spark, folder, "lineitem").withColumn(
                "l_shipdate", F.to_date("l_shipdate")
            ),
            _TYPED,
            as_text=True,
        ),
        " UNION ALL ".join(
            f"""
            SELECT '{c}' AS column_name, count(*) AS n, count(*) - count(v) AS nulls,
                   count(DISTINCT v) AS distinct_values, CAST(min(v) AS VARCHAR) AS min_value,
                   CAST(max(v) AS VARCHAR) AS max_value, {mean} AS mean_value
            FROM (SELECT {value} AS v FROM lineitem)
            """
            for c, value, mean in (
                ("l_orderkey", "l_orderkey", "CAST(sum(v) AS DOUBLE) / count(v)"),
                ("l_returnflag", "l_returnflag", "CAST(NULL AS DOUBLE)"),
                ("l_shipdate", "CAST(l_shipdate AS DATE)", "CAST(NULL AS DOUBLE)"),
            )
        ),
    ),
    "dominant_value": Plan(
        lambda spark, folder: dominant_value(read_table(spark, folder, "lineitem"), "l_returnflag"),
        """
        SELECT l_returnflag AS value, count(*) AS n,
               count(*) / (SELECT count(*) FROM lineitem) AS share
        FROM lineitem GROUP BY l_returnflag
        ORDER BY n DESC, value DESC LIMIT 1
        """,
    ),
    "duplicate_keys": Plan(
        lambda spark, folder: duplicate_keys(
            read_table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]
        ),
        """
        SELECT l_orderkey, l_linenumber, count(*) AS n
        FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
        """,
    ),
    "reference_gaps": Plan(
        lambda spark, folder: reference_gaps(
            read_table(spark, folder, "orders"),
            read_table(spark, folder, "lineitem"),
            {"o_orderkey": "l_orderkey"},
        ),
        """
        SELECT * FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
        """,
    ),
    "impute_median": Plan(
        lambda spark, folder: impute_median(_customers_with_gaps(spark, folder), "c_nationkey"),
        """
        WITH gaps AS (
            SELECT c_custkey, CAST(nullif(c_nationkey, 0) AS DOUBLE) AS v FROM customer
        )
        SELECT c_custkey,
               coalesce(v, (SELECT quantile_cont(v, 0.5) FROM gaps)) AS c_nationkey,
               CASE WHEN v IS NULL THEN 1 ELSE 0 END AS c_nationkey_missing
        FROM gaps
        """,
    ),
    "clip_quantiles": Plan(
        lambda spark, folder: clip_quantiles(
            read_table(spark, folder, "lineitem").select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
            ),
            "l_extendedprice",
            0.01,
            0.99,
        ),
        """
        WITH cut AS (
            SELECT quantile_cont(l_extendedprice, 0.01) AS lo,
                   quantile_cont(l_extendedprice, 0.99) AS hi
            FROM lineitem
        )
        SELECT l_orderkey, l_linenumber, l_partkey,
               least(greatest(l_extendedprice, lo), hi) AS l_extendedprice
        FROM lineitem CROSS JOIN cut
        """,
    ),
    "group_rare": Plan(
        lambda spark, folder: group_rare(
            read_table(spark, folder, "documents").select("doc_id", "source"), "source", 50
        ),
        """
        SELECT doc_id,
               CASE WHEN count(*) OVER (PARTITION BY source) < 50
                    THEN 'OTHER' ELSE source END AS source
        FROM documents
        """,
    ),
}
