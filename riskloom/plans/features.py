"""Features as of a moment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import (
    category_share,
    cross_feature,
    entity_features,
    group_rank,
    interval_join,
    json_attribute,
    last_event_asof,
    recency_gap,
    trailing_features,
)
from riskloom.plans.plan import Plan
from riskloom.sources import read_stream, read_table
from riskloom.streaming import run_available, trailing_stream


def _orders(spark, folder, *columns):
    return read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", *columns)


def customer_history(spark, folder):
    return entity_features(
        read_table(spark, folder, "customer").select("c_custkey"),
        read_table(spark, folder, "orders"),
        ("c_custkey", "o_custkey"),
        "o_orderdate",
        "2000-01-01",
        "o_totalprice",
        scale=2,
    )


def _gaps(spark, folder):
    orders = _orders(spark, folder, "o_orderdate")
    gaps = recency_gap(orders, "o_custkey", "o_orderdate", "o_orderkey")
    # A null integer reads differently in pandas and DuckDB; a null double does not.
    return gaps.withColumn("gap_days", F.col("gap_days").cast("double"))


def _clicks_in_views(spark, folder):
    """Each click with the view that was the user's latest: valid from its moment to the next view's."""
    events = read_table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "value")
    views = events.filter("event_type = 'view'")
    until = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    valid = views.select(
        "user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("valid_from"),
        until.alias("valid_to"), F.col("value").alias("rate"),
    )
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    met = interval_join(clicks, valid, "ts", "valid_from", "valid_to", ["user_id"], id="event_id")
    # A null integer reads differently in pandas and DuckDB; a null double does not.
    return met.select("event_id", "user_id", F.col("view_id").cast("double").alias("view_id"), "rate")


def _streamed(spark, folder):
    events = read_stream(spark, folder, "events")
    near = run_available(trailing_stream(events, "user_id", "ts", "value", 7, 2, scale=2)).df
    return near.withColumn("as_of", F.col("as_of").cast("string"))


PLANS = {
    "interval_join": Plan(
        _clicks_in_views,
        """
        WITH views AS (
            SELECT user_id, event_id AS view_id, ts AS valid_from, value AS rate,
                   lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
            FROM events WHERE event_type = 'view'
        )
        SELECT c.event_id, c.user_id, CAST(v.view_id AS DOUBLE) AS view_id, v.rate
        FROM events c
        LEFT JOIN views v
          ON v.user_id = c.user_id AND c.ts >= v.valid_from AND (c.ts < v.valid_to OR v.valid_to IS NULL)
        WHERE c.event_type = 'click'
        """,
    ),
    "trailing_stream": Plan(
        _streamed,
        """
        WITH daily AS (
            SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18, 2))) AS total
            FROM events GROUP BY ALL
        ),
        near AS (SELECT user_id, day + CAST(i AS INTEGER) AS as_of, n, total FROM daily, range(1, 8) AS d(i))
        SELECT user_id, CAST(as_of AS VARCHAR) AS as_of, CAST(sum(n) AS BIGINT) AS trailing_count,
               CAST(sum(total) AS DOUBLE) AS trailing_sum
        FROM near
        WHERE as_of <= (SELECT max(day) - 2 FROM daily)
        GROUP BY ALL
        """,
    ),
    "entity_features": Plan(
        customer_history,
        """
        SELECT c_custkey,
               count(o_orderkey) AS fact_count,
               coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 0) AS fact_sum,
               CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE)
                   / nullif(count(o_orderkey), 0) AS fact_mean,
               max(o_totalprice) AS fact_max
        FROM customer
        LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < TIMESTAMP '2000-01-01'
        GROUP BY c_custkey
        """,
    ),
    "trailing_features": Plan(
        lambda spark, folder: trailing_features(
            _orders(spark, folder, "o_orderdate", "o_totalprice"),
            "o_custkey",
            "o_orderdate",
            "o_totalprice",
            90,
            scale=2,
        ),
        """
        SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
               count(*) OVER before AS trailing_count,
               coalesce(
                   CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER before AS DOUBLE), 0
               ) AS trailing_sum
        FROM orders
        WINDOW before AS (
            PARTITION BY o_custkey ORDER BY o_orderdate
            RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING
        )
        """,
    ),
    "recency_gap": Plan(
        _gaps,
        """
        SELECT o_orderkey, o_custkey, o_orderdate,
               CAST(date_diff('day', lag(o_orderdate) OVER (
                   PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
               ), o_orderdate) AS DOUBLE) AS gap_days
        FROM orders
        """,
    ),
    "category_share": Plan(
        lambda spark, folder: category_share(
            read_table(spark, folder, "events"), "user_id", "event_type", ["click", "view"]
        ),
        """
        SELECT user_id, count(*) AS n,
               count(*) FILTER (event_type = 'click') / count(*) AS share_click,
               count(*) FILTER (event_type = 'view') / count(*) AS share_view
        FROM events GROUP BY user_id
        """,
    ),
    "last_event_asof": Plan(
        lambda spark, folder: last_event_asof(
            read_table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type"),
            "user_id",
            "ts",
            F.col("event_type") == "click",
            F.col("event_type") == "view",
        ),
        """
        SELECT * FROM (
            SELECT event_id, user_id, ts, event_type,
                   max(CASE WHEN event_type = 'view' THEN ts END) OVER (
                       PARTITION BY user_id ORDER BY ts
                       RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
                   ) AS last_time
            FROM events
        ) WHERE event_type = 'click'
        """,
    ),
    "json_attribute": Plan(
        lambda spark, folder: json_attribute(
            read_table(spark, folder, "events").select("event_id", "props"),
            "props",
            "$.k",
            "bigint",
            "k",
        ),
        """
        SELECT event_id, props, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events
        """,
    ),
    "group_rank": Plan(
        lambda spark, folder: group_rank(
            read_table(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice"),
            "p_brand",
            "p_retailprice",
            scale=2,
        ),
        """
        SELECT p_partkey, p_brand, p_retailprice,
               percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice)
                   AS group_percent_rank,
               p_retailprice / (
                   CAST(sum(CAST(p_retailprice AS DECIMAL(18, 2))) OVER (PARTITION BY p_brand)
                        AS DOUBLE) / count(*) OVER (PARTITION BY p_brand)
               ) AS group_ratio
        FROM part
        """,
    ),
    "cross_feature": Plan(
        lambda spark, folder: cross_feature(
            read_table(spark, folder, "customer"),
            ["c_mktsegment", "c_nationkey"],
            "c_acctbal",
            scale=2,
        ),
        """
        SELECT c_mktsegment, c_nationkey,
               concat_ws('|', c_mktsegment, c_nationkey) AS combination, count(*) AS n,
               CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS mean_value
        FROM customer GROUP BY c_mktsegment, c_nationkey
        """,
    ),
}
