"""Encoding and judging columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.columns import moment
from riskloom.operators import (
    chi_square,
    correlation,
    count_encode,
    equal_width_bin,
    hash_split,
    one_hot,
    ordinal_encode,
    psi,
    quantile_bin,
    target_encode_oof,
    woe_iv,
)
from riskloom.plans.plan import Plan, labelled_documents, rounded
from riskloom.sources import read_table

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]


def _customer(spark, folder, *columns):
    return read_table(spark, folder, "customer").select("c_custkey", *columns)


def _price_shift(spark, folder):
    orders = read_table(spark, folder, "orders")
    is_new = F.col("o_orderdate") >= moment(orders, "o_orderdate", "2000-01-01")
    return rounded(psi(orders, "o_totalprice", is_new), "psi")


PLANS = {
    "count_encode": Plan(
        lambda spark, folder: count_encode(
            _customer(spark, folder, "c_mktsegment"), "c_mktsegment"
        ),
        """
        SELECT c_custkey, c_mktsegment,
               count(*) OVER (PARTITION BY c_mktsegment) AS c_mktsegment_count
        FROM customer
        """,
    ),
    "ordinal_encode": Plan(
        lambda spark, folder: ordinal_encode(
            _customer(spark, folder, "c_mktsegment"), "c_mktsegment"
        ),
        """
        SELECT c_custkey, c_mktsegment,
               dense_rank() OVER (ORDER BY c_mktsegment) AS c_mktsegment_code
        FROM customer
        """,
    ),
    "equal_width_bin": Plan(
        lambda spark, folder: equal_width_bin(
            _customer(spark, folder, "c_acctbal"), "c_acctbal", -1000, 1100
        ),
        """
        SELECT c_custkey, c_acctbal,
               CAST(floor((c_acctbal + 1000) / 1100) AS BIGINT) AS c_acctbal_bin
        FROM customer
        """,
    ),
    "quantile_bin": Plan(
        lambda spark, folder: quantile_bin(
            _customer(spark, folder, "c_acctbal"), "c_acctbal", 10, "c_custkey"
        ),
        """
        SELECT c_custkey, c_acctbal,
               CAST(ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS INTEGER) AS c_acctbal_bin
        FROM customer
        """,
    ),
    "target_encode_oof": Plan(
        lambda spark, folder: target_encode_oof(
            hash_split(labelled_documents(spark, folder), "doc_id", 5).select(
                "doc_id", "source", "quality", "fold"
            ),
            "source",
            "quality",
            "fold",
            10,
        ),
        """
        WITH d AS (
            SELECT doc_id, source, quality,
                   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold
            FROM labels JOIN documents USING (doc_id)
        ), t AS (
            SELECT *,
                   sum(quality) OVER () - sum(quality) OVER (PARTITION BY fold) AS s,
                   count(*) OVER () - count(*) OVER (PARTITION BY fold) AS n,
                   sum(quality) OVER (PARTITION BY source)
                       - sum(quality) OVER (PARTITION BY source, fold) AS cs,
                   count(*) OVER (PARTITION BY source)
                       - count(*) OVER (PARTITION BY source, fold) AS cn
            FROM d
        )
        SELECT doc_id, source, quality, fold,
               (cs + CAST(10 AS DOUBLE) * (s / n)) / (cn + CAST(10 AS DOUBLE)) AS source_target
        FROM t
        """,
    ),
    "woe_iv": Plan(
        lambda spark, folder: rounded(
            woe_iv(labelled_documents(spark, folder), "lang", "quality"), "woe", "iv_part"
        ),
        """
        WITH c AS (
            SELECT lang, count(*) FILTER (quality = 1) AS n_pos,
                   count(*) FILTER (quality = 0) AS n_neg
            FROM labels JOIN documents USING (doc_id) GROUP BY lang
        ), s AS (
            SELECT *, (n_pos + 0.5::DOUBLE) / (sum(n_pos) OVER () + 0.5::DOUBLE) AS p,
                   (n_neg + 0.5::DOUBLE) / (sum(n_neg) OVER () + 0.5::DOUBLE) AS q
            FROM c
        )
        SELECT lang, n_pos, n_neg, round(ln(p / q), 9) AS woe,
               round((p - q) * ln(p / q), 9) AS iv_part
        FROM s
        """,
    ),
    "one_hot": Plan(
        lambda spark, folder: one_hot(
            _customer(spark, folder, "c_mktsegment"), "c_mktsegment", _SEGMENTS
        ),
        "SELECT c_custkey, c_mktsegment, "
        + ", ".join(
            f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS \"c_mktsegment_{s}\""
            for s in _SEGMENTS
        )
        + " FROM customer",
    ),
    "correlation": Plan(
        lambda spark, folder: rounded(
            correlation(read_table(spark, folder, "lineitem"), _PAIRS), "r"
        ),
        " UNION ALL ".join(
            f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 9) AS r FROM lineitem"
            for a, b in _PAIRS
        ),
    ),
    "psi": Plan(
        _price_shift,
        """
        WITH o AS (
            SELECT o_totalprice AS v, o_orderdate >= TIMESTAMP '2000-01-01' AS new FROM orders
        ), e AS (
            SELECT quantile_cont(v, 0.25) AS e1, quantile_cont(v, 0.5) AS e2,
                   quantile_cont(v, 0.75) AS e3
            FROM o WHERE NOT new
        ), b AS (
            SELECT CASE WHEN v <= e1 THEN 0 WHEN v <= e2 THEN 1 WHEN v <= e3 THEN 2 ELSE 3 END
                       AS bin,
                   count(*) FILTER (NOT new) AS old_n, count(*) FILTER (new) AS new_n
            FROM o CROSS JOIN e GROUP BY 1
        ), s AS (
            SELECT *, greatest(old_n::DOUBLE, 0.5) / sum(old_n) OVER () AS expected,
                   greatest(new_n::DOUBLE, 0.5) / sum(new_n) OVER () AS actual
            FROM b
        )
        SELECT count(*) AS bins, CAST(sum(old_n) AS BIGINT) AS old_n,
               CAST(sum(new_n) AS BIGINT) AS new_n,
               round(sum((actual - expected) * ln(actual / expected)), 9) AS psi
        FROM s
        """,
    ),
    "chi_square": Plan(
        lambda spark, folder: rounded(
            chi_square(labelled_documents(spark, folder), "lang", "quality"), "chi_square"
        ),
        """
        WITH d AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)),
        r AS (SELECT lang, count(*) AS rn FROM d GROUP BY lang),
        c AS (SELECT quality, count(*) AS cn FROM d GROUP BY quality),
        o AS (SELECT lang, quality, count(*) AS o FROM d GROUP BY lang, quality),
        x AS (
            SELECT coalesce(o.o, 0) AS o, rn * cn / (SELECT count(*) FROM d) AS e
            FROM r CROSS JOIN c LEFT JOIN o ON o.lang = r.lang AND o.quality = c.quality
        )
        SELECT (SELECT count(*) FROM d) AS n, round(sum((o - e) * (o - e) / e), 9) AS chi_square,
               ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS degrees
        FROM x
        """,
    ),
}
