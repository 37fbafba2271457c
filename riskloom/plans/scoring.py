"""Measuring scores. The score is the length of a document: a made-up one, to be measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import auc, calibration, gain_table, ks, threshold_table
from riskloom.plans.plan import Plan, labelled_documents, rounded

_CUTS = [100, 1000, 5000]


def _with_probability(spark, folder):
    rows = labelled_documents(spark, folder)
    return rows.withColumn("p", F.col("n_chars") / (F.col("n_chars") + 1000.0))


_SCORED = "labels JOIN documents USING (doc_id)"

PLANS = {
    "auc": Plan(
        lambda spark, folder: auc(labelled_documents(spark, folder), "quality", "n_chars"),
        f"""
        WITH r AS (
            SELECT quality, rank() OVER (ORDER BY n_chars)
                       + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS place
            FROM {_SCORED}
        ), s AS (
            SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
                   sum(place) FILTER (quality = 1) AS ranks
            FROM r
        )
        SELECT n_pos, n_neg,
               (ranks - n_pos * (n_pos + 1) / 2) / nullif(n_pos * n_neg, 0) AS auc
        FROM s
        """,
    ),
    "ks": Plan(
        lambda spark, folder: ks(labelled_documents(spark, folder), "quality", "n_chars"),
        f"""
        WITH c AS (
            SELECT n_chars, count(*) FILTER (quality = 1) AS pos,
                   count(*) FILTER (quality = 0) AS neg
            FROM {_SCORED} GROUP BY n_chars
        ), w AS (
            SELECT sum(pos) OVER (ORDER BY n_chars) / sum(pos) OVER () AS reached_pos,
                   sum(neg) OVER (ORDER BY n_chars) / sum(neg) OVER () AS reached_neg
            FROM c
        )
        SELECT max(abs(reached_pos - reached_neg)) AS ks FROM w
        """,
    ),
    "gain_table": Plan(
        lambda spark, folder: gain_table(
            labelled_documents(spark, folder), "quality", "n_chars", "doc_id"
        ),
        f"""
        WITH b AS (
            SELECT quality, CAST(ntile(10) OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS bin
            FROM {_SCORED}
        ), g AS (
            SELECT bin, count(*) AS n, count(*) FILTER (quality = 1) AS n_pos FROM b GROUP BY bin
        )
        SELECT bin, n, n_pos,
               sum(n_pos) OVER (ORDER BY bin) / sum(n_pos) OVER () AS cumulative_share
        FROM g
        """,
    ),
    "threshold_table": Plan(
        lambda spark, folder: threshold_table(
            labelled_documents(spark, folder), "quality", "n_chars", _CUTS
        ),
        f"""
        SELECT CAST(cut AS DOUBLE) AS cut,
               count(*) FILTER (n_chars >= cut AND quality = 1) AS tp,
               count(*) FILTER (n_chars >= cut AND quality = 0) AS fp,
               count(*) FILTER (n_chars < cut AND quality = 1) AS fn,
               count(*) FILTER (n_chars < cut AND quality = 0) AS tn
        FROM {_SCORED} CROSS JOIN (VALUES {", ".join(f"({c})" for c in _CUTS)}) AS c(cut)
        GROUP BY cut
        """,
    ),
    "calibration": Plan(
        lambda spark, folder: rounded(
            calibration(_with_probability(spark, folder), "quality", "p"), "mean_p", "log_loss"
        ),
        f"""
        WITH s AS (
            SELECT quality, n_chars / (n_chars + CAST(1000 AS DOUBLE)) AS p FROM {_SCORED}
        )
        SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n,
               round(avg(p), 9) AS mean_p, avg(quality) AS mean_y,
               round(avg(-CASE WHEN quality = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS log_loss
        FROM s GROUP BY 1
        """,
    ),
}
