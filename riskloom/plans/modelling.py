"""Splitting rows and fitting models."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import (
    downsample,
    fit_predict_gbt,
    fit_predict_logistic,
    hash_split,
    oof_predict,
    part_ranges,
    rank_blend,
    stratified_folds,
    time_split,
)
from riskloom.plans.plan import Plan, labelled_documents
from riskloom.sources import read_table, write_predictions
from riskloom.sources.shared import new_path

_CATS, _NUMS = ["lang", "source"], ["n_chars"]


def _quality(spark, folder):
    return read_table(spark, folder, "labels").select("doc_id", "quality")


def _held_out(fit):
    """Documents of fold 0 scored by a model of the other folds."""

    def run(spark, folder):
        rows = hash_split(labelled_documents(spark, folder), "doc_id", 5)
        scored = fit(
            rows.filter(F.col("fold") != 0), rows.filter(F.col("fold") == 0), _CATS, _NUMS, "quality"
        )
        return scored.select("doc_id", "quality", "p")

    return run


def _out_of_fold(spark, folder):
    rows = hash_split(labelled_documents(spark, folder), "doc_id", 3)
    scored = oof_predict(
        rows,
        "fold",
        range(3),
        lambda train, test: fit_predict_logistic(train, test, _CATS, _NUMS, "quality"),
    )
    return scored.select("doc_id", "quality", "fold", "p")


def _scored_folds(spark, folder):
    """What SQL can say of out-of-fold scores: rows and positives of each fold, and that every
    score is a probability."""
    sound = F.count_if(F.col("p").between(0, 1))
    return (
        _out_of_fold(spark, folder)
        .groupBy("fold")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("quality") == 1).alias("n_pos"),
            sound.alias("n_probabilities"),
        )
    )


def _blended(spark, folder):
    documents = read_table(spark, folder, "documents")
    words = F.size(F.split("text", " ")).cast("bigint")
    scored = documents.select("doc_id", "n_chars", words.alias("n_words"))
    return rank_blend(scored, ["n_chars", "n_words"], [0.6, 0.4], "doc_id")


def _written(spark, folder):
    """Predictions written in both formats and read back."""
    documents = read_table(spark, folder, "documents")
    scored = documents.select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("p"))
    kept = None
    for format in ("csv", "parquet"):
        path = new_path(spark)
        write_predictions(scored, path, "doc_id", "p", format)
        reader = spark.read.schema("doc_id bigint, p double").option("header", True)
        rows = reader.format(format).load(path).withColumn("format", F.lit(format))
        kept = rows if kept is None else kept.unionByName(rows)
    return kept


PLANS = {
    "hash_split": Plan(
        lambda spark, folder: hash_split(
            read_table(spark, folder, "customer").select("c_custkey"), "c_custkey", 5
        ),
        """
        SELECT c_custkey,
               CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS fold
        FROM customer
        """,
    ),
    "stratified_folds": Plan(
        lambda spark, folder: stratified_folds(_quality(spark, folder), "quality", "doc_id", 5),
        """
        SELECT doc_id, quality,
               row_number() OVER (
                   PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
               ) % 5 AS fold
        FROM labels
        """,
    ),
    "time_split": Plan(
        lambda spark, folder: part_ranges(
            time_split(
                read_table(spark, folder, "orders"), "o_orderdate", "1999-01-01", "2000-01-01"
            ),
            "o_orderdate",
        ),
        """
        SELECT CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train'
                    WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'test' END AS part,
               count(*) AS n, min(o_orderdate) AS first_time, max(o_orderdate) AS last_time
        FROM orders GROUP BY 1
        """,
    ),
    "downsample": Plan(
        lambda spark, folder: downsample(_quality(spark, folder), "quality", "doc_id", 2),
        """
        WITH r AS (
            SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS label_n,
                   row_number() OVER (
                       PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id
                   ) AS place
            FROM labels
        ), m AS (SELECT quality, label_n FROM r ORDER BY label_n, quality LIMIT 1)
        SELECT r.doc_id, r.quality FROM r CROSS JOIN m
        WHERE r.quality = m.quality OR r.place <= 2 * m.label_n
        """,
    ),
    "fit_predict_logistic": Plan(_held_out(fit_predict_logistic)),
    "fit_predict_gbt": Plan(_held_out(fit_predict_gbt)),
    "oof_predict": Plan(_out_of_fold),
    "oof_predict_folds": Plan(
        _scored_folds,
        """
        SELECT CAST('0x' || substr(md5(CAST(l.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS fold,
               count(*) AS n, count(*) FILTER (quality = 1) AS n_pos,
               count(*) AS n_probabilities
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1
        """,
    ),
    "rank_blend": Plan(
        _blended,
        """
        WITH s AS (
            SELECT doc_id, n_chars, len(string_split(text, ' ')) AS n_words FROM documents
        )
        SELECT doc_id, n_chars, n_words,
               CAST(0.6 AS DOUBLE) * percent_rank() OVER (ORDER BY n_chars)
                   + CAST(0.4 AS DOUBLE) * percent_rank() OVER (ORDER BY n_words) AS blend
        FROM s
        """,
    ),
    "write_predictions": Plan(
        _written,
        """
        SELECT doc_id, n_chars / (n_chars + CAST(1000 AS DOUBLE)) AS p, format
        FROM documents CROSS JOIN (VALUES ('csv'), ('parquet')) AS f(format)
        """,
    ),
}
