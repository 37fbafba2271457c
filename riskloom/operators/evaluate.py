"""Measuring scores against 0/1 labels. Rows without a label or a score are left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import negative, passed, positive
from riskloom.operators.encode import quantile_bin
from riskloom.operators.ordering import value_counts_in_order


def _by_score(df: DataFrame, y: str, score: str) -> DataFrame:
    labelled = df.select(y, score).dropna().filter(F.col(y).isin(0, 1))
    counts = {"_pos": positive(F.col(y)), "_neg": negative(F.col(y))}
    return value_counts_in_order(labelled, score, [], counts)


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counting half; null when a class is missing.

    Twice the rank sum is kept in decimals: products of counts outgrow a bigint.
    """
    points = _by_score(df, y, score)
    below = _wide("_pos_before") + _wide("_neg_before")
    rank_twice = 2 * below + _wide("_pos") + _wide("_neg") + 1
    sums = points.agg(
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("n_neg"),
        F.sum((_wide("_pos") * rank_twice).cast("decimal(38,0)")).alias("ranks"),
    )
    won_twice = F.col("ranks") - _wide("n_pos") * (_wide("n_pos") + 1)
    all_twice = 2 * (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return sums.select(
        "n_pos",
        "n_neg",
        (won_twice.cast("double") / F.nullif(all_twice, F.lit(0.0))).alias("auc"),
    )


def ks(df: DataFrame, y: str, score: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of the two classes' scores; null when a class is missing."""

    def reached(label: str) -> Column:
        total = F.nullif(F.col(f"{label}_total"), F.lit(0))
        return (F.col(f"{label}_before") + F.col(label)) / total

    return _by_score(df, y, score).agg(F.max(F.abs(reached("_pos") - reached("_neg"))).alias("ks"))


def gain_table(df: DataFrame, y: str, score: str, id: str, k: int = 10) -> DataFrame:
    """Per bin of rows, highest scores first: rows, positives, and the share of all positives
    found so far. Equal scores are taken in order of the unique id."""
    labelled = df.select(y, score, id).dropna().filter(F.col(y).isin(0, 1))
    binned = quantile_bin(labelled, score, k, id, rising=False)
    bins = binned.groupBy(F.col(f"{score}_bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), positive(F.col(y)).alias("n_pos")
    )
    # At most k rows from here on.
    so_far = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    total = F.nullif(F.sum("n_pos").over(everything), F.lit(0))
    return bins.withColumn("cumulative_share", F.sum("n_pos").over(so_far) / total)


def threshold_table(df: DataFrame, y: str, score: str, cuts: Sequence[float]) -> DataFrame:
    """tp, fp, fn, tn per cut, where ``score >= cut`` predicts 1.

    Rows are counted once by how many cuts they reach; the cuts meet only those counts.
    """
    rising = sorted(set(cuts))
    labelled = df.select(y, score).dropna().filter(F.col(y).isin(0, 1))
    reached = passed([F.col(score) >= F.lit(c) for c in rising])
    counts = labelled.groupBy(reached.alias("_reached")).agg(
        positive(F.col(y)).alias("_pos"), negative(F.col(y)).alias("_neg")
    )
    if not rising:
        raise ValueError("no cuts")
    # Every cut has a row, also where no row of the table reaches or misses it.
    none = df.sparkSession.range(1).select(
        F.lit(0).alias("_reached"), F.lit(0).cast("bigint").alias("_pos"), F.lit(0).cast("bigint").alias("_neg")
    )
    cut = F.posexplode(F.array(*(F.lit(c).cast("double") for c in rising)))
    per_cut = counts.unionByName(none).select("*", cut.alias("_place", "cut"))
    over = F.col("_reached") > F.col("_place")

    def total(n: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(n)).otherwise(0))

    return per_cut.groupBy("cut").agg(
        total("_pos", over).alias("tp"),
        total("_neg", over).alias("fp"),
        total("_pos", ~over).alias("fn"),
        total("_neg", ~over).alias("tn"),
    )


def calibration(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per tenth of the predicted probability: rows, mean prediction, mean label, log loss.
    1.0 belongs to the last tenth; the loss takes p from 1e-15 to 1 - 1e-15. A p outside 0 to 1
    is an error."""
    labelled = df.select(y, p).dropna().filter(F.col(y).isin(0, 1))
    in_range = F.col(p).between(0, 1)
    problem = F.concat(F.lit(f"{p} is no probability: "), F.col(p).cast("string"))
    labelled = labelled.withColumn(p, F.when(in_range, F.col(p)).otherwise(F.raise_error(problem)))
    safe = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    loss = -F.when(F.col(y) == 1, F.ln(safe)).otherwise(F.ln(1 - safe))
    tenth = F.least(F.floor(F.col(p) * 10), F.lit(9).cast("bigint"))
    return labelled.groupBy(tenth.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean_p"),
        F.avg(y).alias("mean_y"),
        F.avg(loss).alias("log_loss"),
    )
