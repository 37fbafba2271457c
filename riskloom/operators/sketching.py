"""Sketches that tell how to cut the work: bucket edges and hot keys.

They only place rows; no result depends on how near they come. Each task keeps one sketch,
sketches merge in groups first, and the groups' sketches last, so no single task receives
one from every task of a large scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GROUPS = 512


def _by_task(df: DataFrame):
    return df.groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("_group"))


def approximate_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float] | Callable[[int], Sequence[float]],
    size: int,
) -> list[float]:
    """Quantiles of a double column from a KLL sketch of parameter ``size``, 8 to 65,535.
    ``probs`` may be a function of the number of values. Empty when there are no values; NaN
    is not counted."""
    sketches = _by_task(df).agg(F.kll_sketch_agg_double(column, size).alias("_sketch"))
    merged = sketches.agg(F.kll_merge_agg_double("_sketch", size).alias("_sketch"))
    row = merged.select("_sketch", F.kll_sketch_get_n_double("_sketch").alias("_n")).first()
    if not row["_n"]:
        return []
    wanted = probs(row["_n"]) if callable(probs) else probs
    ranks = F.array(*(F.lit(float(p)) for p in wanted))
    one = df.sparkSession.createDataFrame([(row["_sketch"],)], "_sketch binary")
    return one.select(F.kll_sketch_get_quantile_double("_sketch", ranks)).first()[0]


def frequent_items(df: DataFrame, column: str, share: float) -> list[int]:
    """Every value of a bigint column that more than ``share`` of the rows have, and others.

    With 8 / share items tracked, counts are off by less than half of ``share``; fewer than
    3 / share values can then seem frequent enough. Those named have half of it at least.
    """
    tracked, named = round(8 / share), round(3 / share)
    sketches = _by_task(df).agg(
        F.call_function("approx_top_k_accumulate", F.col(column), F.lit(tracked)).alias("_sketch"),
        F.count(F.lit(1)).alias("_n"),
    )
    # Combining no sketches at all is an error, so no group is made of no rows.
    merged = sketches.groupBy(F.lit("all")).agg(
        F.call_function("approx_top_k_combine", F.col("_sketch"), F.lit(tracked)).alias("_sketch"),
        F.sum("_n").alias("_n"),
    )
    items = F.call_function("approx_top_k_estimate", F.col("_sketch"), F.lit(named))
    likely = F.filter(items, lambda i: i["count"] >= F.col("_n") * F.lit(share / 2))
    row = merged.select(F.transform(likely, lambda i: i["item"])).first()
    return list(row[0]) if row else []
