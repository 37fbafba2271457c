"""Filling, clamping and grouping column values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.joining import lookup_join
from riskloom.operators.ordering import exact_quantiles


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Nulls of ``column`` become its median; ``<column>_missing`` is 1 where that happened.
    The column turns double. Runs jobs for the median, then changes rows in place."""
    (median,) = exact_quantiles(df, column, [0.5])
    value = F.col(column).cast("double")
    return df.withColumns(
        {
            column: F.coalesce(value, F.lit(median).cast("double")),
            f"{column}_missing": F.when(value.isNull(), 1).otherwise(0),
        }
    )


def clip_quantiles(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``column`` clamped to its ``low`` and ``high`` quantiles. Nulls stay null."""
    bottom, top = exact_quantiles(df, column, [low, high])
    value = F.col(column).cast("double")
    if bottom is None:
        return df.withColumn(column, value)
    clamped = F.least(F.greatest(value, F.lit(bottom)), F.lit(top))
    return df.withColumn(column, F.when(value.isNotNull(), clamped))


def group_rare(df: DataFrame, column: str, min_n: int, other: str = "OTHER") -> DataFrame:
    """Categories with fewer than ``min_n`` rows become ``other``. Null counts as a category."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    common = counts.filter(F.col("_n") >= min_n)
    joined = lookup_join(df, common, [column])
    return joined.withColumn(
        column, F.when(F.col("_n").isNotNull(), F.col(column)).otherwise(F.lit(other))
    ).drop("_n")
