"""Turning categories and numbers into model inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import exact_sum, negative, passed, positive
from riskloom.operators.joining import lookup_join
from riskloom.operators.ordering import positions
from riskloom.sources.shared import freeze


def count_encode(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_count``, the rows of the row's category. Null counts as a category."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(f"{column}_count"))
    return lookup_join(df, counts, [column])


def ordinal_encode(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_code``: categories by name are 1..k. Null has no code."""
    names = df.select(column).dropna().distinct()
    codes = positions(names, [F.col(column)])
    return lookup_join(df, codes.withColumnRenamed("_position", f"{column}_code"), [column])


def equal_width_bin(df: DataFrame, column: str, low: float, width: float) -> DataFrame:
    """Adds ``<column>_bin``, the number of whole ``width`` steps above ``low``."""
    steps = F.floor((F.col(column) - F.lit(low)) / F.lit(width))
    return df.withColumn(f"{column}_bin", steps)


def after_cut(column: str, id: str, value: Column, last_id: object, rising: bool = True) -> Column:
    """Whether a row comes after the row ``(value, last_id)`` by ``column`` and then id."""
    beyond = F.col(column) > value if rising else F.col(column) < value
    return beyond | ((F.col(column) == value) & (F.col(id) > F.lit(last_id)))


def _carried(df: DataFrame, column: str) -> tuple[Column, Callable[[object], Column]]:
    """A value in a form the driver can hold, and back to a literal of the column's type. Python's
    times would take the zone of the driver or of the session on their way."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column), lambda v: F.timestamp_micros(F.lit(v))
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.col(column).cast("string"), lambda v: F.lit(v).cast(kind)
    return F.col(column), F.lit


def quantile_bin(df: DataFrame, column: str, k: int, id: str, rising: bool = True) -> DataFrame:
    """Adds ``<column>_bin`` 1..k: equally many rows each (the first ones take the rest), in
    order of ``column`` and, among equals, of the unique ``id``. Null values get no bin.

    Only ``column`` and ``id`` are sorted. The k - 1 rows that end a bin come back to the
    driver, and comparing with them bins ``df`` where it lies.
    """
    narrow = df.select(column, id).filter(F.col(column).isNotNull())
    order = [F.col(column) if rising else F.col(column).desc(), F.col(id)]
    placed = positions(narrow, order)
    n = placed.count()
    size, rest = divmod(n, k)
    ends = {i * size + min(i, rest) for i in range(1, k)} - {0, n}
    held, literal = _carried(df, column)
    last = placed.filter(F.col("_position").isin(sorted(ends)))
    cuts = last.select("_position", id, held.alias("_value")).collect() if ends else []
    cuts.sort(key=lambda row: row["_position"])
    after = [after_cut(column, id, literal(row["_value"]), row[id], rising) for row in cuts]
    bin = 1 + passed(after)
    return df.withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), bin))


def target_encode_oof(
    df: DataFrame, column: str, y: str, fold: str, weight: float, scale: int | None = None
) -> DataFrame:
    """Adds ``<column>_target``: the mean of ``y`` over the category's rows outside the row's
    own fold, drawn towards the mean of all rows outside it as by ``weight`` further rows.

    Nothing of a fold's labels enters its own encoding. All sums come from one table of
    (category, fold) cells, and the rows are joined to it once. ``y`` may be any number; whole
    numbers are summed exactly, and others are where ``scale`` names their decimals.
    """
    whole = isinstance(df.schema[y].dataType, (T.IntegralType, T.BooleanType))
    total_y = F.sum(F.col(y).cast("bigint")) if whole else exact_sum(F.col(y), scale)
    cells = freeze(
        df.groupBy(column, fold).agg(F.count(y).alias("_n"), total_y.alias("_s"))
    ).fillna(0, ["_s"])
    total = cells.agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")).first()
    # A category has a cell per fold: few enough for a window.
    category = Window.partitionBy(column)
    by_category = cells.select(
        "*",
        F.sum("_n").over(category).alias("_category_n"),
        F.sum("_s").over(category).alias("_category_s"),
    )
    by_fold = cells.groupBy(fold).agg(F.sum("_n").alias("_fold_n"), F.sum("_s").alias("_fold_s"))
    joined = lookup_join(by_category, by_fold, [fold])
    outside_mean = (F.lit(total["_s"] or 0) - F.col("_fold_s")) / F.nullif(
        F.lit(total["_n"] or 0) - F.col("_fold_n"), F.lit(0)
    )
    outside_n = F.col("_category_n") - F.col("_n")
    outside_s = F.col("_category_s") - F.col("_s")
    encoded = (outside_s + F.lit(float(weight)) * outside_mean) / F.nullif(
        outside_n + F.lit(float(weight)), F.lit(0.0)
    )
    lookup = joined.select(column, fold, encoded.alias(f"{column}_target"))
    return lookup_join(df, lookup, [column, fold])


def woe_iv(df: DataFrame, column: str, y: str) -> DataFrame:
    """Per category: positives, negatives, weight of evidence and its part of the information
    value. Half a row is added to every count and total, so no category is infinite."""
    counts = freeze(
        df.groupBy(column).agg(positive(F.col(y)).alias("n_pos"), negative(F.col(y)).alias("n_neg"))
    )
    total = counts.agg(F.sum("n_pos").alias("pos"), F.sum("n_neg").alias("neg")).first()
    if total["pos"] is None:
        total = {"pos": 0, "neg": 0}
    p = (F.col("n_pos") + 0.5) / F.lit(total["pos"] + 0.5)
    n = (F.col("n_neg") + 0.5) / F.lit(total["neg"] + 0.5)
    woe = F.ln(p / n)
    return counts.select(
        column, "n_pos", "n_neg", woe.alias("woe"), ((p - n) * woe).alias("iv_part")
    )


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Adds ``<column>_<value>``, 1 where the row has that value and else 0."""
    flags = {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values}
    return df.withColumns(flags)
