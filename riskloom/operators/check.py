"""Checking tables before anything is built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import mean_of
from riskloom.operators.joining import shuffle_join


def profile_columns(
    df: DataFrame, columns: Sequence[str], scale: int | None = None, as_text: bool = False
) -> DataFrame:
    """One row per column: rows, nulls, distinct values, min, max, mean.

    Columns may have any type that can be ordered. Distinct values, min and max are found in the
    column's own type; min and max are then given as doubles, or as text with ``as_text``, which
    columns other than numbers need. Only numbers have a mean; with ``scale``, values of
    that many decimals are summed exactly for it. One scan for all but the distinct values, for which
    pairs of column and value are shuffled, after tasks have combined theirs.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    other = [c for c, kind in kinds.items() if not isinstance(kind, T.NumericType)]
    if other and not as_text:
        raise TypeError(f"{', '.join(other)}: give as_text=True to profile other than numbers")
    shown = "string" if as_text else "double"
    sums = []
    for i, c in enumerate(columns):
        mean = F.lit(None) if c in other else mean_of(F.col(c), scale)
        sums += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}")]
        sums += [mean.cast("double").alias(f"mean{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(c).alias("column_name"),
            F.col("n").alias("n"),
            (F.col("n") - F.col(f"n{i}")).alias("nulls"),
            F.col(f"low{i}").cast(shown).alias("min_value"),
            F.col(f"high{i}").cast(shown).alias("max_value"),
            F.col(f"mean{i}").alias("mean_value"),
        )
        for i, c in enumerate(columns)
    ]
    distinct = None
    for kind in dict.fromkeys(kinds.values()):
        pairs = [
            F.struct(F.lit(i).alias("place"), F.col(c).alias("value"))
            for i, c in enumerate(columns)
            if kinds[c] == kind
        ]
        seen = df.select(F.inline(F.array(*pairs))).filter("value is not null").distinct()
        counts = seen.groupBy("place").agg(F.count(F.lit(1)).alias("distinct_values"))
        distinct = counts if distinct is None else distinct.unionByName(counts)
    return (
        one.select(F.inline(F.array(*rows)))
        .join(F.broadcast(distinct), "place", "left")
        .select(
            "column_name",
            "n",
            "nulls",
            F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
            "min_value",
            "max_value",
            "mean_value",
        )
    )


def dominant_value(df: DataFrame, column: str) -> DataFrame:
    """The commonest value, its rows and its share of all rows: near 1 means the column is
    all but constant. Of equally common values the largest is named."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max(F.struct("n", "value")).alias("top"), F.sum("n").alias("total"))
    return top.select(
        F.col("top.value").alias("value"),
        F.col("top.n").alias("n"),
        (F.col("top.n") / F.col("total")).alias("share"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def reference_gaps(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` matches; ``on`` maps left to right columns.

    Keys of different types meet in the type both widen to, as in a plain comparison. Only the
    distinct keys of ``right`` travel. A null key has no partner.
    """
    names = [f"_key{i}" for i in range(len(on))]
    own = left.select(*(F.col(a).alias(n) for a, n in zip(on, names)))
    keys = right.select(*(F.col(b).alias(n) for b, n in zip(on.values(), names)))
    wide = {f.name: f.dataType for f in own.union(keys).schema}
    keyed = left.withColumns({n: F.col(a).cast(wide[n]) for a, n in zip(on, names)})
    cast = keys.select(*(F.col(n).cast(wide[n]).alias(n) for n in names)).dropna().distinct()
    return shuffle_join(keyed, cast, names, "left_anti", null_safe=False).select(*left.columns)
