"""Judging columns before they enter a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import edge_bin
from riskloom.operators.joining import lookup_join
from riskloom.operators.ordering import exact_quantiles
from riskloom.sources.shared import freeze


def correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson's r of each pair of columns, all from one scan."""
    found = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(
        *(
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("r"))
            for i, (a, b) in enumerate(pairs)
        )
    )
    return found.select(F.inline(rows))


def psi(
    df: DataFrame, column: str, is_new: Column, probs: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Population stability index of the new part of the rows against the old part, over
    bins cut at the old part's quantiles. One row: bins in use, rows of both, the index.

    A bin that is empty in one part counts as half a row there; the index is null when a whole
    part is empty. Null values and rows that
    are neither new nor old are left out.
    """
    rows = df.select(F.col(column).alias("v"), is_new.alias("new")).dropna()
    cuts = exact_quantiles(rows.filter(~F.col("new")), "v", probs)
    edges = sorted({c for c in cuts if c is not None})
    bins = rows.groupBy(edge_bin(F.col("v"), edges).alias("bin")).agg(
        F.count_if(~F.col("new")).alias("old_n"), F.count_if(F.col("new")).alias("new_n")
    )
    bins = freeze(bins)
    total = bins.agg(F.sum("old_n").alias("old"), F.sum("new_n").alias("new")).first()

    def share(n: str, of: int | None) -> Column:
        return F.greatest(F.col(n).cast("double"), F.lit(0.5)) / F.lit(of or None).cast("double")

    expected, actual = share("old_n", total["old"]), share("new_n", total["new"])
    return bins.agg(
        F.count(F.lit(1)).alias("bins"),
        F.sum("old_n").alias("old_n"),
        F.sum("new_n").alias("new_n"),
        F.sum((actual - expected) * F.ln(actual / expected)).alias("psi"),
    )


def chi_square(df: DataFrame, column: str, y: str) -> DataFrame:
    """Chi-square statistic of independence of two categories, with its degrees of freedom.

    Cells without rows add their expected count. Their sum is what the cells with rows leave
    of n, so the empty ones are never made.
    """
    pairs = df.select(column, y).dropna()
    cells = freeze(pairs.groupBy(column, y).agg(F.count(F.lit(1)).alias("_o")))
    by_column = cells.groupBy(column).agg(F.sum("_o").alias("_row_n"))
    by_y = cells.groupBy(y).agg(F.sum("_o").alias("_col_n"))
    joined = lookup_join(lookup_join(cells, by_column, [column]), by_y, [y])
    n = cells.agg(F.sum("_o")).first()[0] or 0
    expected = F.col("_row_n") * F.col("_col_n").cast("double") / F.lit(n)
    return joined.agg(
        F.lit(n).cast("bigint").alias("n"),
        (
            F.sum((F.col("_o") - expected) * (F.col("_o") - expected) / expected)
            + (F.lit(n) - F.sum(expected))
        ).alias("chi_square"),
        ((F.count_distinct(column) - 1) * (F.count_distinct(y) - 1)).alias("degrees"),
    )
