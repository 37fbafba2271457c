"""Order over all rows without gathering them in one task.

``running`` gives every row the total of the rows before it. Rows go to buckets that
are ranges of the order; bucket totals are few, so the offset of each bucket comes from
a window over them, and the rest from a window inside the bucket. The offset enters that
window as one seed row in front of the bucket's own rows, which makes a join unnecessary.

``positions`` numbers rows by a range-partitioned sort instead, for orders over several
columns or over text, which have no bucket edges of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import id_hash, order_key
from riskloom.operators.sketching import approximate_quantiles
from riskloom.settings import buckets, hash_digits
from riskloom.sources.shared import freeze

BUCKET = "_bucket"
_SEED = "_seed"
_KEY = "_order_key"

# Ranks this share of the rows to either side of a wanted one are looked at, and a sketch
# that errs by a third of it.
_MARGIN, _MARGIN_SKETCH = 0.002, 8_000


def bucket_edges(df: DataFrame, column: str) -> list[float]:
    """Rising literal edges that cut the rows of ``df`` into about equal parts."""
    spark = df.sparkSession

    def probs(rows: int) -> list[float]:
        count = buckets(spark, rows)
        return [i / count for i in range(1, count)]

    keys = df.select(order_key(df, column).alias(_KEY))
    found = approximate_quantiles(keys, _KEY, probs, max(200, min(8 * buckets(spark), 65_535)))
    return sorted({e for e in found if math.isfinite(e)}) or [0.0]


def with_value_bucket(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Adds the bucket of ``column``; NaN, which Spark orders last, gets the last one."""
    cut = Bucketizer(
        splits=[-math.inf, *edges, math.inf],
        inputCol=_KEY,
        outputCol=BUCKET,
        handleInvalid="keep",
    )
    placed = cut.transform(df.withColumn(_KEY, order_key(df, column))).drop(_KEY)
    return placed.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def with_hash_bucket(df: DataFrame, id: str) -> DataFrame:
    """Adds ``_hash``, the md5 of the id, and as bucket its first digits, as many as the number
    of rows asks for. Runs a count."""
    digits = hash_digits(df.select(id).count())
    hashed = df.withColumn("_hash", id_hash(F.col(id)))
    return hashed.withColumn(BUCKET, F.substring("_hash", 1, digits))


def running(
    points: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    how: str = "sum",
) -> DataFrame:
    """For each of ``columns`` adds ``<c>_before``, its sum (or max) over the earlier rows
    with the same ``by``, and ``<c>_total``, the same over all of them.

    ``points`` carries a bucket column in line with ``order`` and has one row per
    ``by`` and ``order``. The bucket column is used up.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    totals = points.groupBy(*by, BUCKET).agg(*(fold(c).alias(c) for c in columns))
    group = Window.partitionBy(*by)
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    seeds = totals.select(
        *by,
        BUCKET,
        F.lit(True).alias(_SEED),
        *(fold(c).over(earlier).alias(c) for c in columns),
        *(fold(c).over(group).alias(f"{c}_total") for c in columns),
    )
    rows = points.withColumn(_SEED, F.lit(False)).unionByName(seeds, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*by, BUCKET)
        .orderBy(F.col(_SEED).desc(), *order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before: dict[str, Column] = {}
    for c in columns:
        total = fold(c).over(inside)
        before[f"{c}_before"] = F.coalesce(total, F.lit(0)) if how == "sum" else total
        before[f"{c}_total"] = F.first(f"{c}_total").over(inside)
    return rows.withColumns(before).filter(~F.col(_SEED)).drop(_SEED, BUCKET)


def value_counts_in_order(
    df: DataFrame, value: str, by: Sequence[str], columns: dict[str, Column]
) -> DataFrame:
    """One row per ``by`` and non-null ``value`` with the aggregates ``columns`` and their
    ``_before`` and ``_total`` along rising ``value``. Equal values collapse before they
    are ordered, so a value held by most rows weighs one row."""
    known = df.filter(F.col(value).isNotNull())
    edges = bucket_edges(known, value)
    points = known.groupBy(*by, value).agg(*(c.alias(name) for name, c in columns.items()))
    return running(with_value_bucket(points, value, edges), by, [value], list(columns))


def positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``_position``, the row number 1..n in ``order``.

    The sort is range partitioned and written once; ``monotonically_increasing_id``
    then holds partition and place. Offsets come from one row per sort partition, at
    most ``spark.sql.shuffle.partitions`` of them.
    """
    placed = freeze(df.sort(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn("_position", F.col("_start") + within + 1)
        .drop("_part", "_place", "_start")
    )


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Quantiles of the non-null values, interpolated between neighbours as SQL's
    ``percentile_cont`` does. Runs jobs; returns one number per probability."""
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        return [None] * len(probs)
    places = [p * (n - 1) for p in probs]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    values, shifted = _narrow(values, n, ranks)
    found = _pick(values, list(shifted.values()))
    at = {r: found[s] for r, s in shifted.items()}
    result = []
    for p in places:
        low, high, share = at[math.floor(p)], at[math.ceil(p)], p - math.floor(p)
        result.append(low if share == 0 else low * (1 - share) + high * share)
    return result


def _pick(values: DataFrame, places: Sequence[int]) -> dict[int, float]:
    """The values at these places of the order, for any number of rows."""
    placed = value_counts_in_order(values, "v", [], {"n": F.count(F.lit(1))})
    first, end = F.col("n_before"), F.col("n_before") + F.col("n")
    wanted = F.lit(False)
    for s in places:
        wanted = wanted | ((first <= s) & (F.lit(s) < end))
    rows = placed.filter(wanted).collect()
    return {
        s: row["v"]
        for s in places
        for row in rows
        if row["n_before"] <= s < row["n_before"] + row["n"]
    }


def _narrow(
    values: DataFrame, n: int, ranks: Sequence[int]
) -> tuple[DataFrame, dict[int, int]]:
    """The values near the wanted ranks, and each rank's place among them.

    Intervals around approximate quantiles are counted exactly. Should one of them miss
    its rank, all values are kept.
    """
    near = [(r / n - _MARGIN, r / n + _MARGIN) for r in ranks]
    probs = [q for low, high in near for q in (max(low, 0.0), min(high, 1.0))]
    found = approximate_quantiles(values, "v", probs, _MARGIN_SKETCH)
    intervals: list[list[float]] = []
    if not found:
        return values, {r: r for r in ranks}
    for low, high in sorted(zip(found[::2], found[1::2])):
        if intervals and low <= intervals[-1][1]:
            intervals[-1][1] = max(high, intervals[-1][1])
        else:
            intervals.append([low, high])
    v = F.col("v")
    counts = values.agg(
        *(F.count_if(v < low).alias(f"below{i}") for i, (low, _) in enumerate(intervals)),
        *(F.count_if(v.between(*pair)).alias(f"inside{i}") for i, pair in enumerate(intervals)),
    ).first()
    shifted, kept = {}, 0
    for i in range(len(intervals)):
        below, inside = counts[f"below{i}"], counts[f"inside{i}"]
        shifted |= {r: r - below + kept for r in ranks if below <= r < below + inside}
        kept += inside
    if len(shifted) < len(ranks):
        return values, {r: r for r in ranks}
    inside = F.lit(False)
    for pair in intervals:
        inside = inside | v.between(*pair)
    return values.filter(inside), shifted
