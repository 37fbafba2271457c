"""Splitting rows for training. Every split depends on the row alone or on a fixed hash
order, so a rerun or a different partitioning gives the same parts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import hash_number, moment
from riskloom.operators.joining import lookup_join
from riskloom.operators.ordering import BUCKET, running, with_hash_bucket
from riskloom.sources.shared import freeze


def hash_split(df: DataFrame, id: str, k: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 from the md5 of the id."""
    return df.withColumn("fold", hash_number(F.col(id)) % k)


def stratified_folds(df: DataFrame, y: str, id: str, k: int) -> DataFrame:
    """Adds ``fold`` 0..k-1: within each label the rows, in md5 order of the unique id, are
    dealt out in turn, so folds of a label differ by one row at most."""
    # Only label and id are put in order; the other columns are joined by the id afterwards.
    dealt = with_hash_bucket(df.select(y, id), id).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running(dealt, [y], ["_hash", id], ["_one"])
    folds = numbered.select(y, id, ((F.col("_one_before") + 1) % k).alias("fold"))
    if set(df.columns) == {y, id}:
        return folds.select(*df.columns, "fold")
    return lookup_join(df, folds.drop(y), [id])


def time_split(df: DataFrame, time: str, valid_from: str, test_from: str) -> DataFrame:
    """Adds ``part``: train before ``valid_from``, test from ``test_from`` on, valid between.
    Null without a time."""
    at = F.col(time)
    part = (
        F.when(at.isNull(), F.lit(None).cast("string"))
        .when(at < moment(df, time, valid_from), "train")
        .when(at < moment(df, time, test_from), "valid")
        .otherwise("test")
    )
    return df.withColumn("part", part)


def part_ranges(df: DataFrame, time: str) -> DataFrame:
    """Rows, first and last time of each ``part`` of a ``time_split``."""
    return df.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def downsample(df: DataFrame, y: str, id: str, ratio: float) -> DataFrame:
    """All rows of the rarest label and, of every other label, up to ``ratio`` times as many:
    those first in md5 order of the unique id. Rows without a label are left out.

    Counts per hash bucket tell how far each label may go. Buckets below its last one are
    kept whole by a plain filter; only the last one, a 65,536th of the rows or less, is ordered.
    """
    hashed = with_hash_bucket(df.filter(F.col(y).isNotNull()), id)
    counts = freeze(hashed.groupBy(y, BUCKET).agg(F.count(F.lit(1)).alias("_n")))
    sizes = freeze(counts.groupBy(y).agg(F.sum("_n").alias("_label_n")))
    rarest = sizes.orderBy("_label_n", y).first()
    if rarest is None:
        return df.limit(0)
    # As decimals: 1.15 * 100 is under 115 in doubles.
    quota = int(Decimal(str(ratio)) * rarest["_label_n"])
    so_far = Window.partitionBy(y).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(so_far), F.lit(0))
    last = (
        counts.withColumn("_before", before)
        .filter((F.col("_before") <= quota) & (F.lit(quota) < F.col("_before") + F.col("_n")))
        .filter(F.col(y) != F.lit(rarest[y]))
        .select(y, F.col(BUCKET).alias("_last"), (F.lit(quota) - F.col("_before")).alias("_room"))
    )
    placed = lookup_join(hashed, last, [y])
    whole = placed.filter(F.col("_last").isNull() | (F.col(BUCKET) < F.col("_last")))
    place = F.row_number().over(Window.partitionBy(y).orderBy("_hash", id))
    edge = placed.filter(F.col(BUCKET) == F.col("_last")).withColumn("_place", place)
    edge = edge.filter(F.col("_place") <= F.col("_room"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))
