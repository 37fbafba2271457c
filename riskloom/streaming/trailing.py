"""Trailing features of entities from a stream of facts.

Two event-time aggregates in one query: totals of each entity and day, then the sliding window of days
over these totals. Only totals are spread over the windows they belong to, never facts, and tasks combine before the
shuffle, so an entity that a third of the facts share weighs one row a task and day. The watermark closes days and
windows; Spark keeps what is open in its state store and takes it up again after a restart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import day_number, from_parts, unit_parts
from riskloom.sources.shared import new_path

_SECONDS = 86400


def _day_start(day):
    return F.timestamp_seconds(day.cast("bigint") * _SECONDS)


def trailing_stream(
    facts: DataFrame,
    entity: str,
    time: str,
    value: str,
    days: int,
    delay_days: int,
    scale: int | None = None,
) -> DataFrame:
    """``entity``, ``as_of``, ``trailing_count`` and ``trailing_sum`` of the facts on the ``days`` calendar
    days before ``as_of``, once for each entity and day with such facts: what ``trailing_features`` gives a
    row of that day.

    A day is given out, once and for all, when facts have come from ``delay_days`` days later. Facts on days that
    were closed before they came are late and left out (``StreamRun.late``). Facts without a time
    are left out; a null entity is one entity; a null value counts as a fact and adds nothing. Days are those of the
    column's own clock or the session's, as in ``trailing_features``. Sums are exact where ``scale`` names the decimals."""
    high, low = unit_parts(F.col(value), scale)
    dated = facts.select(
        F.col(entity).alias("_entity"),
        _day_start(day_number(F.col(time))).alias("_day"),
        high.alias("_high"),
        low.alias("_low"),
    ).filter("_day IS NOT NULL")
    daily = (
        dated.withWatermark("_day", f"{delay_days} days")
        .groupBy("_entity", F.window("_day", "1 day").alias("_of"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_high").alias("_high"), F.sum("_low").alias("_low"))
    )
    near = daily.groupBy(
        "_entity", F.window(F.window_time("_of"), f"{days} days", "1 day").alias("_window")
    ).agg(
        F.sum("_n").alias("trailing_count"), F.sum("_high").alias("_high"), F.sum("_low").alias("_low")
    )
    as_of = F.date_from_unix_date((F.unix_seconds(F.col("_window.end")) / _SECONDS).cast("int"))
    total = F.coalesce(from_parts(F.col("_high"), F.col("_low"), scale).cast("double"), F.lit(0.0))
    return near.select(
        F.col("_entity").alias(entity),
        as_of.alias("as_of"),
        F.col("trailing_count"),
        total.alias("trailing_sum"),
    )


@dataclass(frozen=True)
class StreamRun:
    """What a run over all that was there has given out, and how much came late: as Spark counts it, late
    facts of one entity and day that a task reads together are one."""

    df: DataFrame
    late: int


def run_available(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> StreamRun:
    """Runs ``stream`` over what its source has now and ends. Rows are appended as parquet at ``path``, each
    exactly once; with the same ``path`` and ``checkpoint`` a later run goes on where this one, or its failure, left off.
    By default both are new folders in the shared one."""
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark), checkpoint or new_path(spark)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    late = sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
    return StreamRun(spark.read.schema(stream.schema).parquet(path), late)
