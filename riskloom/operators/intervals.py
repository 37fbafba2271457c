"""Facts joined to the intervals of time, or of any ordered value, that hold them.

The span of the facts is a line of 2 ** ``_BITS`` steps. An interval lies in the cells of its *level*: cells so wide that it
touches two at most, so no interval, however long, is dealt to more than two. A fact asks once on each level that
intervals use, of which there are at most ``_BITS / _STEP + 1``. Level and cell, with the keys, are an equality join; the
columns themselves then decide, so cells only place rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskloom.functions.columns import order_key
from riskloom.operators.joining import hot_keys, key_hash
from riskloom.settings import broadcast_bytes
from riskloom.sources.shared import freeze, freeze_measured

_BITS, _STEP = 40, 2
#: Parts in which the facts of a hot cell meet copies of its intervals.
_SALT = 32
_PLACE = ["_level", "_cell"]


def _cell(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at, level)


def _dealt(intervals: DataFrame, start: str, end: str, low: float, high: float, steps) -> DataFrame:
    """Intervals with the one or two cells they touch; those that hold no fact are left out."""
    first = F.greatest(F.coalesce(order_key(intervals, start), F.lit(low)), F.lit(low))
    last = F.least(F.coalesce(order_key(intervals, end), F.lit(high)), F.lit(high))
    placed = intervals.withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    placed = placed.withColumns({"_first": steps(F.col("_first")), "_last": steps(F.col("_last"))})
    apart = F.col("_last") - F.col("_first")
    bits = F.when(apart > 0, F.length(F.bin(apart))).otherwise(0)
    placed = placed.withColumn("_level", (F.ceil(bits / _STEP) * _STEP).cast("int"))
    cells = F.sequence(_cell(F.col("_first"), F.col("_level")), _cell(F.col("_last"), F.col("_level")))
    return placed.withColumn("_cell", F.explode(cells)).drop("_first", "_last")


def _meet(facts: DataFrame, dealt: DataFrame, on: list[str], holds: Column) -> DataFrame:
    """Facts meet intervals of equal ``on``. Facts of hot cells are split, and only for those the intervals copied."""
    hot = hot_keys(facts, on)
    if not hot:
        return facts.join(dealt, on).filter(holds)
    is_hot = key_hash(on).isin(hot)
    split = facts.filter(is_hot).withColumn("_salt", (F.monotonically_increasing_id() % _SALT).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1)))
    copied = dealt.filter(is_hot).withColumn("_salt", parts)
    return (
        split.join(copied, [*on, "_salt"]).drop("_salt").filter(holds)
        .unionByName(facts.filter(~is_hot).join(dealt.filter(~is_hot), on).filter(holds))
    )


def interval_join(
    facts: DataFrame,
    intervals: DataFrame,
    time: str,
    start: str,
    end: str,
    keys: Sequence[str] = (),
    id: str | None = None,
) -> DataFrame:
    """Facts with each interval of equal ``keys`` where ``start <= time < end``: a row for every pair, repeated rows included.

    The three columns are of one type, or all numbers. A null start or end is open on that side. A fact without a time, with a
    null key or a number that is not finite, meets nothing; an interval that ends where it starts, or before, holds nothing. With ``id``, unique and not null, facts that meet nothing come once, with null
    columns of intervals; without it they do not come. Besides ``keys`` the two sides share no column names, and
    no name starts with an underscore. Intervals that measure small are broadcast; otherwise both sides are shuffled once.

    ``facts`` is read for its span, for the join, and where there is an ``id`` once more."""
    keys, spark = list(keys), facts.sparkSession
    kinds = [facts.schema[time].dataType, intervals.schema[start].dataType, intervals.schema[end].dataType]
    if any(k != kinds[0] for k in kinds) and not all(isinstance(k, NumericType) for k in kinds):
        raise TypeError(f"{time}, {start} and {end} differ in type: {', '.join(k.simpleString() for k in kinds)}")
    at = order_key(facts, time)
    timed = facts.filter(F.abs(at) < float("inf"))
    span = timed.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    low, high = span["low"] or 0.0, span["high"] or 0.0
    # Growing in the value, so order is kept; equal values stay equal.
    scale = (2.0**_BITS - 1) / (high - low) if high > low else 0.0

    def steps(value: Column) -> Column:
        return F.floor((value - F.lit(low)) * F.lit(scale)).cast("bigint")

    dealt = freeze_measured(_dealt(intervals, start, end, low, high, steps))
    levels = sorted(r["_level"] for r in dealt.df.select("_level").distinct().collect())
    asking = timed.withColumn("_at", steps(at))
    level = F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level")
    asking = asking.select("*", level).withColumn("_cell", _cell(F.col("_at"), F.col("_level"))).drop("_at")
    after = F.col(start).isNull() | (F.col(time) >= F.col(start))
    holds = after & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    if dealt.size <= broadcast_bytes(spark):
        met = asking.join(F.broadcast(dealt.df), [*keys, *_PLACE]).filter(holds)
    else:
        met = _meet(asking, dealt.df, [*keys, *_PLACE], holds)
    met = met.select(*facts.columns, *(c for c in intervals.columns if c not in keys))
    # An interval lies in its cells of one level, and a fact in one cell a level: no pair meets twice.
    if id is None:
        return met
    met = freeze(met)
    alone = facts.join(met.select(id).distinct(), id, "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)
