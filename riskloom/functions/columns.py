"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A sum of units is split at this power of two, so neither part outgrows a bigint.
_SPLIT = 20


def units(value: Column, scale: int | None) -> Column:
    """A double with ``scale`` decimals as a whole number of its last decimal, so that sums
    do not depend on row order; the double itself when ``scale`` is None. Sums of bigints
    cost what sums of doubles do, a sixth of sums of decimals."""
    if scale is None:
        return value.cast("double")
    return F.rint(value * F.lit(float(10**scale))).cast("bigint")


def unit_parts(value: Column, scale: int | None) -> tuple[Column, Column]:
    """High and low part of ``units``; sums of each stay within a bigint for 8e12 rows and
    more. Without ``scale`` the low part is all, and the high one 0."""
    whole = units(value, scale)
    if scale is None:
        return F.lit(0).cast("bigint"), whole
    return F.shiftright(whole, _SPLIT), whole.bitwiseAND(F.lit((1 << _SPLIT) - 1))


def from_parts(high: Column, low: Column, scale: int | None) -> Column:
    """The double that sums of ``unit_parts`` make up."""
    if scale is None:
        return low
    return from_units(high.cast("decimal(38,0)") * F.lit(1 << _SPLIT) + low, scale)


def from_units(total: Column, scale: int | None) -> Column:
    return total.cast("double") / F.lit(float(10 ** (scale or 0)))


def exact_sum(value: Column, scale: int | None) -> Column:
    """Aggregate: the sum as a double, exact up to its final rounding if ``scale`` is given."""
    if scale is None:
        return F.sum(value.cast("double"))
    high, low = unit_parts(value, scale)
    return from_parts(F.sum(high), F.sum(low), scale)


def mean_of(value: Column, scale: int | None) -> Column:
    """Aggregate: mean of the non-null values, null when there are none."""
    return exact_sum(value, scale) / F.nullif(F.count(value), F.lit(0))


def moment(df: DataFrame, column: str, text: str) -> Column:
    """The literal ``text`` in the type of the time column it is compared with."""
    return F.lit(text).cast(df.schema[column].dataType)


def day_number(time: Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp."""
    return F.unix_date(F.to_date(time))


def order_key(df: DataFrame, column: str) -> Column:
    """A double that never decreases as ``column`` grows. It places a row in a bucket
    of a global order; inside a bucket the column itself decides."""
    value, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampType):
        # Not the local time of day: that runs backwards when clocks go back.
        return F.unix_micros(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(value) * 3600 + F.minute(value) * 60 + F.second(value)
        return (day_number(value).cast("bigint") * 86400 + seconds).cast("double")
    raise TypeError(f"{column} has type {kind.simpleString()}: need a number or a time")


def passed(cuts: Sequence[Column]) -> Column:
    """How many of the ``cuts`` hold, where each implies those before it. One flat case
    expression, so any number of cuts compiles."""
    place = F.lit(0)
    for i, cut in reversed(list(enumerate(cuts, 1))):
        place = F.when(cut, i) if i == len(cuts) else place.when(cut, i)
    return place.otherwise(0) if cuts else place


def edge_bin(value: Column, edges: Sequence[float]) -> Column:
    """How many of the rising ``edges`` lie below ``value``: bin 0 is up to and including
    the first edge. Null stays null."""
    return F.when(value.isNotNull(), passed([value > F.lit(e) for e in edges]))


def id_hash(id: Column) -> Column:
    """md5 of the id written as text, in hex. A fixed pseudo-random order of the rows."""
    return F.md5(id.cast("string"))


def hash_number(id: Column) -> Column:
    """The first eight hex digits of ``id_hash`` as a number."""
    return F.conv(F.substring(id_hash(id), 1, 8), 16, 10).cast("bigint")


def positive(y: Column) -> Column:
    return F.count_if(y == 1)


def negative(y: Column) -> Column:
    return F.count_if(y == 0)
