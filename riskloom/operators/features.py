"""Point-in-time features: a row only ever sees what came before it.

Windows per entity shuffle once on the entity. Entities hot enough to overload a task
(``joining.hot_keys``) take a second way that first reduces them to one row per day or
per moment; both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import (
    day_number,
    exact_sum,
    from_parts,
    mean_of,
    moment,
    unit_parts,
)
from riskloom.operators.joining import hot_keys, key_hash, lookup_join
from riskloom.operators.ordering import (
    bucket_edges,
    running,
    value_counts_in_order,
    with_value_bucket,
)

_DAY = "_day"


def entity_features(
    entities: DataFrame,
    facts: DataFrame,
    on: tuple[str, str],
    time: str,
    cutoff: str,
    value: str,
    scale: int | None = None,
) -> DataFrame:
    """Count, sum, mean and max of ``value`` per entity over facts strictly before
    ``cutoff``. Entities without facts stay, with count and sum 0 and no mean or max.
    ``on`` is the key in ``entities`` and in ``facts``."""
    key, fact_key = on
    known = facts.filter(F.col(time) < moment(facts, time, cutoff))
    per_key = known.groupBy(F.col(fact_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        exact_sum(F.col(value), scale).alias("_sum"),
        mean_of(F.col(value), scale).alias("fact_mean"),
        F.max(value).alias("fact_max"),
    )
    joined = entities.join(per_key, F.col(key) == F.col("_key"), "left")
    return joined.select(
        *entities.columns,
        F.coalesce("_n", F.lit(0)).alias("fact_count"),
        F.coalesce("_sum", F.lit(0.0)).alias("fact_sum"),
        "fact_mean",
        "fact_max",
    )


def _split_hot(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame | None]:
    hot = hot_keys(df, [entity])
    if not hot:
        return df, None
    is_hot = key_hash([entity]).isin(hot)
    return df.filter(~is_hot), df.filter(is_hot)


def trailing_features(
    facts: DataFrame, entity: str, time: str, value: str, days: int, scale: int | None = None
) -> DataFrame:
    """``trailing_count`` and ``trailing_sum`` of the entity's facts on the ``days`` calendar
    days before the row's own, which is left out. Null for a row without a time."""

    def add(rows: DataFrame, n: Column, high: Column, low: Column) -> DataFrame:
        order = Window.partitionBy(entity).orderBy(_DAY)

        def near(part: Column) -> Column:
            if scale is None:
                return F.coalesce(F.sum(part).over(order.rangeBetween(-days, -1)), F.lit(0))
            # Difference of two growing frames: each row is added once, where a sliding
            # frame is summed anew for every row. Exact, as these are whole numbers.
            before = F.sum(part).over(order.rangeBetween(Window.unboundedPreceding, -1))
            past = F.sum(part).over(order.rangeBetween(Window.unboundedPreceding, -days - 1))
            return F.coalesce(before, F.lit(0)) - F.coalesce(past, F.lit(0))

        dated = F.col(_DAY).isNotNull()
        total = from_parts(near(high), near(low), scale).cast("double")
        return rows.withColumns(
            {
                "trailing_count": F.when(dated, near(n)),
                "trailing_sum": F.when(dated, total),
            }
        )

    dated = facts.withColumn(_DAY, day_number(F.col(time)))
    ordinary, hot = _split_hot(dated, entity)
    high, low = unit_parts(F.col(value), scale)
    result = add(ordinary, F.lit(1).cast("bigint"), high, low)
    if hot is not None:
        daily = hot.groupBy(entity, _DAY).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(high).alias("_high"), F.sum(low).alias("_low")
        )
        daily = add(daily, F.col("_n"), F.col("_high"), F.col("_low")).drop("_n", "_high", "_low")
        result = result.unionByName(lookup_join(hot, daily, [entity, _DAY]))
    return result.drop(_DAY)


def recency_gap(facts: DataFrame, entity: str, time: str, id: str) -> DataFrame:
    """``gap_days`` since the entity's previous row by time and then id; null on its first."""
    ordinary, hot = _split_hot(facts, entity)
    order = Window.partitionBy(entity).orderBy(time, id)
    result = ordinary.withColumn("gap_days", F.datediff(F.col(time), F.lag(time).over(order)))
    if hot is not None:
        # Only the first row of an entity's day looks back to another day.
        hot = hot.withColumn(_DAY, day_number(F.col(time)))
        daily = hot.groupBy(entity, _DAY).agg(F.min(F.struct(time, id)).alias("_first"))
        per_entity = Window.partitionBy(entity).orderBy(_DAY)
        daily = daily.select(
            entity,
            _DAY,
            F.col(f"_first.{id}").alias("_first_id"),
            (F.col(_DAY) - F.lag(_DAY).over(per_entity)).alias("_gap"),
        )
        joined = lookup_join(hot, daily, [entity, _DAY])
        gap = F.when(F.col(id) == F.col("_first_id"), F.col("_gap")).otherwise(0)
        gap = F.when(F.col(_DAY).isNotNull(), gap)
        result = result.unionByName(
            joined.withColumn("gap_days", gap).drop("_first_id", "_gap", _DAY)
        )
    return result


def category_share(facts: DataFrame, entity: str, column: str, values: Sequence[str]) -> DataFrame:
    """Per entity, its rows and ``share_<value>``, the share of them with each listed value."""
    rows = F.count(F.lit(1))
    return facts.groupBy(entity).agg(
        rows.alias("n"),
        *((F.count_if(F.col(column) == v) / rows).alias(f"share_{v}") for v in values),
    )


def last_event_asof(
    facts: DataFrame, entity: str, time: str, is_target: Column, is_source: Column
) -> DataFrame:
    """Target rows with ``last_time``, the entity's latest source time up to and including
    their own; null if there is none."""
    marked = facts.withColumns({"_target": is_target, "_source": is_source})
    marked = marked.filter(F.col("_target") | F.col("_source"))
    ordinary, hot = _split_hot(marked, entity)
    source_time = F.when(F.col("_source"), F.col(time))
    so_far = (
        Window.partitionBy(entity)
        .orderBy(time)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    result = ordinary.withColumn("last_time", F.max(source_time).over(so_far)).filter("_target")
    if hot is not None:
        moments = hot.dropna(subset=[time]).groupBy(entity, time).agg(F.max(source_time).alias("_seen"))
        moments = with_value_bucket(moments, time, bucket_edges(hot, time))
        placed = running(moments, [entity], [time], ["_seen"], how="max")
        known = placed.select(
            entity, time, F.greatest("_seen", "_seen_before").alias("last_time")
        )
        result = result.unionByName(lookup_join(hot.filter("_target"), known, [entity, time]))
    return result.drop("_target", "_source")


def json_attribute(df: DataFrame, column: str, path: str, type: str, name: str) -> DataFrame:
    """Adds ``name``, the field at ``path`` of a JSON text cast to ``type``; null where the
    text, the field or the cast fails."""
    return df.withColumn(name, F.get_json_object(column, path).try_cast(type))


def group_rank(df: DataFrame, group: str, column: str, scale: int | None = None) -> DataFrame:
    """``group_percent_rank`` of ``column`` within its group and ``group_ratio`` to the group
    mean. Null values get neither and do not count.

    Ranks are found on distinct (group, value) pairs, so neither a big group nor a common
    value meets in one task.
    """
    high, low = unit_parts(F.col(column), scale)
    sums = {"_n": F.count(F.lit(1)), "_high": F.sum(high), "_low": F.sum(low)}
    ranked = value_counts_in_order(df, column, [group], sums)
    total = from_parts(F.col("_high_total"), F.col("_low_total"), scale)
    mean = total.cast("double") / F.col("_n_total")
    others = F.col("_n_total") - 1
    lookup = ranked.select(
        group,
        column,
        F.when(others > 0, F.col("_n_before") / others).otherwise(F.lit(0.0)).alias(
            "group_percent_rank"
        ),
        (F.col(column).cast("double") / F.nullif(mean, F.lit(0.0))).alias("group_ratio"),
    )
    return lookup_join(df, lookup, [group, column])


def cross_feature(
    df: DataFrame, columns: Sequence[str], value: str, scale: int | None = None
) -> DataFrame:
    """Per combination of ``columns``: these, its name, its rows and the mean of ``value``.

    The name joins the parts by ``|``. A backslash stands before a backslash or ``|`` of a part,
    and a null part is ``\\N``, so different combinations have different names.
    """

    def part(column: str) -> Column:
        text = F.regexp_replace(F.col(column).cast("string"), r"([\\|])", r"\\$1")
        return F.coalesce(text, F.lit(r"\N"))

    grouped = df.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("n"), mean_of(F.col(value), scale).alias("mean_value")
    )
    name = F.concat_ws("|", *(part(c) for c in columns)).alias("combination")
    return grouped.select(*columns, name, "n", "mean_value")
