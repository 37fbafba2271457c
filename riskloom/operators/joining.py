"""Joins with a table that has one row per key, safe when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.sketching import frequent_items
from riskloom.settings import broadcast_bytes, hot_share
from riskloom.sources.shared import freeze_measured


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """``key_hash`` of the keys holding more than ``hot_share`` of the rows.

    A sketch names every such key, and some others; a second pass counts the named ones.
    At most 3 / share numbers reach the driver.
    """
    share = hot_share(df.sparkSession)
    hashed = df.select(key_hash(keys).alias("h"))
    named = frequent_items(hashed, "h", share)
    if not named:
        return []
    # As a table: at a small share they may be too many for an expression.
    names = df.sparkSession.createDataFrame([(named,)], "h array<bigint>")
    names = names.select(F.explode("h").alias("h"), F.lit(True).alias("named"))
    met = hashed.join(F.broadcast(names), "h", "left")
    counts = met.groupBy(F.when(F.col("named"), F.col("h")).alias("h")).count()
    found = {row["h"]: row["count"] for row in counts.collect()}
    total = sum(found.values())
    return sorted(h for h, n in found.items() if h is not None and n > share * total)


def _join(
    df: DataFrame, table: DataFrame, keys: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    renamed = {k: f"_lookup_{k}" for k in keys}
    table = table.withColumnsRenamed(renamed)
    same = F.lit(True)
    for k, r in renamed.items():
        same = same & (df[k].eqNullSafe(table[r]) if null_safe else df[k] == table[r])
    return df.join(table, same, how).drop(*renamed.values())


def shuffle_join(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = True,
) -> DataFrame:
    """Join ``df`` by shuffle to ``table``, which has one row per value of ``keys``.

    Rows of hot keys stay where they are: the few rows of ``table`` for hot keys, at most
    1 / ``hot_share``, are broadcast to them. No task receives a hot key whole.
    """
    hot = hot_keys(df, keys)
    if not hot:
        return _join(df, table, keys, how, null_safe)
    is_hot = key_hash(keys).isin(hot)
    of_hot = F.broadcast(table.filter(is_hot))
    return _join(df.filter(is_hot), of_hot, keys, how, null_safe).unionByName(
        _join(df.filter(~is_hot), table.filter(~is_hot), keys, how, null_safe)
    )


def lookup_join(
    df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join ``df`` to ``lookup``, an aggregate with one row per value of ``keys``, null
    included. The lookup is computed once and written. If it measures small it is broadcast,
    and ``df`` is not shuffled at all; else the two meet in a ``shuffle_join``."""
    frozen = freeze_measured(lookup)
    if frozen.size <= broadcast_bytes(df.sparkSession):
        return _join(df, F.broadcast(frozen.df), keys, how, True)
    return shuffle_join(df, frozen.df, keys, how)
