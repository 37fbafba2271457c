"""The ways taken for hot keys and large tables give what the ordinary ways give.

The settings make small data take them. A third of the rows share one key.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import (
    clip_quantiles,
    count_encode,
    downsample,
    group_rank,
    group_rare,
    impute_median,
    last_event_asof,
    ordinal_encode,
    quantile_bin,
    recency_gap,
    reference_gaps,
    stratified_folds,
    target_encode_oof,
    trailing_features,
)
from riskloom.operators.joining import hot_keys, key_hash
from riskloom.operators.ordering import exact_quantiles, positions, value_counts_in_order

HOT = "hot"


@pytest.fixture
def strained(setting):
    """Nothing may be broadcast by size, a tenth of the rows is hot, buckets are many."""
    setting("spark.riskloom.broadcastBytes", 0)
    setting("spark.riskloom.hotShare", 0.1)
    setting("spark.riskloom.buckets", 40)
    setting("spark.sql.autoBroadcastJoinThreshold", -1)


@pytest.fixture(scope="module")
def facts(spark):
    """id, entity (a third hot, some null), time (ties), amount (two decimals), kind."""
    draw = random.Random(7)
    start = datetime(2020, 1, 1)
    rows = []
    for i in range(900):
        entity = HOT if i % 3 == 0 else draw.choice(["a", "b", "c", "d", None, *map(str, range(60))])
        time = start + timedelta(hours=draw.randrange(24 * 200))
        if draw.random() < 0.3:
            time = time.replace(hour=0)
        rows.append(
            (i, entity, time, draw.randrange(-500, 100_000) / 100, draw.choice(["view", "click", "buy"]))
        )
    schema = "id bigint, entity string, time timestamp_ntz, amount double, kind string"
    return spark.createDataFrame(rows, schema).repartition(5), rows


def collected(df, *columns):
    return {row["id"]: tuple(row[c] for c in columns) for row in df.collect()}


def test_hot_keys_are_exactly_the_frequent_ones(spark, facts, strained):
    df, _ = facts
    expected = df.filter(F.col("entity") == HOT).select(F.xxhash64("entity")).first()[0]
    assert hot_keys(df, ["entity"]) == [expected]


def test_hot_keys_of_nothing(facts, strained):
    df, _ = facts
    assert hot_keys(df.filter("id < 0"), ["entity"]) == []
    assert hot_keys(df, ["id"]) == []


def test_trailing(facts, strained):
    df, rows = facts
    by_entity = defaultdict(list)
    for i, entity, time, amount, _ in rows:
        by_entity[entity].append((time.date(), amount))
    expected = {}
    for i, entity, time, _, _ in rows:
        near = [
            a
            for day, a in by_entity[entity]
            if timedelta(1) <= time.date() - day <= timedelta(30)
        ]
        expected[i] = (len(near), pytest.approx(sum(near), abs=1e-9))
    for scale in (2, None):
        found = collected(
            trailing_features(df, "entity", "time", "amount", 30, scale),
            "trailing_count",
            "trailing_sum",
        )
        assert found == expected


def test_recency(facts, strained):
    df, rows = facts
    last, expected = {}, {}
    for i, entity, time, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        before = last.get(entity)
        expected[i] = ((time.date() - before).days if before else None,)
        last[entity] = time.date()
    assert collected(recency_gap(df, "entity", "time", "id"), "gap_days") == expected


def test_asof(facts, strained):
    df, rows = facts
    expected = {}
    for i, entity, time, _, kind in rows:
        if kind == "click":
            seen = [t for _, e, t, _, k in rows if e == entity and k == "view" and t <= time]
            expected[i] = (max(seen, default=None),)
    found = last_event_asof(df, "entity", "time", F.col("kind") == "click", F.col("kind") == "view")
    assert collected(found, "last_time") == expected


def test_source_that_is_also_target_sees_itself(facts, strained):
    df, rows = facts
    found = last_event_asof(df, "entity", "time", F.lit(True), F.lit(True))
    assert collected(found, "last_time") == {r[0]: (r[2],) for r in rows}


def test_counts_and_rare(facts, strained):
    df, rows = facts
    n = Counter(r[1] for r in rows)
    assert collected(count_encode(df, "entity"), "entity_count") == {r[0]: (n[r[1]],) for r in rows}
    expected = {r[0]: (r[1] if n[r[1]] >= 12 else "OTHER",) for r in rows}
    assert collected(group_rare(df, "entity", 12), "entity") == expected


def test_ordinal(facts, strained):
    df, rows = facts
    names = sorted({r[1] for r in rows} - {None})
    expected = {r[0]: (names.index(r[1]) + 1 if r[1] is not None else None,) for r in rows}
    assert collected(ordinal_encode(df, "entity"), "entity_code") == expected


def test_gaps(spark, facts, strained):
    df, rows = facts
    right = spark.createDataFrame([(HOT,), (HOT,), ("a",), (None,)], "name string")
    found = {r["id"] for r in reference_gaps(df, right, {"entity": "name"}).collect()}
    assert found == {r[0] for r in rows if r[1] not in (HOT, "a")}


def test_group_rank(facts, strained):
    df, rows = facts
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r[3])
    expected = {}
    for r in rows:
        values = groups[r[1]]
        below = sum(v < r[3] for v in values)
        rank = below / (len(values) - 1) if len(values) > 1 else 0.0
        expected[r[0]] = (pytest.approx(rank), pytest.approx(r[3] / (sum(values) / len(values))))
    found = group_rank(df, "entity", "amount", scale=2)
    assert collected(found, "group_percent_rank", "group_ratio") == expected


def test_target_encoding(facts, strained):
    df, rows = facts
    marked = df.withColumn("y", (F.col("id") % 2).cast("int")).withColumn("fold", F.col("id") % 4)
    expected = {}
    for i, entity, *_ in rows:
        outside = [r for r in rows if r[0] % 4 != i % 4]
        mean = sum(r[0] % 2 for r in outside) / len(outside)
        same = [r[0] % 2 for r in outside if r[1] == entity]
        expected[i] = (pytest.approx((sum(same) + 5 * mean) / (len(same) + 5)),)
    found = target_encode_oof(marked, "entity", "y", "fold", 5)
    assert collected(found, "entity_target") == expected


@pytest.fixture(scope="module")
def lumpy(spark):
    """A third of the values are equal; there are nulls and infinities."""
    draw = random.Random(3)
    values = [5.0 if i % 3 == 0 else draw.randrange(-50, 50) / 4 for i in range(600)]
    values += [math.inf, -math.inf]
    rows = [*enumerate(values), (602, None), (603, None)]
    return spark.createDataFrame(rows, "id bigint, v double").repartition(4), values


def interpolated(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    low, share = math.floor(place), place - math.floor(place)
    if share == 0:
        return values[low]
    return values[low] * (1 - share) + values[low + 1] * share


def test_quantiles(lumpy, strained):
    df, values = lumpy
    probs = [0.01, 0.25, 0.333, 0.5, 0.75, 0.99]
    expected = [pytest.approx(interpolated(values, p)) for p in probs]
    assert exact_quantiles(df, "v", probs) == expected


def test_quantiles_when_the_sketch_misses(lumpy, strained, monkeypatch):
    df, values = lumpy
    from riskloom.operators import ordering

    real = ordering.approximate_quantiles
    monkeypatch.setattr(
        ordering,
        "approximate_quantiles",
        lambda frame, column, probs, size: [100.0] * len(probs)
        if size == ordering._MARGIN_SKETCH
        else real(frame, column, probs, size),
    )
    assert exact_quantiles(df, "v", [0.5]) == [interpolated(values, 0.5)]


def test_quantiles_with_nan_last(spark, strained):
    df = spark.createDataFrame([(float(i),) for i in range(50)] + [(math.nan,)] * 50, "v double")
    median, top = exact_quantiles(df, "v", [0.25, 0.99])
    assert median == 24.75
    assert math.isnan(top)


def test_quantiles_of_nothing(spark, strained):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", [0.5]) == [None]
    assert impute_median(df, "v").collect() == [(None, 1)]
    assert clip_quantiles(df, "v", 0.1, 0.9).collect() == [(None,)]


def test_running_counts(lumpy, strained):
    df, values = lumpy
    found = value_counts_in_order(df, "v", [], {"n": F.count(F.lit(1))}).collect()
    assert sorted((r["v"], r["n"], r["n_before"], r["n_total"]) for r in found) == [
        (v, n, sum(w < v for w in values), len(values)) for v, n in sorted(Counter(values).items())
    ]


def test_positions(lumpy, strained):
    df, _ = lumpy
    found = positions(df, [F.col("v").desc(), F.col("id")]).collect()
    order = sorted(
        found, key=lambda r: (r["v"] is None, -(r["v"] if r["v"] is not None else 0), r["id"])
    )
    assert [r["_position"] for r in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("rising", [True, False])
@pytest.mark.parametrize("k", [1, 7, 100])
def test_quantile_bins(lumpy, strained, k, rising):
    df, values = lumpy
    sign = 1 if rising else -1
    order = sorted(range(len(values)), key=lambda i: (sign * values[i], i))
    size, rest = divmod(len(values), k)
    bins = [b for b in range(1, k + 1) for _ in range(size + (b <= rest))]
    expected = {i: (b,) for i, b in zip(order, bins)} | {602: (None,), 603: (None,)}
    assert collected(quantile_bin(df, "v", k, "id", rising), "v_bin") == expected


def test_more_bins_than_rows(spark, strained):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "id bigint, v double")
    assert collected(quantile_bin(df, "v", 5, "id"), "v_bin") == {2: (1,), 3: (2,), 1: (3,)}


def md5_order(ids):
    import hashlib

    return sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))


def test_folds_and_downsampling(spark, strained):
    ids = {0: range(0, 900), 1: range(900, 950), 2: range(950, 1200), None: range(1200, 1210)}
    rows = [(i, y) for y, group in ids.items() for i in group]
    df = spark.createDataFrame(rows, "id bigint, y int").repartition(4)
    expected = {
        i: (place % 3,) for group in ids.values() for place, i in enumerate(md5_order(group), 1)
    }
    assert collected(stratified_folds(df, "y", "id", 3), "fold") == expected
    kept = {i for y in (0, 1, 2) for i in (ids[1] if y == 1 else md5_order(ids[y])[:150])}
    assert {r["id"] for r in downsample(df, "y", "id", 3).collect()} == kept
    assert downsample(df.filter("y is null"), "y", "id", 3).count() == 0


def test_sketches_over_many_tasks(spark, monkeypatch):
    from riskloom.operators import sketching

    monkeypatch.setattr(sketching, "_GROUPS", 4)
    n = 100_000
    df = spark.range(0, n, 1, 40).select(
        F.col("id").cast("double").alias("x"),
        F.when(F.col("id") % 50 == 0, 7).otherwise(F.xxhash64("id")).alias("h"),
    )
    probs = [i / 20 for i in range(1, 20)]
    found = sketching.approximate_quantiles(df, "x", probs, 400)
    assert found == [pytest.approx(p * n, abs=0.03 * n) for p in probs]
    assert 7 in sketching.frequent_items(df, "h", 0.01)
    assert sketching.approximate_quantiles(df.filter("x < 0"), "x", probs, 400) == []
    assert sketching.frequent_items(df.filter("x < 0"), "h", 0.01) == []


def test_hot_keys_of_very_many_partitions(spark, setting):
    # As at 200,000 shuffle partitions: more items than a sketch may track.
    setting("spark.riskloom.hotShare", 5e-6)
    facts = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    hashed = facts.filter("k = -1").select(key_hash(["k"]).alias("h"))
    assert hot_keys(facts, ["k"]) == [hashed.first()["h"]]
