"""Hand-made rows for what the given tables lack: nulls, ties, NaN, single classes, empty
parts, unseen categories; and leakage."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from riskloom import operators as ops
from riskloom.sources import read_table, write_predictions
from riskloom.sources.shared import new_path, shared_dir


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def test_profile_counts_nulls(spark):
    df = spark.createDataFrame([(1, 0.1), (1, None), (3, 0.2)], "a int, b double")
    assert rows(ops.profile_columns(df, ["a", "b"], scale=2)) == [
        ("a", 3, 0, 2, 1.0, 3.0, 5 / 3),
        ("b", 3, 1, 2, 0.1, 0.2, 0.15),
    ]
    empty = df.filter("b is null")
    assert rows(ops.profile_columns(empty, ["b"])) == [("b", 1, 1, 0, None, None, None)]


def test_exact_mean_outlives_bigint(spark):
    df = spark.range(40).select(F.lit(9e16).alias("a"), (F.lit(-0.5) * F.col("id")).alias("b"))
    found = {r["column_name"]: r["mean_value"] for r in ops.profile_columns(df, ["a", "b"], 2).collect()}
    assert found == {"a": 9e16, "b": -9.75}


def test_dominant_value_breaks_ties_upwards(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("x",), (None,)], "c string")
    assert rows(ops.dominant_value(df, "c")) == [("y", 2, 0.4)]


def test_duplicates_count_null_keys_together(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, l string")
    assert rows(ops.duplicate_keys(df, ["k", "l"])) == [(1, None, 2)]


def test_gaps_across_types(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (2**40,), (None,)], "r bigint")
    assert rows(ops.reference_gaps(left, right, {"k": "r"})) == [(1,), (None,)]


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "v double")
    clipped = ops.clip_quantiles(df, "v", 0.1, 0.9)
    found = clipped.agg(F.min("v"), F.max("v"), F.count_if(F.col("v").isNull())).first()
    assert tuple(found) == (10.0, 90.0, 1)


def test_history_is_strictly_before_the_cutoff(spark):
    people = spark.createDataFrame([("a",), ("b",), ("c",)], "who string")
    facts = spark.createDataFrame(
        [("a", "2020-01-01", 1.0), ("a", "2020-01-02", 5.0), ("b", "2020-01-03", 7.0), ("b", "2020-01-02", None)],
        "by string, day string, v double",
    ).withColumn("day", F.to_date("day"))

    def history(frame):
        return rows(ops.entity_features(people, frame, ("who", "by"), "day", "2020-01-03", "v", 2))

    expected = [("a", 2, 6.0, 3.0, 5.0), ("b", 1, 0.0, None, None), ("c", 0, 0.0, None, None)]
    assert history(facts) == expected
    late = spark.createDataFrame([("a", 9.0), ("c", 9.0)], "by string, v double").select(
        "by", F.to_date(F.lit("2020-01-03")).alias("day"), "v"
    )
    assert history(facts.unionByName(late)) == expected


@pytest.fixture
def visits(spark):
    data = [(1, "a", "01", 1.0), (2, "a", "01", 2.0), (3, "a", "03", 4.0), (4, "b", "02", 8.0)]
    df = spark.createDataFrame(data, "id bigint, who string, day string, v double")
    return df.withColumn("day", F.to_date(F.concat(F.lit("2020-01-"), "day")))


def test_trailing_leaves_the_own_day_out(visits):
    found = ops.trailing_features(visits, "who", "day", "v", 2, scale=2)
    assert rows(found.select("id", "trailing_count", "trailing_sum")) == [
        (1, 0, 0.0),
        (2, 0, 0.0),
        (3, 2, 3.0),
        (4, 0, 0.0),
    ]


def test_later_facts_change_no_earlier_feature(visits):
    later = visits.withColumn("day", F.date_add("day", 10)).withColumn("id", F.col("id") + 10)
    both = visits.unionByName(later)
    makers = [
        lambda df: ops.trailing_features(df, "who", "day", "v", 5, scale=2),
        lambda df: ops.recency_gap(df, "who", "day", "id"),
        lambda df: ops.last_event_asof(df, "who", "day", F.col("v") > 1, F.col("v") < 3),
    ]
    for make in makers:
        assert rows(make(both).filter("id < 10")) == rows(make(visits))


def test_share_of_null_and_other_values(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", None)], "who string, c string")
    assert rows(ops.category_share(df, "who", "c", ["x", "z"])) == [
        ("a", 3, 1 / 3, 0.0),
        ("b", 1, 0.0, 0.0),
    ]


def test_json_that_does_not_parse_is_null(spark):
    texts = ['{"k": 3}', '{"k": "x"}', "{", None, '{"j": 1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = ops.json_attribute(df, "t", "$.k", "bigint", "k")
    assert [r["k"] for r in found.collect()] == [3, None, None, None, None]


def test_group_rank_of_one_row_and_of_null(spark):
    df = spark.createDataFrame(
        [(1, "a", 2.0), (2, "a", 4.0), (3, "a", None), (4, "b", 5.0), (5, None, 0.0)],
        "id int, g string, v double",
    )
    found = ops.group_rank(df, "g", "v", scale=2).select("id", "group_percent_rank", "group_ratio")
    assert rows(found) == [
        (1, 0.0, 2 / 3),
        (2, 1.0, 4 / 3),
        (3, None, None),
        (4, 0.0, 1.0),
        (5, 0.0, None),
    ]


def test_columns_named_like_internals(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0)], "id int, n string, amount double")
    assert ops.group_rank(df, "n", "amount").count() == 2
    marked = df.withColumnsRenamed({"n": "s", "id": "fold_n"}).withColumn("y", F.lit(1))
    assert ops.target_encode_oof(marked, "s", "y", "fold_n", 1).count() == 2
    assert ops.auc(marked.withColumnRenamed("amount", "pos"), "y", "pos").first()["auc"] is None


def test_cross_feature_keeps_combinations_apart(spark):
    df = spark.createDataFrame([("a", None, 1.0), (None, "a", 3.0)], "c string, d string, v double")
    found = ops.cross_feature(df, ["c", "d"], "v").select("combination", "n", "mean_value")
    assert rows(found) == [(r"\N|a", 1, 3.0), (r"a|\N", 1, 1.0)]


def test_equal_width_bins(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (9.9,), (10.0,), (None,)], "v double")
    assert [r["v_bin"] for r in ops.equal_width_bin(df, "v", 0, 10).collect()] == [-1, 0, 0, 1, None]


def test_own_label_stays_out_of_target_encoding(spark):
    data = [(i, "ab"[i % 2], i % 3 % 2, i % 4) for i in range(24)]
    schema = "id int, c string, y int, fold int"
    before = ops.target_encode_oof(spark.createDataFrame(data, schema), "c", "y", "fold", 3)
    data[5] = (5, "b", 1 - data[5][2], data[5][3])
    after = ops.target_encode_oof(spark.createDataFrame(data, schema), "c", "y", "fold", 3)
    before, after = ({r["id"]: r["c_target"] for r in df.collect()} for df in (before, after))
    assert before[5] == after[5]
    assert before[4] != after[4]


def test_unseen_category_gets_the_outside_mean(spark):
    data = [(1, "new", 1, 0), (2, "a", 1, 1), (3, "a", 0, 1), (4, "a", None, 0)]
    df = spark.createDataFrame(data, "id int, c string, y int, fold int")
    found = {r["id"]: r["c_target"] for r in ops.target_encode_oof(df, "c", "y", "fold", 10).collect()}
    assert found[1] == 0.5
    assert found[2] == pytest.approx((0 + 10 * 1.0) / (0 + 10))


def test_woe_of_one_sided_categories(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0), (None, 1)], "c string, y int")
    found = {r["c"]: r for r in ops.woe_iv(df, "c", "y").collect()}
    p, n = 2.5 / 3.5, 0.5 / 1.5
    assert found["a"]["woe"] == pytest.approx(math.log(p / n))
    assert found["a"]["iv_part"] == pytest.approx((p - n) * math.log(p / n))
    assert found[None]["n_pos"] == 1


def test_psi(spark):
    old = [(float(v), False) for v in range(100)]
    same = spark.createDataFrame(old + [(v, True) for v, _ in old], "v double, new boolean")
    assert ops.psi(same, "v", F.col("new")).first()["psi"] == 0
    shifted = spark.createDataFrame(old + [(500.0, True)] * 10, "v double, new boolean")
    parts = [(0.25, 0.05)] * 3 + [(0.25, 1.0)]
    expected = sum((a - e) * math.log(a / e) for e, a in parts)
    found = ops.psi(shifted, "v", F.col("new")).first()
    assert (found["bins"], found["old_n"], found["new_n"]) == (4, 100, 10)
    assert found["psi"] == pytest.approx(expected)
    nothing_new = spark.createDataFrame(old, "v double, new boolean")
    assert ops.psi(nothing_new, "v", F.col("new")).first()["psi"] is None


def test_chi_square_counts_empty_cells(spark):
    cells = [("a", 0, 10), ("a", 1, 5), ("b", 1, 15), ("c", 0, 2)]
    df = spark.createDataFrame([(c, y) for c, y, n in cells for _ in range(n)], "c string, y int")
    expected = 0.0
    for c, row_n in (("a", 15), ("b", 15), ("c", 2)):
        for y, col_n in ((0, 12), (1, 20)):
            o, e = sum(n for d, z, n in cells if (d, z) == (c, y)), row_n * col_n / 32
            expected += (o - e) ** 2 / e
    found = ops.chi_square(df, "c", "y").first()
    assert (found["n"], found["degrees"]) == (32, 2)
    assert found["chi_square"] == pytest.approx(expected)


def test_time_split_edges(spark):
    days = ["2019-12-31", "2020-01-01", "2020-06-01", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("d", F.to_date("d"))
    parts = ops.time_split(df, "d", "2020-01-01", "2020-06-01")
    assert [r["part"] for r in parts.collect()] == ["train", "valid", "test", None]


def scored(spark, pairs):
    data = [(i, y, s) for i, (y, s) in enumerate(pairs)]
    return spark.createDataFrame(data, "id int, y int, s double")


def test_auc_and_ks_with_ties(spark):
    df = scored(spark, [(1, 3.0), (1, 2.0), (0, 2.0), (0, 1.0), (None, 9.0), (1, None)])
    assert ops.auc(df, "y", "s").first()["auc"] == (1 + 1 + 0.5 + 1) / 4
    assert ops.ks(df, "y", "s").first()["ks"] == 0.5


def test_auc_and_ks_of_one_class(spark):
    for y in (0, 1):
        df = scored(spark, [(y, 1.0), (y, 2.0)])
        assert ops.auc(df, "y", "s").first()["auc"] is None
        assert ops.ks(df, "y", "s").first()["ks"] is None
    none = scored(spark, [(None, 1.0)])
    assert tuple(ops.auc(none, "y", "s").first()) == (0, 0, None)
    assert ops.ks(none, "y", "s").first()["ks"] is None


def test_gain_table_takes_high_scores_first(spark):
    df = scored(spark, [(int(i >= 8), float(i)) for i in range(10)])
    found = rows(ops.gain_table(df, "y", "s", "id", 5))
    assert found == [(1, 2, 2, 1.0), *((b, 2, 0, 1.0) for b in range(2, 6))]


def test_thresholds(spark):
    df = scored(spark, [(1, 0.9), (0, 0.5), (1, 0.4), (0, 0.1)])
    assert rows(ops.threshold_table(df, "y", "s", [0.5, 0.0, 2.0])) == [
        (0.0, 2, 2, 0, 0),
        (0.5, 1, 1, 1, 1),
        (2.0, 0, 0, 2, 2),
    ]


def test_calibration_at_the_ends(spark):
    df = scored(spark, [(1, 1.0), (0, 1.0), (0, 0.0), (1, 0.95)])
    found = {r["bin"]: r for r in ops.calibration(df, "y", "s").collect()}
    assert found[0]["log_loss"] == pytest.approx(0, abs=1e-12)
    assert found[9]["n"] == 3
    assert math.isfinite(found[9]["log_loss"])


def test_rank_blend_with_nulls(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 30.0), (2, 2.0, 20.0), (3, 2.0, 10.0), (4, None, 5.0)], "id int, a double, b double"
    )
    found = ops.rank_blend(df, ["a", "b"], [0.5, 2.0], "id")
    expected = [(1, 0 + 2 * 1.0), (2, 0.5 * 0.5 + 2 * 2 / 3), (3, 0.5 * 0.5 + 2 / 3), (4, None)]
    for (id, blend), want in zip(rows(found.select("id", "blend")), expected):
        assert (id, blend) == (want[0], pytest.approx(want[1]) if want[1] is not None else None)


@pytest.fixture(scope="module")
def separable(spark):
    data = [(i, i % 3, float(i % 100), "xy"[i % 100 > 50], int(i % 100 > 50)) for i in range(600)]
    return spark.createDataFrame(data, "id int, fold int, v double, c string, y int")


@pytest.mark.parametrize("fit", [ops.fit_predict_logistic, ops.fit_predict_gbt])
def test_models_learn_and_repeat(separable, fit):
    train, test = separable.filter("fold > 0"), separable.filter("fold = 0")
    first = fit(train, test, ["c"], ["v"], "y")
    assert ops.auc(first, "y", "p").first()["auc"] > 0.99
    again = fit(train, test, ["c"], ["v"], "y")
    # Tasks end in any order, and sums of doubles with them.
    for (a, p), (b, q) in zip(rows(first.select("id", "p")), rows(again.select("id", "p")), strict=True):
        assert (a, p) == (b, pytest.approx(q, abs=1e-9))


def test_model_scores_unseen_and_null_categories(spark, separable):
    test = spark.createDataFrame([(1, 10.0, "z"), (2, 90.0, None)], "id int, v double, c string")
    found = ops.fit_predict_logistic(separable, test, ["c"], ["v"], "y")
    assert found.filter("p between 0 and 1").count() == 2


def test_out_of_fold_uses_only_other_folds(separable):
    def fit(train, test):
        seen = train.select("fold").distinct().collect()
        return test.withColumn("p", F.lit(sum(r["fold"] for r in seen)))

    found = ops.oof_predict(separable, "fold", range(3), fit).select("fold", "p").distinct()
    assert rows(found) == [(0, 3), (1, 2), (2, 1)]
    with pytest.raises(ValueError):
        ops.oof_predict(separable, "fold", [1], fit)
    with pytest.raises(Exception, match="no listed fold"):
        ops.oof_predict(separable, "fold", [0, 1], fit)


def test_many_categories_for_a_model(spark):
    wide = spark.range(20_000).select(
        F.col("id").cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("y")
    )
    found = ops.fit_predict_logistic(wide, wide.limit(100), ["c"], [], "y", max_iter=5)
    assert ops.auc(found, "y", "p").first()["auc"] == 1.0


@pytest.mark.parametrize("fit", [ops.fit_predict_logistic, ops.fit_predict_gbt])
def test_labels_other_than_0_and_1_are_refused(spark, fit):
    rows = spark.createDataFrame([(float(i), i % 3) for i in range(30)], "v double, y int")
    with pytest.raises(Exception, match="must be 0 or 1"):
        fit(rows, rows, [], ["v"], "y")


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_write_predictions(spark, format):
    df = spark.createDataFrame([(1, 0.1), (2, 0.7)], "id bigint, p double")
    path = new_path(spark)
    write_predictions(df, path, "id", "p", format)
    reader = spark.read.schema(df.schema).option("header", True)
    assert rows(reader.format(format).load(path)) == [(1, 0.1), (2, 0.7)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_predictions(df, path, "id", "p", format)


@pytest.mark.parametrize("bad", [[(1, 0.1), (1, 0.2)], [(1, None)], [(None, 0.5)], [(1, math.nan)]])
def test_bad_predictions_are_not_written(spark, bad):
    path = new_path(spark)
    df = spark.createDataFrame(bad, "id bigint, p double")
    with pytest.raises(ValueError):
        write_predictions(df, path, "id", "p")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_shared_folder_is_the_session_s(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir())
    assert read_table(spark, "/root/testdata/sf0.001/", "region").count() == 5
