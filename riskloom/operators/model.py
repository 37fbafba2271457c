"""Fitting and blending models with ``pyspark.ml``, which trains on the executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.joining import lookup_join
from riskloom.operators.ordering import value_counts_in_order
from riskloom.sources.shared import freeze

FitPredict = Callable[[DataFrame, DataFrame], DataFrame]


def _features(cats: Sequence[str], nums: Sequence[str]) -> list[Estimator]:
    stages = []
    if cats:
        index, hot = [f"_{c}_index" for c in cats], [f"_{c}_hot" for c in cats]
        stages.append(
            StringIndexer(
                inputCols=list(cats),
                outputCols=index,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
        )
        stages.append(OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"))
    inputs = [f"_{c}_hot" for c in cats] + list(nums)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="error"))
    return stages


def _fit_predict(
    classifier: Estimator,
    train: DataFrame,
    test: DataFrame,
    cats: Sequence[str],
    nums: Sequence[str],
    y: str,
) -> DataFrame:
    label = F.col(y).cast("double")
    fault = F.concat(F.lit(f"{y} must be 0 or 1, not "), label.cast("string"))
    binary = F.when(label.isin(0.0, 1.0), label).otherwise(F.raise_error(fault))
    # Every stage of the fit reads these rows, most of them several times.
    known = freeze(train.filter(label.isNotNull()).select(*cats, *nums, binary.alias(y)))
    model = Pipeline(stages=[*_features(cats, nums), classifier]).fit(known)
    scored = model.transform(test)
    return scored.select(*test.columns, vector_to_array("_probability")[1].alias("p"))


def fit_predict_logistic(
    train: DataFrame,
    test: DataFrame,
    cats: Sequence[str],
    nums: Sequence[str],
    y: str,
    max_iter: int = 50,
    reg: float = 0.01,
) -> DataFrame:
    """``test`` with ``p``, the probability of ``y`` = 1 by a logistic regression on ``train``.
    Categories unseen in training share one column. Null numbers are an error (impute them), and so
    are labels other than 0 and 1. A category costs the driver a name and a coefficient, however many
    rows have it: ``count_encode`` or ``target_encode_oof`` columns of millions of categories."""
    classifier = LogisticRegression(
        featuresCol="_features",
        labelCol=y,
        probabilityCol="_probability",
        predictionCol="_prediction",
        rawPredictionCol="_raw",
        maxIter=max_iter,
        regParam=reg,
    )
    return _fit_predict(classifier, train, test, cats, nums, y)


def fit_predict_gbt(
    train: DataFrame,
    test: DataFrame,
    cats: Sequence[str],
    nums: Sequence[str],
    y: str,
    rounds: int = 10,
    depth: int = 3,
    seed: int = 42,
) -> DataFrame:
    """As ``fit_predict_logistic``, by gradient-boosted trees."""
    classifier = GBTClassifier(
        featuresCol="_features",
        labelCol=y,
        predictionCol="_prediction",
        maxIter=rounds,
        maxDepth=depth,
        seed=seed,
    )
    classifier.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    return _fit_predict(classifier, train, test, cats, nums, y)


def oof_predict(
    df: DataFrame, fold: str, folds: Sequence[object], fit: FitPredict
) -> DataFrame:
    """Every row of ``df`` scored by ``fit(train, test)`` trained on the other ``folds``. A row of
    no listed fold is an error.

    ``df`` is written first, one folder for each fold: a fit reads the folders it needs.
    """
    folds = list(dict.fromkeys(folds))
    if len(folds) < 2:
        raise ValueError(f"{fold} must have at least two folds")
    here = F.col(fold)
    listed = F.coalesce(here.isin(folds), F.lit(False))
    fault = F.concat(F.lit(f"{fold} has a row of no listed fold: "), F.coalesce(here.cast("string"), F.lit("null")))
    checked = df.withColumn(fold, F.when(listed, here).otherwise(F.raise_error(fault)))
    ready = freeze(checked, by=fold).select(*df.columns)
    parts = [fit(ready.filter(here != f), ready.filter(here == f)) for f in folds]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def rank_blend(
    df: DataFrame, scores: Sequence[str], weights: Sequence[float], id: str
) -> DataFrame:
    """Adds ``blend``, the weighted sum of the scores' percent ranks. Blending ranks needs no
    common scale. Null where a score is null.

    Only the unique ``id`` and the scores are written, ranked and joined to the ranks, as scores tend
    to be costly to compute; ``df`` meets the blend once, by its id.
    """
    ranked = ready = freeze(df.select(id, *scores))
    blend = F.lit(0.0)
    for i, (score, weight) in enumerate(zip(scores, weights, strict=True)):
        placed = value_counts_in_order(ready, score, [], {"_n": F.count(F.lit(1))})
        others = F.col("_n_total") - 1
        rank = F.when(others > 0, F.col("_n_before") / others).otherwise(F.lit(0.0))
        lookup = placed.select(score, rank.alias(f"_rank{i}"))
        ranked = lookup_join(ranked, lookup, [score])
        blend = blend + F.lit(float(weight)) * F.col(f"_rank{i}")
    if set(df.columns) == {id, *scores}:
        return ranked.select(*df.columns, blend.alias("blend"))
    return lookup_join(df, ranked.select(id, blend.alias("blend")), [id])
