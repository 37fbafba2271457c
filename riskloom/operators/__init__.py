"""The operators, by the step of a modelling project they belong to."""

from riskloom.operators.check import (
    dominant_value,
    duplicate_keys,
    profile_columns,
    reference_gaps,
)
from riskloom.operators.clean import clip_quantiles, group_rare, impute_median
from riskloom.operators.encode import (
    count_encode,
    equal_width_bin,
    one_hot,
    ordinal_encode,
    quantile_bin,
    target_encode_oof,
    woe_iv,
)
from riskloom.operators.evaluate import auc, calibration, gain_table, ks, threshold_table
from riskloom.operators.features import (
    category_share,
    cross_feature,
    entity_features,
    group_rank,
    json_attribute,
    last_event_asof,
    recency_gap,
    trailing_features,
)
from riskloom.operators.intervals import interval_join
from riskloom.operators.model import (
    fit_predict_gbt,
    fit_predict_logistic,
    oof_predict,
    rank_blend,
)
from riskloom.operators.select import chi_square, correlation, psi
from riskloom.operators.split import (
    downsample,
    hash_split,
    part_ranges,
    stratified_folds,
    time_split,
)

__all__ = [
    "auc",
    "calibration",
    "category_share",
    "chi_square",
    "clip_quantiles",
    "correlation",
    "count_encode",
    "cross_feature",
    "dominant_value",
    "downsample",
    "duplicate_keys",
    "entity_features",
    "equal_width_bin",
    "fit_predict_gbt",
    "fit_predict_logistic",
    "gain_table",
    "group_rank",
    "group_rare",
    "hash_split",
    "impute_median",
    "interval_join",
    "json_attribute",
    "ks",
    "last_event_asof",
    "one_hot",
    "oof_predict",
    "ordinal_encode",
    "part_ranges",
    "profile_columns",
    "psi",
    "quantile_bin",
    "rank_blend",
    "recency_gap",
    "reference_gaps",
    "stratified_folds",
    "target_encode_oof",
    "threshold_table",
    "time_split",
    "trailing_features",
    "woe_iv",
]
