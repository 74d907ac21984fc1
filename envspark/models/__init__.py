"""Splits, Spark ML estimators, tuning and model evaluation."""

from envspark.models.codes import category_codes, with_codes  # noqa: F401
from envspark.models.estimators import (  # noqa: F401
    HandTillEvaluator,
    augment,
    importance,
    label_index,
    node_stats,
    ols,
    residuals,
    rf_classifier,
    rf_regressor,
    tree_regressor,
    tune,
)
from envspark.models.evaluate import (  # noqa: F401
    confusion,
    confusion_wide,
    metrics,
    regression_errors,
    risk,
    roc_auc,
    roc_curve,
)
from envspark.models.grouped_ols import ols_by  # noqa: F401
from envspark.models.pruning import pruned, pruning_table, sequence, tune_tree  # noqa: F401
from envspark.models.search import grid_points, latin_hypercube, regular_grid, tune_points  # noqa: F401
from envspark.models.splits import fold_column, hash_rank, split_stratified  # noqa: F401
