"""Model runs: train, score, evaluate, tune and compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.models.estimators import HandTillEvaluator, augment, label_index, rf_classifier
from envspark.models.evaluate import confusion, metrics, roc_curve
from envspark.models.grouped_ols import ols_by
from envspark.models.search import grid_points, tune_points
from envspark.models.splits import fold_column, split_stratified
from envspark.operators.reshape import tagged_union
from envspark.session import staged

PREFIX = ".pred_"


def score_columns(levels: Sequence[str]) -> dict[str, str]:
    return {l: f"{PREFIX}{l}" for l in levels}


def train_classifier(
    df: DataFrame, label: str, levels: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], key: str, prop: float = 0.75, seed: int = 123, **forest
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Stratified split, forest on the training part; returns model, train and test rows.

    The split table is written once: every pass of the training reads it back.
    ``max_bins`` among ``forest`` has to cover every categorical column's
    values (64 by default); the training raises an error where it does not.
    """
    rows = label_index(df.select(key, label, *numeric, *categorical).dropna(), label, levels)
    parts = staged(split_stratified(rows, label, prop, key, seed), "split")
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    model = rf_classifier(numeric, categorical, seed=seed, **forest).fit(train)
    return model, train, test


def evaluate(model: PipelineModel, parts: dict[str, DataFrame], label: str, levels: Sequence[str]) -> DataFrame:
    """Metrics of one model on several row sets (training against held-out rows, say); rows are scored once each."""
    scores = score_columns(levels)
    scored = {name: staged(augment(model, rows, levels).select(label, f"`{PREFIX}class`", *[f"`{c}`" for c in scores.values()]), "scored") for name, rows in parts.items()}
    return tagged_union({name: metrics(rows, label, f"{PREFIX}class", scores) for name, rows in scored.items()}, "part")


def confusion_of(model: PipelineModel, rows: DataFrame, label: str, levels: Sequence[str], share_by: str = "truth") -> DataFrame:
    return confusion(augment(model, rows, levels), label, f"{PREFIX}class", levels, share_by)


def forest_ranges(predictors: int) -> dict[str, tuple[int, int]]:
    """What is searched for a forest: predictors tried per split, and rows a node holds at least."""
    return {"featureSubsetStrategy": (1, predictors), "minInstancesPerNode": (2, 40)}


def tune_classifier(
    train: DataFrame, label: str, levels: Sequence[str], pipeline: Pipeline, grid: dict[str, Sequence] | Sequence[dict], key: str, folds: int = 10, seed: int = 234, parallelism: int = 4
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated search by Hand-Till AUC and refit with the best candidate.

    ``grid`` lists values per parameter, all combinations of which are tried, or
    the points themselves (see :func:`latin_hypercube`).
    """
    rows = fold_column(train, folds, key, seed)
    points = grid_points(grid) if isinstance(grid, dict) else grid
    return tune_points(pipeline, rows, points, HandTillEvaluator(len(levels)), parallelism=parallelism)


def compare_feature_sets(
    df: DataFrame, label: str, levels: Sequence[str], sets: dict[str, tuple[Sequence[str], Sequence[str]]], key: str, level: str | None = None, **forest
) -> DataFrame:
    """ROC rows of models on different predictors but the same split, optionally for one class."""
    curves = {}
    for name, (numeric, categorical) in sets.items():
        model, _, test = train_classifier(df, label, levels, numeric, categorical, key, **forest)
        curve = roc_curve(augment(model, test, levels), label, score_columns(levels))
        curves[name] = curve.filter(F.col("level") == level) if level else curve
    return tagged_union(curves, "model")


def best_group_models(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], min_n: int = 100) -> DataFrame:
    """One regression per group, without exact fits and small groups, best R² first; ``best`` marks the highest, with ties."""
    fits = ols_by(df, by, y, xs)
    kept = fits.filter((F.col("nobs") > min_n) & ~(F.round("r_squared", 12) == 1.0))
    top = kept.agg(F.max(F.round("r_squared", 9))).scalar()
    return kept.withColumn("best", F.round("r_squared", 9) == top).orderBy(F.desc("r_squared"), *by)


def log_level(df: DataFrame, level: str, name: str, warm: Column | None = None) -> DataFrame:
    """The outcome as ln(level + 1), optionally on the rows a condition selects."""
    rows = df if warm is None else df.filter(warm)
    return rows.withColumn(name, F.ln(F.col(level) + 1))
