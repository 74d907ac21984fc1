"""Spark ML pipelines, tuning, scoring and fit read-outs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envspark.models.evaluate import _q, roc_auc
from envspark.models.search import grid_points, tune_points

MAX_DEPTH = 30  # Spark's limit


def _depth(depth: int) -> int:
    if depth > MAX_DEPTH:
        raise ValueError(f"trees can be {MAX_DEPTH} deep, not {depth}")
    return depth


def label_index(df: DataFrame, label: str, levels: Sequence[str]) -> DataFrame:
    """Add ``label_index``, the 0-based position of the label in level order; other labels are dropped."""
    at = F.array_position(F.array(*[F.lit(l) for l in levels]), F.col(label))
    return df.withColumn("label_index", (at - 1).cast("double")).filter(F.col("label_index") >= 0)


def _feature_stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Numbers centred and scaled with the training rows' statistics, categories indexed with a place for unseen ones."""
    stages: list = []
    inputs: list[str] = []
    if categorical:
        indexed = [f"{c}_ix" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        inputs += indexed
    if numeric:
        stages.append(VectorAssembler(inputCols=list(numeric), outputCol="numbers"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
        inputs.append("scaled")
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def rf_classifier(
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    trees: int = 500,
    mtry: str | int = "sqrt",
    min_n: int = 10,
    depth: int = MAX_DEPTH,
    max_bins: int = 64,
    seed: int = 123,
) -> Pipeline:
    """Random forest on ``label_index`` with impurity importance."""
    forest = RandomForestClassifier(
        labelCol="label_index",
        featuresCol="features",
        impurity="gini",
        numTrees=trees,
        featureSubsetStrategy=str(mtry),
        minInstancesPerNode=min_n,
        maxDepth=_depth(depth),
        maxBins=max_bins,
        seed=seed,
    )
    return Pipeline(stages=[*_feature_stages(numeric, categorical), forest])


def rf_regressor(
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    trees: int = 500,
    mtry: str | int = "sqrt",
    min_n: int = 5,
    depth: int = MAX_DEPTH,
    max_bins: int = 64,
    seed: int = 123,
) -> Pipeline:
    forest = RandomForestRegressor(
        labelCol=y,
        featuresCol="features",
        numTrees=trees,
        featureSubsetStrategy=str(mtry),
        minInstancesPerNode=min_n,
        maxDepth=_depth(depth),
        maxBins=max_bins,
        seed=seed,
    )
    return Pipeline(stages=[*_feature_stages(numeric, categorical), forest])


def tree_regressor(
    y: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    depth: int = MAX_DEPTH,
    min_gain: float = 0.01,
    min_n: int = 20,
    max_bins: int = 64,
    seed: int = 123,
) -> Pipeline:
    """Regression tree; ``min_gain`` limits its growth, :mod:`envspark.models.pruning` prunes it by cost and complexity."""
    tree = DecisionTreeRegressor(
        labelCol=y,
        featuresCol="features",
        maxDepth=_depth(depth),
        minInfoGain=min_gain,
        minInstancesPerNode=min_n,
        maxBins=max_bins,
        seed=seed,
    )
    return Pipeline(stages=[*_feature_stages(numeric, categorical), tree])


class HandTillEvaluator(Evaluator):
    """Hand-Till AUC of a classifier's ``probability`` column against ``label_index``.

    With ``digits``, probabilities that agree to so many digits count as equal:
    then counts per class and rounded probability are all there is to rank, a
    bounded table whatever the number of rows, and :meth:`evaluate_by` takes
    all candidates of a search in one aggregation. Without, ranks are exact.
    """

    def __init__(self, n_levels: int, digits: int | None = 4):
        super().__init__()
        self.n_levels, self.digits = n_levels, digits

    def isLargerBetter(self) -> bool:
        return True

    def _evaluate(self, dataset: DataFrame) -> float:
        p = vector_to_array("probability")
        levels = range(self.n_levels)
        if self.digits is None:
            scored = dataset.select(F.col("label_index").cast("string").alias("truth"), *[p[i].alias(f"s{i}") for i in levels])
            value = roc_auc(scored, "truth", {str(float(i)): f"s{i}" for i in levels}).first()["estimate"]
            return 0.0 if value is None else value
        return self.evaluate_by(dataset.select("label_index", p.alias("probability")), []).get((), 0.0)

    def evaluate_by(self, dataset: DataFrame, by: Sequence[str]) -> dict[tuple, float]:
        """The value of every group of rows, of (``by``, ``label_index``, ``probability``) with probabilities as an array."""
        levels = range(self.n_levels)
        rows = dataset.select(*by, "label_index", F.posexplode("probability").alias("level", "p")).select(*by, "label_index", "level", F.round("p", self.digits).alias("p"))
        counts = rows.groupBy(*by, "level", "p").agg(*[F.count(F.when(F.col("label_index") == j, 1)).alias(f"n{j}") for j in levels])
        below = Window.partitionBy(*by, "level").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # at most 10^digits + 1 rows
        own = F.element_at(F.array(*[F.col(f"n{j}") for j in levels]), F.col("level") + 1)
        ranked = counts.select(*by, "level", own.alias("own"), *[(F.coalesce(F.sum(f"n{j}").over(below), F.lit(0)) + F.col(f"n{j}") / 2).alias(f"b{j}") for j in levels], *[f"n{j}" for j in levels])
        sums = ranked.groupBy(*by, "level").agg(F.sum("own").alias("own"), *[F.sum(F.col("own") * F.col(f"b{j}")).alias(f"u{j}") for j in levels], *[F.sum(f"n{j}").alias(f"n{j}") for j in levels]).collect()
        pairs: dict[tuple, list] = {tuple(r[c] for c in by): [] for r in sums}
        for r in sums:
            pairs[tuple(r[c] for c in by)] += [r[f"u{j}"] / (r["own"] * r[f"n{j}"]) for j in levels if j != r["level"] and r["own"] and r[f"n{j}"]]
        return {at: sum(x) / len(x) if x else 0.0 for at, x in pairs.items()}


def tune(
    pipeline: Pipeline, df: DataFrame, grid: dict[str, Sequence], evaluator: Evaluator, fold_col: str = "fold", parallelism: int = 4
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated search over every combination of the listed values; see :func:`tune_points`."""
    return tune_points(pipeline, df, grid_points(grid), evaluator, fold_col, parallelism=parallelism)


def augment(model: PipelineModel, df: DataFrame, levels: Sequence[str], prefix: str = ".pred_") -> DataFrame:
    """The input columns plus ``.pred_class`` and one probability column per level."""
    scored = model.transform(df)
    p = vector_to_array("probability")
    names = F.array(*[F.lit(l) for l in levels])
    return scored.select(
        *[_q(c) for c in df.columns],
        F.get(names, F.col("prediction").cast("int")).alias(f"{prefix}class"),
        *[p[i].alias(f"{prefix}{l}") for i, l in enumerate(levels)],
    )


def importance(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """(variable, importance) of the fitted trees, most important first; sums to 1."""
    values = model.stages[-1].featureImportances.toArray()
    names = [*categorical, *numeric]
    spark = SparkSession.active()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "variable string, importance double").orderBy(F.desc("importance"), "variable")


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Linear model on all predictors: coefficient rows, one row of fit statistics, and the model for fitted values."""
    rows = df.dropna(subset=[y, *xs])
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(xs), outputCol="features"),
            LinearRegression(labelCol=y, featuresCol="features", predictionCol="fitted", solver="normal", regParam=0.0),
        ]
    )
    model = pipeline.fit(rows)
    fit = model.stages[-1]
    s = fit.summary
    terms = [*xs, "(Intercept)"]
    estimates = [*fit.coefficients.toArray(), fit.intercept]
    spark = df.sparkSession
    coefficients = spark.createDataFrame(
        [
            (t, float(e), float(se), float(tv), float(pv))
            for t, e, se, tv, pv in zip(terms, estimates, s.coefficientStandardErrors, s.tValues, s.pValues)
        ],
        "term string, estimate double, std_error double, statistic double, p_value double",
    )
    glance = spark.createDataFrame(
        [(float(s.r2), float(s.r2adj), float(s.rootMeanSquaredError), int(s.numInstances))],
        "r_squared double, adj_r_squared double, rmse double, nobs long",
    )
    return coefficients, glance, model


def residuals(model: PipelineModel, df: DataFrame, y: str, prediction: str = "prediction") -> DataFrame:
    """Inputs with the model's prediction and the residual."""
    return model.transform(df).select(*df.columns, F.col(prediction), (F.col(y) - F.col(prediction)).alias("residual"))


def node_stats(model: PipelineModel, df: DataFrame, y: str) -> DataFrame:
    """Mean and variance of the outcome in every leaf of a fitted regression tree."""
    tree = model.stages[-1].copy()
    tree.setLeafCol("leaf")
    scored = tree.transform(PipelineModel(model.stages[:-1]).transform(df))
    return scored.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("variance"))
