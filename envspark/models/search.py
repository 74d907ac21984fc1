"""Search over candidate points: space-filling designs, regular grids, cross-validation with shared feature stages."""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.models.forests import can_grow, search_scores
from envspark.session import remove, staged

#: Rows of a fold's table per task: each fit reads it in a dozen short passes, so small tables go in few tasks.
TASK_ROWS = 1 << 18

CANDIDATES = "candidate int, parameter string, value string, mean double, std double, best boolean"


def latin_hypercube(ranges: dict[str, tuple[float, float]], size: int, seed: int, tries: int = 200) -> list[dict]:
    """``size`` points that fill the space of the ranges: every parameter takes each of ``size`` even slices of its range once.

    Of ``tries`` random designs, that whose two closest points lie farthest
    apart is taken. A range of two whole numbers gives whole numbers, its ends
    included; slices of a range shorter than ``size`` then share values.
    """
    rng = random.Random(seed)
    best: tuple[float, list] = (-1.0, [])
    for _ in range(tries):
        axes = [rng.sample(range(size), size) for _ in ranges]
        places = list(zip(*axes))
        apart = min((sum((a - b) ** 2 for a, b in zip(p, q)) for i, p in enumerate(places) for q in places[:i]), default=0)
        if apart > best[0]:
            best = apart, places

    def at(low: float, high: float, slice_: int) -> float:
        share = (slice_ + 0.5) / size
        return int(low + share * (high - low + 1)) if isinstance(low, int) and isinstance(high, int) else low + share * (high - low)

    return [{name: at(*ranges[name], s) for name, s in zip(ranges, place)} for place in best[1]]


def grid_points(grid: dict[str, Sequence]) -> list[dict]:
    """Every combination of the listed values."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def regular_grid(**ranges: tuple[float, float, int]) -> list[dict]:
    """Every combination of evenly spaced values, from (low, high, levels) per parameter."""
    return grid_points({name: [lo + (hi - lo) * i / max(levels - 1, 1) for i in range(levels)] for name, (lo, hi, levels) in ranges.items()})


class Folds:
    """Training and held-out rows of every fold, with the feature stages fitted once per fold and their output written once.

    All candidates of a fold read the same two tables; only the columns
    ``features`` and ``keep`` are in them. Their number of files follows the rows.
    ``rows`` are those of all folds, until :meth:`close`.
    """

    def __init__(self, stages: Sequence, df: DataFrame, fold_col: str, keep: Sequence[str], parallelism: int):
        held = self.rows = staged(df, "folds")
        rows = held.coalesce(max(1, -(-held.count() // TASK_ROWS)))
        self.fold_col = fold_col
        self.names = sorted(r[0] for r in rows.select(fold_col).distinct().collect())

        def prepare(fold: int) -> tuple[DataFrame, DataFrame]:
            here = F.col(fold_col) == fold
            model = Pipeline(stages=list(stages)).fit(rows.filter(~here))
            return tuple(staged(model.transform(rows.filter(c)).select("features", *keep), "fold") for c in (~here, here))

        with ThreadPool(parallelism) as pool:
            self.parts = pool.map(inheritable_thread_target(df.sparkSession)(prepare), self.names)

    def close(self) -> None:
        remove(self.rows)
        for part in self.parts:
            for df in part:
                remove(df)


def tune_points(
    pipeline: Pipeline, df: DataFrame, points: Sequence[dict], evaluator: Evaluator, fold_col: str = "fold", keep: Sequence[str] = (), parallelism: int = 4
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated search over explicit points of the last stage's parameters.

    Returns the model refitted with the best candidate on all rows, and the
    candidates as (candidate, parameter, value, mean, std, best) rows; of equal
    candidates the first is best. Feature stages see the training rows of their
    fold only. Forests of all folds and candidates grow together (see
    :mod:`envspark.models.forests`); other estimators are fitted one by one,
    ``parallelism`` at the same time.
    """
    estimator = pipeline.getStages()[-1]
    folds = Folds(pipeline.getStages()[:-1], df, fold_col, dict.fromkeys([estimator.getLabelCol(), *keep]), parallelism)

    def params(point: dict) -> dict:
        named = {estimator.getParam(name): value for name, value in point.items()}
        return {p: str(v) if p.typeConverter is TypeConverters.toString else p.typeConverter(v) for p, v in named.items()}

    def score(job: tuple[dict, tuple[DataFrame, DataFrame]]) -> float:
        point, (train, held_out) = job
        return evaluator.evaluate(estimator.fit(train, params(point)).transform(held_out))

    if can_grow(estimator, points, evaluator):
        scores = search_scores(folds, estimator, [params(p) for p in points], evaluator, parallelism)
    else:
        with ThreadPool(parallelism) as pool:
            scores = pool.map(inheritable_thread_target(df.sparkSession)(score), [(p, part) for p in points for part in folds.parts], chunksize=1)
    each = [scores[i : i + len(folds.names)] for i in range(0, len(scores), len(folds.names))]
    means = [fmean(x) for x in each]
    best = (max if evaluator.isLargerBetter() else min)(range(len(means)), key=means.__getitem__)
    rows = [(i, name, str(value), means[i], pstdev(each[i]), i == best) for i, point in enumerate(points) for name, value in point.items()]
    final = Pipeline(stages=[*pipeline.getStages()[:-1], estimator.copy(params(points[best]))]).fit(folds.rows)
    folds.close()
    return final, df.sparkSession.createDataFrame(rows, CANDIDATES)
