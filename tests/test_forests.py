from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from envspark.models import fold_column, forests, rf_classifier, search, tune_points
from envspark.models.estimators import HandTillEvaluator


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that follow two numbers and some values of two categories, one of few values and one of many, and a little noise."""
    i = F.col("id")
    df = spark.range(2400).select("id", (i * 7919 % 97 / 7).alias("x"), (i * 31 % 401).cast("double").alias("z"), F.concat(F.lit("c"), (i * 13 % 5).cast("string")).alias("few"), F.concat(F.lit("d"), (i * 17 % 23).cast("string")).alias("many"))
    value = F.sin("x") * 3 + F.col("z") / 100 + F.when(F.col("few").isin("c1", "c3"), 2).otherwise(0) + F.when(F.col("many").isin("d3", "d8"), 3).otherwise(0) + i * 104729 % 7 / 5
    return search.staged(fold_column(df.withColumn("label_index", F.abs(F.floor(value) % 3).cast("double")), 2, "id", 5), "forest-test")


def _forest(trees=1, **kwargs):
    return rf_classifier(["x", "z"], ["few", "many"], trees=trees, min_n=5, depth=5, **kwargs)


@pytest.mark.parametrize("classes, impurity", [(3, "gini"), (2, "entropy")])
def test_trees_without_draws_are_those_of_spark(rows, monkeypatch, classes, impurity):
    """However rows and nodes are dealt into blocks, parts and passes."""
    for name, value in (("BLOCK_ROWS", 500), ("NODES", 3), ("PASS_BYTES", 1)):
        monkeypatch.setattr(forests, name, value)
    pipeline = _forest(mtry="all")
    forest = pipeline.getStages()[-1].setBootstrap(False).setImpurity(impurity)
    folds = search.Folds(pipeline.getStages()[:-1], rows.withColumn("label_index", F.col("label_index") % classes), "fold", ["label_index"], 4)
    points = [{forest.minInstancesPerNode: 40}, {forest.maxDepth: 6}, {forest.minInfoGain: 0.02}, {forest.maxDepth: 0}]
    grown = forests.Search(folds, forest, [forests.spec_of(forest, p) for p in points], 4)
    grown.grow()
    got = Counter()
    for r in grown.scored().select("candidate", "fold", "label_index", F.transform("probability", lambda p: F.round(p, 9)).alias("p")).collect():
        got[r["candidate"], r["fold"], r["label_index"], tuple(r["p"])] += 1
    want = Counter()
    for c, point in enumerate(points):
        for k, (train, held_out) in enumerate(folds.parts):
            scored = forest.fit(train, point).transform(held_out)
            for r in scored.select("label_index", F.transform(vector_to_array("probability"), lambda p: F.round(p, 9)).alias("p")).collect():
                want[c, k, r["label_index"], tuple(r["p"])] += 1
    grown.close()
    folds.close()
    assert got == want


def test_search_grows_forests_together_and_fits_only_the_best_one_by_itself(rows, monkeypatch):
    fits, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: fits.append(self.getMinInstancesPerNode()) or fit(self, df))
    points = [{"minInstancesPerNode": n, "featureSubsetStrategy": m} for n, m in ((400, 1), (5, 3), (5, "all"))]
    pipeline = _forest(trees=8)
    model, table = tune_points(pipeline, rows, points, HandTillEvaluator(3), keep=["id"])
    got = {r["candidate"]: (r["mean"], r["best"]) for r in table.collect()}
    assert len(fits) == 1 and model.stages[-1].getNumTrees == 8
    best = max(got, key=lambda c: got[c][0])
    assert [c for c in got if got[c][1]] == [best] and best > 0 and fits == [5]
    monkeypatch.setattr(search, "can_grow", lambda *_: False)  # each by itself
    single = {r["candidate"]: r["mean"] for r in tune_points(pipeline, rows, points, HandTillEvaluator(3))[1].collect()}
    assert len(fits) == 1 + 2 * 3 + 1
    assert {c: m for c, (m, _) in got.items()} == {c: pytest.approx(m, abs=0.05) for c, m in single.items()}


def test_searches_over_other_things_are_fitted_one_by_one(rows):
    forest = _forest().getStages()[-1]
    assert forests.can_grow(forest, [{"numTrees": 3}], HandTillEvaluator(3))
    assert not forests.can_grow(forest, [{"maxBins": 8}], HandTillEvaluator(3))
    assert not forests.can_grow(forest, [{}], HandTillEvaluator(3, digits=None))
    assert not forests.can_grow(forest.copy().setWeightCol("w"), [{}], HandTillEvaluator(3))


def test_draws_repeat_and_follow_their_shares():
    spec = forests.Spec(10, 5, 1, 0.0, "2", "gini", 1.0, True, -7)
    times = forests.drawn(spec, 3, 1, 100_000)
    assert (times == forests.drawn(spec, 3, 1, 100_000)).all() and (times != forests.drawn(spec, 3, 2, 100_000)).any()
    assert times.mean() == pytest.approx(1, abs=0.02) and times.var() == pytest.approx(1, abs=0.03)
    assert forests.drawn(spec._replace(bootstrap=False, rate=0.3), 3, 1, 100_000).mean() == pytest.approx(0.3, abs=0.01)
    tree = forests.Tree(4)
    tree.open = np.zeros(9000, np.int64)
    tree.draw(spec, 0, 2, 6)
    assert tree.tried.shape == (9000, 2) and (tree.tried[:, 0] < tree.tried[:, 1]).all()
    assert np.bincount(tree.tried.ravel()) == pytest.approx([3000] * 6, rel=0.1)
    assert [spec._replace(subset=s).mtry(5) for s in ("auto", "sqrt", "log2", "onethird", "all", "9", "0.5")] == [3, 3, 3, 2, 5, 5, 3]


def test_categories_beyond_the_bins_raise(rows):
    with pytest.raises(ValueError, match="maxBins"):
        tune_points(_forest(max_bins=16), rows, [{"numTrees": 2}], HandTillEvaluator(3))
