import math

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from envspark.models import fold_column, latin_hypercube, pruned, pruning_table, regular_grid, sequence, tree_regressor, tune_points, tune_tree
from envspark.models.estimators import HandTillEvaluator
from envspark.models.pruning import weakest_links


def test_design_takes_every_slice_once():
    points = latin_hypercube({"a": (0.0, 1.0), "b": (1, 40), "c": (-2.0, 2.0)}, 20, seed=1)
    assert len(points) == 20 and points == latin_hypercube({"a": (0.0, 1.0), "b": (1, 40), "c": (-2.0, 2.0)}, 20, seed=1)
    assert sorted(int(p["a"] * 20) for p in points) == list(range(20))
    assert sorted((p["b"] - 1) // 2 for p in points) == list(range(20)) and all(isinstance(p["b"], int) for p in points)
    assert sorted(math.floor((p["c"] + 2) * 5) for p in points) == list(range(20))
    assert {p["m"] for p in latin_hypercube({"m": (1, 4)}, 20, seed=2)} == {1, 2, 3, 4}


def test_design_spreads_better_than_chance():
    def closest(points):
        return min(math.dist(p.values(), q.values()) for i, p in enumerate(points) for q in points[:i])

    ranges = {"a": (0.0, 1.0), "b": (0.0, 1.0)}
    assert closest(latin_hypercube(ranges, 20, 3)) > closest(latin_hypercube(ranges, 20, 3, tries=1))


def test_grid():
    assert regular_grid(a=(0, 1, 3), b=(5, 5, 1)) == [{"a": 0.0, "b": 5}, {"a": 0.5, "b": 5}, {"a": 1.0, "b": 5}]


@pytest.fixture(scope="module")
def steps(spark):
    """An outcome with steps at 10, 20 and 30, the smallest last, and a little noise."""
    x = F.col("id") % 40
    y = F.when(x < 10, 0).when(x < 20, 50).when(x < 30, 70).otherwise(73) + (F.col("id") * 7919 % 101) / 100
    return spark.range(2000).select("id", x.cast("double").alias("x"), y.cast("double").alias("y"))


def test_search_fits_stages_per_fold_and_refits_the_best(steps):
    rows = fold_column(steps, 4, "id", 5)
    model, table = tune_points(tree_regressor("y", ["x"], min_gain=0.0), rows, [{"maxDepth": 1}, {"maxDepth": 3}, {"maxDepth": 2}], RegressionEvaluator(labelCol="y", metricName="rmse"))
    got = {r["candidate"]: r for r in table.collect()}
    assert [got[i]["value"] for i in range(3)] == ["1", "3", "2"] and [got[i]["best"] for i in range(3)] == [False, True, False]
    assert got[0]["mean"] > got[2]["mean"] > got[1]["mean"] and model.stages[-1].depth == 3
    errors = []
    for k in range(4):
        left = rows.filter((F.col("fold") != k) & (F.col("x") < 10)).agg(F.avg("y")).first()[0]
        right = rows.filter((F.col("fold") != k) & (F.col("x") >= 10)).agg(F.avg("y")).first()[0]
        errors.append(rows.filter(F.col("fold") == k).agg(F.sqrt(F.avg((F.col("y") - F.when(F.col("x") < 10, left).otherwise(right)) ** 2))).first()[0])
    assert got[0]["mean"] == pytest.approx(sum(errors) / 4)


def test_links_are_cut_weakest_first(spark, steps):
    model = tree_regressor("y", ["x"], depth=4, min_gain=0.0).fit(steps)
    trees = sequence(model)
    alphas, leaves, risks = zip(*trees)
    assert list(alphas) == sorted(alphas) and leaves[-1] == 1 and list(leaves) == sorted(leaves, reverse=True) and list(risks) == sorted(risks)
    assert [n for n in leaves if n <= 4] == [4, 3, 2, 1]
    total = steps.agg(F.var_pop("y") * F.count("*")).first()[0]
    assert risks[-1] == pytest.approx(total)
    nodes = pruning_table(spark, model).collect()
    assert all(r["alpha"] <= nodes[r["parent"]]["alpha"] + 1e-9 for r in nodes if r["parent"] is not None)
    assert sum(r["n"] for r in nodes if r["leaf"] is not None) == 2000


def test_pruned_trees_are_those_of_least_cost():
    """Of all prunings of a tree, that at an alpha has the least risk + alpha * leaves."""
    import random

    rng = random.Random(3)

    def grow(nodes, parent, depth, risk):
        i = len(nodes)
        nodes.append({"node": i, "parent": parent, "depth": depth, "leaf": None, "risk": risk, "n": 1.0, "prediction": 0.0})
        if depth < 4 and rng.random() < 0.8:
            share, gain = rng.random(), rng.random()
            grow(nodes, i, depth + 1, risk * (1 - gain) * share)
            grow(nodes, i, depth + 1, risk * (1 - gain) * (1 - share))
        return nodes

    def cheapest(nodes, i, alpha):
        kids = [x["node"] for x in nodes if x["parent"] == i]
        own = nodes[i]["risk"] + alpha
        return min([own] + [sum(cheapest(nodes, k, alpha) for k in kids)] * bool(kids))

    def cost(nodes, i, alpha):
        kids = [x["node"] for x in nodes if x["parent"] == i]
        return nodes[i]["risk"] + alpha if not kids or nodes[i]["alpha"] <= alpha else sum(cost(nodes, k, alpha) for k in kids)

    for _ in range(50):
        nodes = weakest_links(grow([], None, 0, 100.0))
        for alpha in [0.0, *(x["alpha"] * f for x in nodes for f in (0.99, 1.01)), 200.0]:
            assert cost(nodes, 0, alpha) == pytest.approx(cheapest(nodes, 0, alpha))


def test_predictions_of_pruned_trees(steps):
    model = tree_regressor("y", ["x"], depth=4, min_gain=0.0).fit(steps)
    got = {r["cost"]: r["n"] for r in pruned(model, steps, [0.0, 0.01, 0.5, 1.0]).groupBy("cost").agg(F.count_distinct("prediction").alias("n")).collect()}
    assert got[1.0] == 1 and got[0.5] == 2 and got[0.0] > got[0.01] >= 3
    whole = pruned(model, steps, [0.0]).select("id", "prediction").exceptAll(model.transform(steps).select("id", "prediction"))
    assert whole.count() == 0


def test_search_over_depth_and_cost(steps):
    rows = fold_column(steps, 5, "id", 5, strata="y", breaks=4)
    table = tune_tree(tree_regressor("y", ["x"], min_gain=0.0), rows, [1, 3], [1e-10, 0.01, 1.0]).collect()
    assert len(table) == 6 and {r["folds"] for r in table} == {5} and sum(r["best"] for r in table) == 1
    mean = {(r["depth"], r["cost"]): r["mean"] for r in table}
    assert mean[3, 1e-10] < mean[1, 1e-10] < mean[1, 1.0] == pytest.approx(mean[3, 1.0])


def test_area_from_rounded_scores_is_the_exact_one_where_scores_have_few_digits(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(float(i % 3), Vectors.dense([(i * 7 % 10) / 20, (i * 3 % 10) / 20, round(1 - (i * 7 % 10) / 20 - (i * 3 % 10) / 20, 2)])) for i in range(200)]
    scored = spark.createDataFrame(rows, ["label_index", "probability"])
    assert HandTillEvaluator(3).evaluate(scored) == pytest.approx(HandTillEvaluator(3, digits=None).evaluate(scored))
    one = scored.filter("label_index = 0")
    assert HandTillEvaluator(3).evaluate(one) == 0.0


def test_links_of_a_large_tree_are_cut_without_reading_it_whole_at_every_step():
    import time

    nodes = []

    def grow(parent, depth, risk):
        i = len(nodes)
        nodes.append({"node": i, "parent": parent, "depth": depth, "leaf": None, "risk": risk, "n": 1.0, "prediction": 0.0})
        if depth < 13:
            share = 0.3 + (i * 7919 % 101) / 400
            grow(i, depth + 1, risk * 0.9 * share)
            grow(i, depth + 1, risk * 0.9 * (1 - share))

    grow(None, 0, 100.0)
    began = time.process_time()
    alphas = [x["alpha"] for x in weakest_links(nodes)]
    assert time.process_time() - began < 20 and len(nodes) == 16383
    assert all(alphas[x["node"]] <= alphas[x["parent"]] for x in nodes[1:])


def test_search_grows_one_tree_a_fold_and_scores_all_depths_as_trees_grown_no_deeper(spark, monkeypatch):
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = spark.range(3000).select("id", (F.col("id") * 7919 % 61).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("z"))
    rows = fold_column(rows.withColumn("y", F.round(F.sin(F.col("x") / 90) * 100) + F.col("z") * F.col("z")), 3, "id", 5)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    depths, costs, fits = [1, 3, 6], [1e-10, 1e-3, 0.1], []
    expected = {}
    for depth in depths:
        errors = {c: [] for c in costs}
        for k in range(3):
            model = tree_regressor("y", ["x", "z"], depth=depth, min_gain=0.0).fit(rows.filter(F.col("fold") != k))
            for r in pruned(model, rows.filter(F.col("fold") == k), costs).groupBy("cost").agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("e")).collect():
                errors[r["cost"]].append(r["e"])
        expected |= {(depth, c): sum(e) / 3 for c, e in errors.items()}
    grown = DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, df: fits.append(self.getMaxDepth()) or grown(self, df))
    got = {(r["depth"], r["cost"]): r["mean"] for r in tune_tree(tree_regressor("y", ["x", "z"], min_gain=0.0), rows, depths, costs).collect()}
    assert fits == [6, 6, 6]
    assert got == {k: pytest.approx(v) for k, v in expected.items()}


def test_fold_tables_have_files_by_their_rows(spark, monkeypatch):
    """Each fit reads its rows in many short passes; a small table from many tasks goes in one."""
    from pyspark.ml.feature import VectorAssembler

    from envspark.models import search

    df = spark.range(0, 400, 1, 12).select((F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("x"), "id")
    for rows, least, most in ((1 << 18, 1, 1), (50, 2, 8)):
        monkeypatch.setattr(search, "TASK_ROWS", rows)
        folds = search.Folds([VectorAssembler(inputCols=["x"], outputCol="features")], df, "fold", ["id"], 2)
        assert folds.names == [0, 1] and sorted(r.id for r in folds.rows.collect()) == list(range(400))
        for k, (train, held_out) in enumerate(folds.parts):
            assert least <= train.rdd.getNumPartitions() <= most
            assert sorted(r.id for r in held_out.collect()) == list(range(k, 400, 2))
            assert sorted(r.id for r in train.collect()) == list(range(1 - k, 400, 2))
        folds.close()
