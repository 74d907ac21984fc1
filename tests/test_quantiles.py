import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from envspark.operators import group_quantiles

PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]


def check(spark, groups, levels=2):
    rows = [(g, None if v is None else float(v)) for g, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    got = {r["g"]: r for r in group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", PROBS, levels).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        kept = [v for v in values if v is not None and v == v]
        assert (got[g]["n_rows"], got[g]["n"]) == (len(values), len(kept))
        assert got[g]["q"] == (pytest.approx(list(np.quantile(kept, PROBS)), rel=1e-12, abs=1e-300) if kept else None)


def test_any_shape_of_values(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(0, 1, 5000).tolist(), "skewed": np.exp(rng.normal(0, 20, 3000)).tolist(), "whole": rng.integers(-3, 3, 1000).astype(float).tolist(),
        "equal": [7.25] * 4000, "packed": (1000 + rng.random(3000) * 1e-6).tolist(), "both": [*(5 + rng.random(2000) * 1e-9), *(rng.random(2000) * 1e9 - 5e8)],
        "ends": [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0, 1.0], "one": [3.5], "two": [1.0, 2.0], "none": [None, None], "gaps": [None, 2.0, float("nan"), 4.0], None: [1.0, 2.0, 3.0],
        "outlier": [*rng.random(3000), 1e300],
    }
    check(spark, groups)


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_levels_change_no_result(spark, levels):
    rng = np.random.default_rng(levels)
    check(spark, {str(k): (rng.normal(k, 1, 500) ** 3).tolist() for k in range(4)}, levels)


def test_no_group_and_no_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert tuple(group_quantiles(df, [], "v", [0.5, 0.9]).first()) == (101, 101, [50.0, 90.0])
    assert group_quantiles(df.limit(0), [], "v", [0.5]).collect() == []


def test_infinities(spark):
    df = spark.createDataFrame([(float(x),) for x in ("-inf", 1, 2, 3, "inf")], "v double")
    assert group_quantiles(df, [], "v", [0, 0.25, 0.5, 1]).first()["q"] == [float("-inf"), 1.0, 2.0, float("inf")]


def test_what_a_task_sees_of_a_hot_group_is_bounded(spark):
    """200,000 distinct values of one group, packed closely: after two levels, a range holds hardly any of them."""
    from envspark.operators import quantiles

    df = spark.range(200_000).select((F.lit(50.0) + F.col("id") * 1e-11).alias("v"))
    assert df.select("v").distinct().count() == 200_000
    cell = quantiles._cell(quantiles._compressed(F.col("v")), quantiles._compressed(F.lit(50.0)), quantiles._compressed(F.lit(50.0 + 199_999 * 1e-11)))
    sizes = df.groupBy(cell.alias("c")).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 200_000 / 4096 * 4 and sizes[1] > 2000
    assert group_quantiles(df, [], "v", [0.5]).first()["q"][0] == pytest.approx(50.0 + 99_999.5e-11, abs=1e-13)
