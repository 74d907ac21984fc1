import math

import pytest
from pyspark.sql import functions as F

from envspark.functions.measures import QUALITY_LEVELS
from envspark.models import category_codes, confusion, confusion_wide, fold_column, metrics, ols_by, regression_errors, risk, roc_auc, roc_curve, split_stratified, with_codes
from envspark.models.grouped_ols import _f_tail

SCHEMA = "quality string, pred string, s double, c double, u double"
ROWS = [
    ("Safe", "Safe", 0.7, 0.2, 0.1),
    ("Safe", "Safe", 0.6, 0.3, 0.1),
    ("Safe", "Unsafe", 0.2, 0.3, 0.5),
    ("Caution", "Safe", 0.5, 0.4, 0.1),
    ("Unsafe", "Unsafe", 0.1, 0.1, 0.8),
    ("Unsafe", "Safe", 0.6, 0.3, 0.1),
]
SCORES = dict(zip(QUALITY_LEVELS, "scu"))


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_confusion_keeps_levels_never_predicted(scored):
    grid = confusion(scored, "quality", "pred", QUALITY_LEVELS)
    rows = {(r["truth"], r["prediction"]): (r["n"], r["prop"]) for r in grid.collect()}
    assert len(rows) == 9 and sum(n for n, _ in rows.values()) == 6
    assert rows[("Safe", "Caution")] == (0, 0.0) and rows[("Unsafe", "Safe")] == (1, 0.5)
    wide = {r["truth"]: tuple(r)[1:] for r in confusion_wide(grid, QUALITY_LEVELS).collect()}
    assert wide["Safe"] == (2, 0, 1, 3)
    assert tuple(risk(grid).first()) == (50.0, 25.0)


def test_areas_against_pairs(scored):
    def area(i, j):
        a = [r for r in ROWS if r[0] == i]
        b = [r for r in ROWS if r[0] == j]
        at = QUALITY_LEVELS.index(i) + 2
        return sum((x[at] > y[at]) + 0.5 * (x[at] == y[at]) for x in a for y in b) / (len(a) * len(b))

    pairs = [(i, j) for i in QUALITY_LEVELS for j in QUALITY_LEVELS if i != j]
    want = sum(area(i, j) for i, j in pairs) / len(pairs)
    assert roc_auc(scored, "quality", SCORES).first()["estimate"] == pytest.approx(want)


def test_curve_ends(scored):
    plain = sorted(tuple(r) for r in roc_curve(scored, "quality", SCORES).collect())
    ends = {(r[0], r[1]): r[2:] for r in plain if math.isinf(r[1])}
    assert len(ends) == 6 and ends[("Safe", -math.inf)] == (1.0, 0.0) and ends[("Safe", math.inf)] == (0.0, 1.0)


def test_metrics(scored):
    got = {r["metric"]: r["estimate"] for r in metrics(scored, "quality", "pred", SCORES).collect()}
    assert got["accuracy"] == 0.5
    chance = (3 * 4 + 1 * 0 + 2 * 2) / 36
    assert got["kap"] == pytest.approx((0.5 - chance) / (1 - chance))
    assert got["mn_log_loss"] == pytest.approx(-sum(math.log(r[QUALITY_LEVELS.index(r[0]) + 2]) for r in ROWS) / 6)


def test_split_is_exact_per_stratum_and_repeatable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("s"))
    once = split_stratified(df, "s", 0.75, "id", 1)
    counts = {(r["s"], r["split"]): r["count"] for r in once.groupBy("s", "split").count().collect()}
    assert counts == {("rare", "train"): 75, ("rare", "test"): 25, ("common", "train"): 675, ("common", "test"): 225}
    again = split_stratified(df.repartition(7), "s", 0.75, "id", 1)
    assert sorted(once.collect()) == sorted(again.collect())


def test_folds_are_even(spark):
    df = spark.range(103).withColumn("v", F.col("id").cast("double"))
    sizes = [r["count"] for r in fold_column(df, 5, "id", 9).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]
    strata = fold_column(df, 5, "id", 9, strata="v", breaks=4).groupBy("fold").count().collect()
    assert sum(r["count"] for r in strata) == 103 and len(strata) == 5


def test_regression_per_group(spark):
    rows = [("exact", float(x), 2.0 * x + 1) for x in range(10)]
    rows += [("noisy", float(x), 3.0 * x + (1 if x % 2 else -1)) for x in range(20)]
    rows += [("flat", 1.0, float(x)) for x in range(5)] + [("tiny", 1.0, 1.0)]
    out = {r["g"]: r for r in ols_by(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "y", ["x"]).collect()}
    assert out["exact"]["b_x"] == pytest.approx(2) and out["exact"]["intercept"] == pytest.approx(1) and out["exact"]["r_squared"] == pytest.approx(1)
    assert out["noisy"]["nobs"] == 20 and 0.99 < out["noisy"]["r_squared"] < 1 and out["noisy"]["p_value"] < 1e-10
    assert out["flat"]["r_squared"] is None and out["tiny"]["r_squared"] is None


def test_f_tail_against_known_values():
    # F(1, d2) is the square of t(d2): P(|t| > 2.2281) = 0.05 at 10 degrees of freedom
    assert _f_tail(2.228138852 ** 2, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert _f_tail(3.3258345, 3, 9) < 0.08
    assert _f_tail(1.0, 5, 5) == pytest.approx(0.5)


def test_codes_follow_frequency_and_leave_a_place_for_the_unseen(spark):
    labels = [f"v{i}" for i in range(3000) for _ in range(1 + i % 4)] + [None] * 9
    df = spark.createDataFrame([(x, "extra") for x in labels], "label string, _code string")
    order = sorted({x for x in labels if x}, key=lambda x: (-labels.count(x), x))
    codes = category_codes(df, "label")
    assert {r.label: r.code for r in codes.collect()} == {x: k for k, x in enumerate(order)}
    new = spark.createDataFrame([("v3", "a"), ("never", "b"), (None, "c"), ("v3", "a")], "label string, _label string")
    got = with_codes(new, codes, "label", "code")
    assert got.columns == ["label", "_label", "code"]
    assert sorted((r._label, r.code) for r in got.collect()) == [("a", order.index("v3"))] * 2 + [("b", 3000), ("c", 3000)]
    none = category_codes(df.limit(0), "label")
    assert [r.code for r in with_codes(new.limit(1), none, "label", "code").collect()] == [0]


def test_million_labels_are_not_collected(spark):
    df = spark.range(1_000_000).select(F.concat(F.lit("k"), "id").alias("label")).union(spark.createDataFrame([("k77",)], "label string"))
    codes = category_codes(df, "label")
    most = codes.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert codes.filter("label = 'k77'").first().code == 0 and most < 500_000
    assert codes.agg(F.countDistinct("code"), F.max("code")).first()[:] == (1_000_000, 999_999)


def test_regression_errors(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 9.0), ("a", 5.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 3.0), ("c", None, 1.0)]
    got = {r.g: r for r in regression_errors(spark.createDataFrame(rows, "g string, t double, e double"), "t", "e", ["g"]).collect()}
    assert got["a"].n == 3 and got["a"].rmse == pytest.approx((5 / 3) ** 0.5) and got["a"].mae == pytest.approx(1) and got["a"].bias == pytest.approx(-1 / 3)
    assert got["a"].rsq == pytest.approx(0.75) and got["b"].rsq is None and got["b"].rmse == pytest.approx(2**0.5)
    assert got["c"].n == 0 and got["c"].rmse is None
