"""ML1–ML20: splits, models and their evaluation."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, shown, table
from envspark.functions.measures import ENTEROCOCCI_BREAKS, QUALITY_LEVELS, cut, season_index
from envspark.models import (
    augment,
    category_codes,
    confusion,
    confusion_wide,
    fold_column,
    importance,
    label_index,
    latin_hypercube,
    metrics,
    node_stats,
    ols,
    ols_by,
    regression_errors,
    residuals,
    rf_regressor,
    risk,
    roc_auc,
    roc_curve,
    sequence,
    split_stratified,
    tree_regressor,
    tune_points,
    tune_tree,
    with_codes,
)
from envspark.plans.modelling import best_group_models, compare_feature_sets, confusion_of, evaluate, score_columns, train_classifier, tune_classifier

SCORES = {l: f".pred_{l}" for l in QUALITY_LEVELS}
LONG = """s AS (SELECT quality AS truth, 'Safe' AS level, p_safe AS score FROM scored UNION ALL SELECT quality, 'Caution', p_caution FROM scored UNION ALL SELECT quality, 'Unsafe', p_unsafe FROM scored)"""
# (i, j) areas: a class-i row outscores a class-j row on i's score; ties count half
AREAS = f"""{LONG}, c AS (SELECT level, score, truth, count(*) AS n FROM s GROUP BY 1, 2, 3),
  a AS (SELECT p.level AS i, q.truth AS j, sum(p.n * (coalesce(q.n, 0) * CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0.0 END)) AS u, 0 AS z
        FROM (SELECT * FROM c WHERE truth = level) p JOIN c q ON q.level = p.level AND q.truth <> p.level GROUP BY 1, 2),
  n AS (SELECT quality, count(*) AS n FROM scored GROUP BY 1),
  areas AS (SELECT i, j, u / (ni.n::DOUBLE * nj.n) AS area, ni.n AS n_i, nj.n AS n_j FROM a JOIN n ni ON ni.quality = i JOIN n nj ON nj.quality = j)"""


@query(
    "ml1_stratified_split",
    f"""WITH s AS (SELECT event_id, {d.CLASS.format("value")} AS quality FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(event_id || '|123'), event_id) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM s)
    SELECT event_id, quality, CASE WHEN rk <= floor(n * 0.75::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM k""",
)
def _(spark, sf):
    s = table(spark, sf, "events").select("event_id", cut("value", ENTEROCOCCI_BREAKS, QUALITY_LEVELS).alias("quality"))
    return split_stratified(s, "quality", 0.75, "event_id", 123)


@query(
    "ml2_folds",
    "SELECT event_id, (row_number() OVER (ORDER BY md5(event_id || '|234'), event_id) - 1) % 10 AS fold FROM events",
)
def _(spark, sf):
    return shown(fold_column(table(spark, sf, "events").select("event_id"), 10, "event_id", 234))


@query(
    "ml2_stratified_folds",
    """WITH q AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS c FROM events),
    s AS (SELECT event_id, CASE WHEN value > c[3] THEN 3 WHEN value > c[2] THEN 2 WHEN value > c[1] THEN 1 ELSE 0 END AS st FROM events, q)
    SELECT event_id, (row_number() OVER (PARTITION BY st ORDER BY md5(event_id || '|7'), event_id) - 1) % 5 AS fold FROM s""",
)
def _(spark, sf):
    return shown(fold_column(table(spark, sf, "events").select("event_id", "value"), 5, "event_id", 7, strata="value", breaks=4).drop("value"))


@query(
    "ml3_normalised",
    """SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z_quantity,
      round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6) AS z_price FROM lineitem""",
)
def _(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from envspark.models.estimators import _feature_stages

    l = table(spark, sf, "lineitem")
    z = vector_to_array("features")
    scaled = Pipeline(stages=_feature_stages(["l_quantity", "l_extendedprice"], [])).fit(l).transform(l)
    return shown(scaled.select("l_orderkey", "l_partkey", "l_linenumber", z[0].alias("z_quantity"), z[1].alias("z_price")))


@query(
    "ml4_category_codes",
    "SELECT event_id, (SELECT count(*) FROM (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1) WHERE n > m.n OR (n = m.n AND t < m.t)) ::DOUBLE AS code FROM events JOIN (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1) m ON m.t = event_type",
)
def _(spark, sf):
    from pyspark.ml import Pipeline

    from envspark.models.estimators import _feature_stages

    e = table(spark, sf, "events").select("event_id", "event_type")
    coded = Pipeline(stages=_feature_stages([], ["event_type"])[:1]).fit(e).transform(e)
    return coded.select("event_id", F.col("event_type_ix").alias("code"))


@query(
    "ml4_codes_joined",
    """WITH c AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS code FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))
    SELECT c_custkey, coalesce(code, (SELECT count(*) FROM c)) AS code FROM customer LEFT JOIN c ON c_custkey = o_custkey""",
)
def _(spark, sf):
    codes = category_codes(table(spark, sf, "orders"), "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return shown(with_codes(table(spark, sf, "customer").select("c_custkey"), codes, "c_custkey", "code"))


@query("ml9_confusion", f"""WITH {d.SCORED}, l AS (SELECT unnest(['Safe', 'Caution', 'Unsafe']) AS level),
    g AS (SELECT t.level AS truth, p.level AS prediction, count(s.event_id) AS n FROM l t CROSS JOIN l p LEFT JOIN scored s ON s.quality = t.level AND s.pred = p.level GROUP BY 1, 2)
    SELECT truth, prediction, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS prop FROM g""")
def _(spark, sf):
    return shown(confusion(d.scored(spark, sf), "quality", ".pred_class", QUALITY_LEVELS))


@query("ml9_confusion_wide", f"""WITH {d.SCORED} SELECT pred AS prediction, count(*) FILTER (quality = 'Safe') AS "Safe", count(*) FILTER (quality = 'Caution') AS "Caution", count(*) FILTER (quality = 'Unsafe') AS "Unsafe", count(*) AS "Total" FROM scored GROUP BY 1""")
def _(spark, sf):
    grid = confusion(d.scored(spark, sf), "quality", ".pred_class", QUALITY_LEVELS, share_by="prediction")
    return confusion_wide(grid, QUALITY_LEVELS, rows="prediction")


@query(
    "ml10_roc_curve",
    f"""WITH {d.SCORED}, {LONG}, c AS (SELECT level, score, count(*) FILTER (truth = level) AS pos, count(*) FILTER (truth <> level) AS neg FROM s GROUP BY 1, 2)
    SELECT level, round(score, 9) AS threshold, round(sum(pos) OVER w / sum(pos) OVER a, 6) AS sensitivity, round(1 - sum(neg) OVER w / sum(neg) OVER a, 6) AS specificity FROM c
    WINDOW w AS (PARTITION BY level ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY level)
    UNION ALL SELECT level, t, s, 1 - s FROM (VALUES ('Safe'), ('Caution'), ('Unsafe')) l(level), (VALUES ('-Infinity'::DOUBLE, 1.0::DOUBLE), ('Infinity'::DOUBLE, 0.0::DOUBLE)) e(t, s)""",
)
def _(spark, sf):
    curve = roc_curve(d.scored(spark, sf), "quality", SCORES)
    finite = F.abs("threshold") < F.lit(float("inf"))
    return curve.select("level", F.when(finite, F.round("threshold", 9)).otherwise(F.col("threshold")).alias("threshold"), F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"))


@query("ml11_auc_hand_till", f"WITH {d.SCORED}, {AREAS} SELECT 'roc_auc' AS metric, 'hand_till' AS estimator, round(avg(area), 6) AS estimate FROM areas")
def _(spark, sf):
    return shown(roc_auc(d.scored(spark, sf), "quality", SCORES))


@query(
    "ml11_auc_weighted",
    f"WITH {d.SCORED}, {AREAS}, o AS (SELECT i, any_value(n_i) AS n, sum(area * n_j) / sum(n_j) AS area FROM areas GROUP BY 1) SELECT 'roc_auc' AS metric, 'macro_weighted' AS estimator, round(sum(area * n) / sum(n), 6) AS estimate FROM o",
)
def _(spark, sf):
    return shown(roc_auc(d.scored(spark, sf), "quality", SCORES, "macro_weighted"))


@query(
    "ml12_metrics",
    f"""WITH {d.SCORED}, {AREAS}, m AS (SELECT avg((quality = pred)::INT) AS acc, count(*)::DOUBLE AS n,
      count(*) FILTER (quality = 'Safe')::DOUBLE * count(*) FILTER (pred = 'Safe') + count(*) FILTER (quality = 'Caution')::DOUBLE * count(*) FILTER (pred = 'Caution') + count(*) FILTER (quality = 'Unsafe')::DOUBLE * count(*) FILTER (pred = 'Unsafe') AS pe,
      avg(-ln(greatest(CASE quality WHEN 'Safe' THEN p_safe WHEN 'Caution' THEN p_caution ELSE p_unsafe END, 2.220446049250313e-16))) AS loss FROM scored)
    SELECT 'accuracy' AS metric, 'multiclass' AS estimator, round(acc, 6) AS estimate FROM m
    UNION ALL SELECT 'kap', 'multiclass', round((acc - pe / n / n) / (1 - pe / n / n), 6) FROM m
    UNION ALL SELECT 'mn_log_loss', 'multiclass', round(loss, 6) FROM m
    UNION ALL SELECT 'roc_auc', 'hand_till', round(avg(area), 6) FROM areas""",
)
def _(spark, sf):
    return shown(metrics(d.scored(spark, sf), "quality", ".pred_class", SCORES))


@query("ml15_risk", f"""WITH {d.SCORED} SELECT round(100.0 * count(*) FILTER (quality = 'Safe') / count(*)) AS safe_risk, round(100.0 * count(*) FILTER (quality = 'Unsafe') / count(*)) AS unsafe_risk FROM scored WHERE pred = 'Safe'""")
def _(spark, sf):
    return risk(confusion(d.scored(spark, sf), "quality", ".pred_class", QUALITY_LEVELS, share_by="prediction"))


@query(
    "ml16_linear_model",
    """SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 3) AS estimate, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared, count(*) AS nobs FROM lineitem
    UNION ALL SELECT '(Intercept)', round(regr_intercept(l_extendedprice, l_quantity), 3), round(regr_r2(l_extendedprice, l_quantity), 6), count(*) FROM lineitem""",
)
def _(spark, sf):
    coefficients, glance, _ = ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    fit = glance.first()  # one row of fit statistics
    return coefficients.select("term", F.round("estimate", 3).alias("estimate"), F.round(F.lit(fit["r_squared"]), 6).alias("r_squared"), F.lit(fit["nobs"]).alias("nobs"))


TWO = """m AS (SELECT l_suppkey, count(*) AS n, var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
  var_pop(l_extendedprice) AS y, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
  f AS (SELECT *, (p * b - q * c) / (a * b - c * c) AS b1, (q * a - p * c) / (a * b - c * c) AS b2 FROM m),
  g AS (SELECT *, (b1 * p + b2 * q) / y AS r2 FROM f)"""


@query(
    "ml17_model_per_group",
    f"""WITH {TWO} SELECT l_suppkey, n AS nobs, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r_squared, round(sqrt(n * y * (1 - r2) / (n - 3)), 3) AS sigma,
      round((r2 / 2) / ((1 - r2) / (n - 3)), 3) AS statistic, round(-2 * (-0.5 * n * (ln(2 * pi()) + ln(n * y * (1 - r2) / n) + 1)) + 8, 3) AS aic,
      round(b1, 3) AS b_l_quantity, round(b2, 3) AS b_l_discount, round(my - b1 * mx - b2 * mz, 3) AS intercept FROM g""",
)
def _(spark, sf):
    out = ols_by(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_quantity", "l_discount"])
    three = ["sigma", "statistic", "aic", "b_l_quantity", "b_l_discount", "intercept"]
    return out.select("l_suppkey", "nobs", F.round("r_squared", 6).alias("r_squared"), F.round("adj_r_squared", 6).alias("adj_r_squared"), *[F.round(c, 3).alias(c) for c in three])


@query(
    "ml17_likelihoods",
    """WITH m AS (SELECT l_suppkey, count(*) AS n, var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS c, covar_pop(l_quantity, l_tax) AS p, covar_pop(l_discount, l_tax) AS q, var_pop(l_tax) AS y FROM lineitem GROUP BY 1),
    g AS (SELECT *, (p * (p * b - q * c) + q * (q * a - p * c)) / (a * b - c * c) / y AS r2 FROM m),
    l AS (SELECT *, -0.5 * n * (ln(2 * pi()) + ln(y * (1 - r2)) + 1) AS ll FROM g)
    SELECT l_suppkey, n AS nobs, round(power(1 - r2, (n - 3) / 2.0), 6) AS p_value, round(ll, 4) AS log_lik, round(-2 * ll + 4 * ln(n), 4) AS bic FROM l""",
)
def _(spark, sf):
    out = ols_by(table(spark, sf, "lineitem"), ["l_suppkey"], "l_tax", ["l_quantity", "l_discount"])
    return out.select("l_suppkey", "nobs", F.round("p_value", 6).alias("p_value"), F.round("log_lik", 4).alias("log_lik"), F.round("bic", 4).alias("bic"))


@query(
    "ml20_fit_errors",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
    p AS (SELECT l_returnflag, l_extendedprice AS y, a + b * l_quantity AS e FROM lineitem, f)
    SELECT l_returnflag, count(*) AS n, round(sqrt(avg((e - y) * (e - y))), 2) AS rmse, round(avg(abs(e - y)), 2) AS mae, round(avg(e - y), 2) AS bias, round(corr(y, e) * corr(y, e), 6) AS rsq FROM p GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    fit = ols(rows, "l_extendedprice", ["l_quantity"])[2]
    found = regression_errors(residuals(fit, rows, "l_extendedprice", "fitted"), "l_extendedprice", "fitted", ["l_returnflag"])
    return found.select("l_returnflag", "n", *[F.round(c, 2).alias(c) for c in ("rmse", "mae", "bias")], F.round("rsq", 6).alias("rsq"))


@query("ml17_best_group", f"WITH {TWO} SELECT l_suppkey, n AS nobs, round(r2, 6) AS r_squared, CAST(round(r2, 9) = max(round(r2, 9)) OVER () AS VARCHAR) AS best FROM g WHERE n > 100 AND r2 < 1")
def _(spark, sf):
    best = best_group_models(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_quantity", "l_discount"])
    return shown(best.select("l_suppkey", "nobs", "r_squared", "best"))


# --- fitted models: their trees depend on the engine, so only rows are checked ------------------------------


def _samples(spark, sf):
    """Events as model rows: class from the value, predictors from time, user and the JSON field."""
    hour = F.hour("ts") + F.minute("ts") / 60
    return table(spark, sf, "events").select(
        "event_id",
        "value",
        cut("value", ENTEROCOCCI_BREAKS, QUALITY_LEVELS).alias("quality"),
        hour.alias("hours"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        season_index("ts").cast("double").alias("season"),
        F.dayofmonth("ts").cast("double").alias("day"),
        "event_type",
    )


NUMERIC, CATEGORICAL = ["hours", "k", "day"], ["event_type"]
SMALL = dict(trees=10, depth=5)


@query("ml5_forest_classes")
def _(spark, sf):
    model, _, test = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    return confusion_of(model, test, "quality", QUALITY_LEVELS)


@query("ml6_forest_regression")
def _(spark, sf):
    rows = _samples(spark, sf)
    model = rf_regressor("value", NUMERIC, CATEGORICAL, **SMALL).fit(rows)
    return residuals(model, rows, "value").select("event_id", "prediction", "residual")


#: Cost per leaf as a share of the root's risk, and depth: five levels each, even in the exponent and in the depth.
COSTS, DEPTHS = [10.0 ** (-10 + 2.25 * k) for k in range(5)], [1, 4, 8, 11, 15]


@query("ml7_tree_regression")
def _(spark, sf):
    """Every depth with every cost over five folds, even in four strata of the outcome."""
    rows = fold_column(_samples(spark, sf), 5, "event_id", 1, strata="value", breaks=4)
    return tune_tree(tree_regressor("value", NUMERIC, CATEGORICAL, min_gain=0.0), rows, DEPTHS, COSTS, parallelism=8)


def _cuts(name, rows):
    """CTEs: the cut of ``rows`` (x, y) that leaves the smallest squared error, with at least 20 rows on either side."""
    return f"""{name}_g AS (SELECT x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM {rows} GROUP BY x),
    {name}_c AS (SELECT x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER () AS n, sum(s) OVER () AS s, sum(q) OVER () AS q FROM {name}_g WINDOW w AS (ORDER BY x)),
    {name} AS (SELECT x AS cut, lq - ls * ls / ln + (q - lq) - (s - ls) * (s - ls) / (n - ln) AS risk FROM {name}_c WHERE ln >= 20 AND n - ln >= 20 ORDER BY 2, 1 LIMIT 1)"""


@query(
    "ml7_pruning_sequence",
    f"""WITH r AS (SELECT day(ts) AS x, value AS y FROM events),
    {_cuts("a", "r")}, l AS (SELECT r.* FROM r, a WHERE x <= cut), h AS (SELECT r.* FROM r, a WHERE x > cut),
    {_cuts("b", "l")}, {_cuts("c", "h")},
    risk AS (SELECT (SELECT sum(y * y) - sum(y) * sum(y) / count(*) FROM r) AS r0, (SELECT sum(y * y) - sum(y) * sum(y) / count(*) FROM l) AS rl,
      (SELECT sum(y * y) - sum(y) * sum(y) / count(*) FROM h) AS rh, (SELECT risk FROM b) AS cl, (SELECT risk FROM c) AS ch),
    g AS (SELECT r0, rl, rh, coalesce(cl, rl) AS bl, coalesce(ch, rh) AS bh, CASE WHEN cl IS NULL THEN 1 ELSE 2 END AS kl, CASE WHEN ch IS NULL THEN 1 ELSE 2 END AS kh,
      coalesce(rl - cl, 'infinity'::DOUBLE) AS gl, coalesce(rh - ch, 'infinity'::DOUBLE) AS gh FROM risk),
    one AS (SELECT *, (r0 - bl - bh) / (kl + kh - 1) AS g0 FROM g),
    two AS (SELECT *, g0 <= least(gl, gh) AS whole, CASE WHEN gl < gh THEN (r0 - rl - bh) / kh ELSE (r0 - bl - rh) / kl END AS root2, greatest(gl, gh) AS other FROM one),
    steps AS (SELECT least(g0, gl, gh) AS alpha, CASE WHEN whole THEN 1 WHEN gl < gh THEN 1 + kh ELSE kl + 1 END AS leaves, CASE WHEN whole THEN r0 WHEN gl < gh THEN rl + bh ELSE bl + rh END AS risk FROM two
      UNION ALL SELECT least(root2, other), CASE WHEN root2 <= other THEN 1 ELSE 2 END, CASE WHEN root2 <= other THEN r0 ELSE rl + rh END FROM two WHERE NOT whole
      UNION ALL SELECT r0 - rl - rh, 1, r0 FROM two WHERE NOT whole AND root2 > other)
    SELECT round(alpha, 3) AS alpha, leaves, round(risk, 2) AS risk FROM steps""",
)
def _(spark, sf):
    """The nested trees of a tree of two cuts, each cut and each weakest link found by SQL as well."""
    rows = table(spark, sf, "events").select(F.dayofmonth("ts").cast("double").alias("day"), "value")
    steps = sequence(tree_regressor("value", ["day"], depth=2, min_gain=0.0).fit(rows))
    out = spark.createDataFrame(steps, "alpha double, leaves int, risk double")
    return out.select(F.round("alpha", 3).alias("alpha"), "leaves", F.round("risk", 2).alias("risk"))


@query("ml8_tuned_forest")
def _(spark, sf):
    """Twenty points over predictors per split and rows per node, ten folds."""
    from envspark.models import rf_classifier
    from envspark.plans.modelling import forest_ranges

    rows = label_index(_samples(spark, sf), "quality", QUALITY_LEVELS)
    points = latin_hypercube(forest_ranges(len(NUMERIC) + len(CATEGORICAL)), 20, seed=345)
    _, candidates = tune_classifier(rows, "quality", QUALITY_LEVELS, rf_classifier(NUMERIC, CATEGORICAL, **SMALL), points, "event_id", folds=10, parallelism=8)
    return candidates


TEN_FOLDS = "r AS (SELECT event_id, day(ts) AS x, value AS y, (row_number() OVER (ORDER BY md5(event_id || '|234'), event_id) - 1) % 10 AS fold FROM events)"


@query("ml8_fold_keys", f"WITH {TEN_FOLDS} SELECT event_id, fold FROM r")
def _(spark, sf):
    return fold_column(table(spark, sf, "events").select("event_id"), 10, "event_id", 234).select("event_id", F.col("fold").cast("long").alias("fold"))


@query(
    "ml8_tuned_stump",
    f"""WITH {TEN_FOLDS}, t AS (SELECT f, x, y FROM r, range(10) k(f) WHERE fold <> f),
    g AS (SELECT f, x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM t GROUP BY f, x),
    c AS (SELECT f, x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER a AS n, sum(s) OVER a AS s, sum(q) OVER a AS q FROM g WINDOW w AS (PARTITION BY f ORDER BY x), a AS (PARTITION BY f)),
    p AS (SELECT f, arg_min(x, -ls * ls / ln - (s - ls) * (s - ls) / (n - ln)) AS cut, arg_min(ls / ln, -ls * ls / ln - (s - ls) * (s - ls) / (n - ln)) AS lo, arg_min((s - ls) / (n - ln), -ls * ls / ln - (s - ls) * (s - ls) / (n - ln)) AS hi
      FROM c WHERE ln >= 20 AND n - ln >= 20 GROUP BY f),
    e AS (SELECT f, sqrt(avg(pow(y - CASE WHEN x <= cut THEN lo ELSE hi END, 2))) AS rmse FROM r JOIN p ON p.f = r.fold GROUP BY f)
    SELECT 'maxDepth' AS parameter, '1' AS value, round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS std FROM e""",
)
def _(spark, sf):
    """The cross-validated error of a tree of one cut, whose cuts, folds and error SQL finds as well."""
    rows = table(spark, sf, "events").select("event_id", F.dayofmonth("ts").cast("double").alias("day"), "value")
    points = [{"maxDepth": 1}, {"maxDepth": 2}]
    _, found = tune_points(tree_regressor("value", ["day"], min_gain=0.0), fold_column(rows, 10, "event_id", 234), points, RegressionEvaluator(labelCol="value", metricName="rmse"), parallelism=8)
    return found.filter("candidate = 0").select("parameter", "value", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("ml13_importance")
def _(spark, sf):
    model, _, _ = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    return importance(model, NUMERIC, CATEGORICAL).limit(10)  # top-ten report


@query("ml14_scored_rows")
def _(spark, sf):
    model, _, test = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    scored = augment(model, test, QUALITY_LEVELS)
    return scored.select("event_id", "quality", *[F.col(f"`{c}`") for c in (".pred_class", *score_columns(QUALITY_LEVELS).values())])


@query("ml18_feature_sets")
def _(spark, sf):
    sets = {"time only": (["hours", "day"], []), "all": (NUMERIC, CATEGORICAL)}
    return compare_feature_sets(_samples(spark, sf), "quality", QUALITY_LEVELS, sets, "event_id", level="Unsafe", **SMALL)


@query("ml19_in_and_out_of_sample")
def _(spark, sf):
    model, train, test = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    return evaluate(model, {"train": train, "test": test}, "quality", QUALITY_LEVELS)


@query("ml20_fit_check")
def _(spark, sf):
    rows = _samples(spark, sf)
    model = tree_regressor("value", NUMERIC, CATEGORICAL, depth=4, min_gain=0.0).fit(rows)
    return node_stats(model, rows, "value")


# --- what holds of any fitted model, exactly ------------------------------------------------------------------


TEST_PART = f"""s AS (SELECT event_id, {d.CLASS.format("value")} AS quality FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(event_id || '|123'), event_id) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM s WHERE quality IS NOT NULL),
  test AS (SELECT event_id, quality FROM k WHERE rk > floor(n * 0.75::DOUBLE))"""


@query("ml5_truth_totals", f"WITH {TEST_PART} SELECT quality AS truth, count(*) AS n, 1.0::DOUBLE AS share FROM test GROUP BY 1")
def _(spark, sf):
    model, _, test = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    grid = confusion_of(model, test, "quality", QUALITY_LEVELS)
    return grid.groupBy("truth").agg(F.sum("n").alias("n"), F.round(F.sum("prop"), 6).alias("share")).filter("n > 0")


@query("ml6_prediction_and_residual", "SELECT event_id, round(value, 6) AS total FROM events")
def _(spark, sf):
    rows = _samples(spark, sf)
    model = rf_regressor("value", NUMERIC, CATEGORICAL, **SMALL).fit(rows)
    return residuals(model, rows, "value").select("event_id", F.round(F.col("prediction") + F.col("residual"), 6).alias("total"))


@query(
    "ml8_candidate_points",
    """SELECT 'featureSubsetStrategy' AS parameter, v AS value, 2::BIGINT AS n, 1::BIGINT AS best_points FROM (VALUES ('1'), ('3')) t(v)
    UNION ALL SELECT 'minInstancesPerNode', v, 2, 1 FROM (VALUES ('2'), ('20')) t(v)""",
)
def _(spark, sf):
    from envspark.models import rf_classifier

    rows = label_index(_samples(spark, sf), "quality", QUALITY_LEVELS)
    forest = rf_classifier(NUMERIC, CATEGORICAL, **SMALL)
    _, points = tune_classifier(rows, "quality", QUALITY_LEVELS, forest, {"featureSubsetStrategy": ["1", "3"], "minInstancesPerNode": [2, 20]}, "event_id", folds=2)
    best = points.filter("best").select("candidate").distinct().agg(F.count(F.lit(1))).scalar()
    return points.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("best_points", best)


@query("ml13_importance_total", "SELECT 4::BIGINT AS variables, 1.0::DOUBLE AS total")
def _(spark, sf):
    model, _, _ = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    return importance(model, NUMERIC, CATEGORICAL).agg(F.count(F.lit(1)).alias("variables"), F.round(F.sum("importance"), 6).alias("total"))


@query("ml14_score_totals", f"WITH {TEST_PART} SELECT event_id, quality, 1.0::DOUBLE AS total, 'true' AS is_largest FROM test")
def _(spark, sf):
    model, _, test = train_classifier(_samples(spark, sf), "quality", QUALITY_LEVELS, NUMERIC, CATEGORICAL, "event_id", **SMALL)
    scored = augment(model, test, QUALITY_LEVELS)
    p = [F.col(f"`{c}`") for c in score_columns(QUALITY_LEVELS).values()]
    own = F.element_at(F.array(*p), F.array_position(F.array(*[F.lit(x) for x in QUALITY_LEVELS]), F.col("`.pred_class`")).cast("int"))
    return scored.select("event_id", "quality", F.round(p[0] + p[1] + p[2], 6).alias("total"), (own == F.greatest(*p)).cast("string").alias("is_largest"))


@query("ml20_leaf_moments", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events")
def _(spark, sf):
    rows = _samples(spark, sf)
    leaves = node_stats(tree_regressor("value", NUMERIC, CATEGORICAL, depth=4, min_gain=0.0).fit(rows), rows, "value")
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    square = F.sum(F.col("n") * (F.col("variance") + F.col("mean") * F.col("mean"))) / n
    return leaves.agg(n.alias("n"), F.round(mean, 6).alias("mean"), F.round(square - mean * mean, 4).alias("variance"))


@query(
    "ml20_fit_rows",
    "SELECT event_id, round(value, 6) AS actual, 'true' AS within_range FROM events",
)
def _(spark, sf):
    """Predicted next to actual, a regression tree's predictions lying between the smallest and the largest outcome."""
    rows = _samples(spark, sf)
    fitted = residuals(tree_regressor("value", NUMERIC, CATEGORICAL, depth=4, min_gain=0.0).fit(rows), rows, "value")
    ends = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    return shown(fitted.select("event_id", F.col("value").alias("actual"), F.col("prediction").between(lo - 1e-9, hi + 1e-9).alias("within_range")))


@query(
    "ml16_log_level_two_predictors",
    """WITH w AS (SELECT ln(l_extendedprice + 1) AS y, l_quantity AS a, l_discount AS b FROM lineitem WHERE l_tax >= 0.02),
    m AS (SELECT count(*)::DOUBLE AS n, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, var_pop(y) AS yy, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM w),
    f AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS b2 FROM m),
    g AS (SELECT *, (b1 * ay + b2 * yb) / yy AS r2, n * (yy - b1 * ay - b2 * yb) / (n - 3) AS s2 FROM f),
    t AS (SELECT 'l_quantity' AS term, b1 AS estimate, sqrt(s2 * bb / (n * det)) AS std_error, * FROM g
      UNION ALL SELECT 'l_discount', b2, sqrt(s2 * aa / (n * det)), * FROM g
      UNION ALL SELECT '(Intercept)', my - b1 * ma - b2 * mb, sqrt(s2 / n * (1 + (ma * ma * bb + mb * mb * aa - 2 * ma * mb * ab) / det)), * FROM g)
    SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(estimate / std_error, 2) AS statistic,
      round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r_squared, n::BIGINT AS nobs FROM t""",
)
def _(spark, sf):
    from envspark.plans.modelling import log_level

    warm = log_level(table(spark, sf, "lineitem"), "l_extendedprice", "y", warm=F.col("l_tax") >= 0.02)
    coefficients, glance, _ = ols(warm, "y", ["l_quantity", "l_discount"])
    fit = glance.first()  # one row of fit statistics
    six = [F.round(c, 6).alias(c) for c in ("estimate", "std_error")]
    return coefficients.select(
        "term", *six, F.round("statistic", 2).alias("statistic"),
        F.round(F.lit(fit["r_squared"]), 6).alias("r_squared"), F.round(F.lit(fit["adj_r_squared"]), 6).alias("adj_r_squared"), F.lit(fit["nobs"]).alias("nobs"),
    )
