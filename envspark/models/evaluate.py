"""Confusion grids, ROC curves and metrics as DataFrames.

Scores are counted per value before anything is ordered, and running counts
along the score axis go through the bucketed running sum, because here a "key" is
a class: a handful of groups that hold all rows between them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.operators.slices import POS, running_sum
from envspark.operators.windows import share_within


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def confusion(df: DataFrame, truth: str, pred: str, levels: Sequence[str], share_by: str = "truth") -> DataFrame:
    """Complete truth × prediction grid with counts ``n`` (0 where none) and ``prop`` within truth or prediction."""
    axis = F.array(*[F.lit(l) for l in levels])
    grid = df.sparkSession.range(1).select(F.explode(axis).alias("truth")).withColumn("prediction", F.explode(axis))
    counts = df.groupBy(_q(truth).alias("truth"), _q(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(counts, ["truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return share_within(full, [share_by], "n", "prop")


def confusion_wide(grid: DataFrame, levels: Sequence[str], rows: str = "truth", value: str = "n") -> DataFrame:
    """The grid as a table with one column per level of the other axis and a ``Total``."""
    other = "prediction" if rows == "truth" else "truth"
    wide = grid.groupBy(rows).pivot(other, list(levels)).agg(F.first(value))
    return wide.withColumn("Total", reduce(lambda a, b: a + b, [_q(l) for l in levels]))


def risk(grid: DataFrame, predicted: str = "Safe", bad: str = "Unsafe") -> DataFrame:
    """Of the rows predicted ``predicted``: whole percentages that truly were so, and that truly were ``bad``."""
    row = grid.filter(F.col("prediction") == predicted)
    total = F.sum("n")
    pct = lambda level: F.round(F.try_divide(F.sum(F.when(F.col("truth") == level, F.col("n")).otherwise(0)), total) * 100)
    return row.agg(pct(predicted).alias("safe_risk"), pct(bad).alias("unsafe_risk"))


def _score_counts(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(level, score) rows with one count column ``c<i>`` per true class."""
    levels = list(scores)
    cells = F.array(*[F.struct(F.lit(l).alias("level"), _q(c).cast("double").alias(POS)) for l, c in scores.items()])
    # equal scores collapse before the shuffle, and truth is counted in columns rather than rows
    long = df.select(_q(truth).alias("_truth"), F.inline(cells))
    return long.groupBy("level", POS).agg(*[F.sum((F.col("_truth") == l).cast("long")).alias(f"c{i}") for i, l in enumerate(levels)])


def roc_curve(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-all curve per level: (level, threshold, sensitivity, specificity), with the -Inf and +Inf ends."""
    levels = list(scores)
    counts = _score_counts(df, truth, scores)
    own = reduce(lambda acc, il: acc.when(F.col("level") == il[1], F.col(f"c{il[0]}")), enumerate(levels), F)
    everyone = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(len(levels))])
    hits = counts.select("level", POS, own.alias("pos"), (everyone - own).alias("neg"))
    totals = hits.groupBy("level").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))  # one row per class
    above = running_sum(hits, ["level"], {"tp": "pos", "fp": "neg"}, descending=True)
    curve = above.join(F.broadcast(totals), "level").select(
        "level",
        F.col(POS).alias("threshold"),
        F.try_divide(F.col("tp"), F.col("_p")).alias("sensitivity"),
        (1 - F.try_divide(F.col("fp"), F.col("_n"))).alias("specificity"),
    )
    ends = df.sparkSession.createDataFrame(
        [(l, t, s, 1 - s) for l in levels for t, s in ((float("-inf"), 1.0), (float("inf"), 0.0))], curve.schema
    )
    return curve.unionByName(ends)


def _pair_areas(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(i, j, area, n_i, n_j): chance that a row of class i scores higher on i's score than a row of class j, ties half."""
    k = len(scores)
    counts = _score_counts(df, truth, scores)
    below = running_sum(counts, ["level"], {f"cum{i}": f"c{i}" for i in range(k)})
    sums = [F.sum(f"c{i}").alias(f"n{i}") for i in range(k)]
    for i in range(k):
        for j in range(k):
            if i != j:
                ahead = (F.col(f"cum{j}") - F.col(f"c{j}") / 2).cast("double")
                sums.append(F.sum(F.col(f"c{i}") * ahead).alias(f"u{i}_{j}"))
    per_level = below.groupBy("level").agg(*sums)
    cells = []
    for i, level in enumerate(scores):
        for j in range(k):
            if i != j:
                area = F.try_divide(F.col(f"u{i}_{j}"), F.col(f"n{i}").cast("double") * F.col(f"n{j}"))
                cells.append(
                    F.when(
                        F.col("level") == level,
                        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), area.alias("area"), F.col(f"n{i}").alias("n_i"), F.col(f"n{j}").alias("n_j")),
                    )
                )
    return per_level.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))


def roc_auc(df: DataFrame, truth: str, scores: dict[str, str], estimator: str = "hand_till") -> DataFrame:
    """One row (metric, estimator, estimate): multiclass AUC.

    ``hand_till`` averages the pairwise areas; ``macro`` and ``macro_weighted``
    average the one-vs-all areas, plainly or by class frequency.
    """
    areas = _pair_areas(df, truth, scores)
    if estimator == "hand_till":
        value = F.avg("area")
    else:
        one_vs_all = areas.groupBy("i").agg(
            F.first("n_i").alias("n"), F.try_divide(F.sum(F.col("area") * F.col("n_j")), F.sum("n_j")).alias("area")
        )
        areas = one_vs_all
        value = F.avg("area") if estimator == "macro" else F.try_divide(F.sum(F.col("area") * F.col("n")), F.sum("n"))
    return areas.agg(value.alias("estimate")).select(F.lit("roc_auc").alias("metric"), F.lit(estimator).alias("estimator"), "estimate")


def metrics(df: DataFrame, truth: str, pred: str, scores: dict[str, str]) -> DataFrame:
    """accuracy, kappa, mean log-loss and Hand-Till AUC as (metric, estimator, estimate) rows."""
    levels = list(scores)
    t, p = _q(truth), _q(pred)
    n = F.count(F.lit(1)).cast("double")
    chance = reduce(
        lambda a, b: a + b,
        [F.sum((t == l).cast("long")).cast("double") * F.sum((p == l).cast("long")) for l in levels],
    ) / (n * n)
    own = reduce(lambda acc, lc: acc.when(t == lc[0], _q(lc[1])), scores.items(), F)
    tiny = 2.220446049250313e-16
    loss = F.when(own.isNotNull(), -F.ln(F.least(F.greatest(own, F.lit(tiny)), F.lit(1 - tiny))))
    one = df.agg(F.avg((t == p).cast("double")).alias("acc"), chance.alias("chance"), F.avg(loss).alias("loss"))
    found = {
        "accuracy": F.col("acc"),
        "kap": F.try_divide(F.col("acc") - F.col("chance"), 1 - F.col("chance")),
        "mn_log_loss": F.col("loss"),
    }
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.lit("multiclass").alias("estimator"), v.alias("estimate")) for m, v in found.items()]
    )
    return one.select(F.inline(rows)).unionByName(roc_auc(df, truth, scores))


def regression_errors(df: DataFrame, truth: str, estimate: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n`` rows with both values, ``rmse``, ``mae``, ``bias`` (mean of estimate less truth) and ``rsq``, their squared correlation.

    One pass of partial sums. A group without a complete row has n 0 and NULL
    errors; a constant truth or estimate has NULL rsq.
    """
    t, e = _q(truth).cast("double"), _q(estimate).cast("double")
    known = t.isNotNull() & e.isNotNull()
    off, t, e = F.when(known, e - t), F.when(known, t), F.when(known, e)
    spread = F.var_pop(t) * F.var_pop(e)
    rsq = F.when(spread > 0, F.covar_pop(t, e) ** 2 / spread)
    return df.groupBy(*by).agg(F.count(off).alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("bias"), rsq.alias("rsq"))
