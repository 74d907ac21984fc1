"""One linear model per group from moment aggregates.

The rows of a group are only ever summed: means and covariances come from
partial aggregates, and what reaches Python is one small row per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import exp, lgamma, log, log1p, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STATS = ["r_squared", "adj_r_squared", "sigma", "statistic", "p_value", "log_lik", "aic", "bic"]


def _f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution through the continued fraction of the incomplete beta function."""
    if not f > 0 or d2 <= 0:
        return float("nan")
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(1 - x, b, a)
    return _beta_part(x, a, b)


def _beta_part(x: float, a: float, b: float) -> float:
    front = exp(a * log(x) + b * log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def ols_by(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per group: ``nobs``, fit statistics, ``intercept`` and one slope ``b_<x>`` per predictor.

    Rows with a NULL among the model columns are left out. A group with too few
    rows or collinear predictors gets NULL statistics.
    """
    by, xs = list(by), list(xs)
    cols = [*xs, y]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    moments = (
        df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
        .dropna(subset=cols)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("nobs"),
            *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
            *[F.covar_pop(cols[i], cols[j]).alias(f"_c{i}_{j}") for i, j in pairs],
        )
    )
    names = [*_STATS, "intercept", *[f"b_{x}" for x in xs]]
    schema = T.StructType([moments.schema[c] for c in by] + [T.StructField("nobs", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in names])
    p = len(xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cov = np.empty((len(pdf), p + 1, p + 1))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = pdf[f"_c{i}_{j}"]
            mean = pdf[[f"_m{i}" for i in range(p + 1)]].to_numpy(float)
            n = pdf["nobs"].to_numpy(float)
            out = np.full((len(pdf), len(names)), np.nan)
            for g in range(len(pdf)):
                a, b, syy = cov[g, :p, :p], cov[g, :p, p], cov[g, p, p]
                scale = np.sqrt(np.diag(a))
                left = n[g] - p - 1
                if left < 0 or syy <= 0 or (scale == 0).any() or np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-10) < p:
                    continue
                beta = np.linalg.solve(a / np.outer(scale, scale), b / scale) / scale
                r2 = float(beta @ b / syy)
                rss = max(n[g] * syy * (1 - r2), 0.0)
                stat = (r2 / p) / ((1 - r2) / left) if left > 0 and r2 < 1 else np.nan
                ll = -0.5 * n[g] * (log(2 * pi) + log(rss / n[g]) + 1) if rss > 0 else np.nan
                out[g] = [
                    r2,
                    1 - (1 - r2) * (n[g] - 1) / left if left > 0 else np.nan,
                    np.sqrt(rss / left) if left > 0 else np.nan,
                    stat,
                    _f_tail(stat, p, left) if stat == stat else np.nan,
                    ll,
                    -2 * ll + 2 * (p + 2),
                    -2 * ll + np.log(n[g]) * (p + 2),
                    mean[g, p] - mean[g, :p] @ beta,
                    *beta,
                ]
            frame = pd.DataFrame(out, columns=names).astype(object).where(~np.isnan(out), None)
            yield pd.concat([pdf[[*by, "nobs"]].reset_index(drop=True), frame], axis=1)

    return moments.mapInPandas(solve, schema)
