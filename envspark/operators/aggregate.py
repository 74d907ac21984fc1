"""Profiles, distributions and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark.operators.quantiles import group_median, group_quantiles
from envspark.operators.reshape import first_by
from envspark.operators.slices import join_on
from envspark.session import staged


def null_profile(df: DataFrame) -> DataFrame:
    """NULLs per column as rows, fewest first; one pass."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "variable", "num_missing").orderBy("num_missing", "variable")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns: n_missing, complete_rate, mean, sd and exact p0 / p25 / p50 / p75 / p100."""
    long = _long(df, cols)
    moments = long.groupBy("variable").agg(
        F.sum(F.col("value").isNull().cast("long")).alias("n_missing"),
        F.avg(F.col("value").isNotNull().cast("double")).alias("complete_rate"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    q = group_quantiles(long, ["variable"], "value", [0, 0.25, 0.5, 0.75, 1])
    named = [F.col("q")[i].alias(f"p{p}") for i, p in enumerate((0, 25, 50, 75, 100))]
    return moments.join(q.select("variable", *named), "variable")


def profile_text(df: DataFrame, cols: Sequence[str], top: int = 4) -> DataFrame:
    """Text columns: n_missing, complete_rate, n_unique and the most frequent values with their counts."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    summary = counts.groupBy("variable").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        (F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("complete_rate"),
        F.count("value").alias("n_unique"),
    )
    leaders = first_by(counts.filter(F.col("value").isNotNull()), ["variable"], [F.desc("n"), "value"], top)
    ranked = leaders.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "value"))).alias("_top"))
    text = F.concat_ws(", ", F.transform("_top", lambda t: F.concat(t["value"], F.lit(": "), (-t["minus_n"]).cast("string"))))
    return summary.join(ranked.select("variable", text.alias("top_counts")), "variable", "left")


def first_last(df: DataFrame, key: str, time: str, carry: Sequence[str]) -> DataFrame:
    """First and last time per key, and the latest row's ``carry`` values among rows where all of them are known."""
    known = F.lit(True)
    for c in carry:
        known = known & F.col(c).isNotNull()
    latest = F.max_by(F.struct(*carry), F.when(known, F.struct(time, *carry)))
    out = df.groupBy(key).agg(F.min(time).alias(f"first_{time}"), F.max(time).alias(f"last_{time}"), latest.alias("_at"))
    return out.select(key, f"first_{time}", f"last_{time}", "_at.*")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Rows per equal-width bin (1..bins) of every column, with the bin's lower edge; only occupied bins."""
    long = _long(df, cols).filter(F.col("value").isNotNull())
    ends = long.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    raw = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(F.floor((F.col("value") - F.col("_lo")) / width) + 1)
    binned = long.join(F.broadcast(ends), "variable")  # one row per column of the table
    return (
        binned.select("variable", F.least(raw, F.lit(bins)).cast("int").alias("bin"), "_lo", width.alias("_w"))
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first(F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("bin_start"))
    )


_BOX = ("q1", "median", "q3")


def quartiles(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Per group: n_rows, n non-NULL values, and the exact quartiles q1, median, q3."""
    q = group_quantiles(df, by, col, [0.25, 0.5, 0.75])
    return q.select(*by, "n_rows", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(_BOX)])


def whiskers(df: DataFrame, boxes: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Boxes with their whiskers, the last values within 1.5 IQR of the box, and the number of values beyond them."""
    by = list(by)
    iqr = F.col("q3") - F.col("q1")
    fenced = join_on(df.select(*by, F.col(col).alias("_v")), boxes, by, "inner")
    within = F.col("_v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return fenced.groupBy(*boxes.columns).agg(
        F.min(F.when(within, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(within, F.col("_v"))).alias("whisker_high"),
        F.sum(F.coalesce(~within, F.lit(False)).cast("long")).alias("n_outliers"),
    )


def box_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Five-number box per group: n, quartiles, whiskers, outliers."""
    return whiskers(df, quartiles(df, by, col).drop("n_rows"), by, col)


def site_summary(df: DataFrame, by: Sequence[str], col: str, min_n: int) -> DataFrame:
    """``n_obs`` and the median per site, for sites with more than ``min_n`` rows."""
    q = group_quantiles(df, by, col, [0.5]).filter(F.col("n_rows") > min_n)
    return q.select(*by, F.col("n_rows").alias("n_obs"), F.col("q")[0].alias(f"median_{col}"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlations of all column pairs as (variable, other, corr) rows; one pass over the table."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(c).alias("variable"), F.lit(c).alias("other"), F.lit(1.0).alias("corr")) for c in cols]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            cells.append(F.struct(F.lit(x).alias("variable"), F.lit(y).alias("other"), F.col(f"c{i}").alias("corr")))
    return row.select(F.inline(F.array(*cells)))


def trend(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """Least-squares line of y on x per group: slope, intercept, r2 and the rows used."""
    used = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy(*by).agg(
        F.sum(used.cast("long")).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def with_totals(df: DataFrame, row: str, cols: Sequence[str], label: str = "Total") -> DataFrame:
    """A cross table with a total column and a grand total row."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
    sums = df.rollup(row).agg(*[F.sum(c).alias(c) for c in cols], F.grouping(row).alias("_grand"))
    return sums.select(F.when(F.col("_grand") == 1, F.lit(label)).otherwise(F.col(row)).alias(row), *cols, total.alias(label))


def yearly_trend(df: DataFrame, date: str, medians: Sequence[str], means: dict[str, Column], site: str) -> DataFrame:
    """Per year: exact medians of some columns, scaled means, and the number of reporting sites."""
    yearly = df.withColumn("year", F.year(date))
    out = yearly.groupBy("year").agg(F.countDistinct(site).alias("n_sites"), *[c.alias(n) for n, c in means.items()])
    for m in medians:
        out = out.join(group_median(yearly, ["year"], m, f"median_{m}").drop("n"), "year", "left")
    return out


def reference_agreement(df: DataFrame, date: str, cols: Sequence[str], reference: DataFrame) -> DataFrame:
    """Mean by date across sites next to a reference series on the same date."""
    means = df.groupBy(date).agg(*[F.avg(c).alias(c) for c in cols])
    return means.join(reference, date, "left")


def top_k(df: DataFrame, col: str, k: int, ties: bool = True, largest: bool = True, once: bool = False) -> DataFrame:
    """The k largest (smallest) rows by value; ties with the k-th are kept.

    The k-th value is found by a bounded top-k, so nothing is ranked in one partition.
    The rows are read twice for that. ``once`` writes them first, for rows that
    are costly to make and few, such as one per group.
    """
    if once and ties:
        df = staged(df, "ranked")
    order = F.col(col).desc() if largest else F.col(col).asc()
    leaders = df.filter(F.col(col).isNotNull()).select(col).orderBy(order).limit(k)
    if not ties:
        return df.filter(F.col(col).isNotNull()).orderBy(order, *[c for c in df.columns if c != col]).limit(k)
    edge = leaders.agg((F.min if largest else F.max)(col)).scalar()
    return df.filter(F.col(col) >= edge if largest else F.col(col) <= edge)


def with_place(df: DataFrame, col: str, ties: Sequence[str], name: str, descending: bool = False) -> DataFrame:
    """Each row's place in the order of a column, ties by further columns; rows equal in all of them in any order.

    Rows are dealt by ranges of the whole order, the row itself being its last
    part, so that equal values spread over the tasks like others. The dealt
    rows are written once, as ranges come from a sample; counts per range give
    the places before it, and only a range is ranked by a task.
    """
    order = [F.col(col).desc() if descending else F.col(col).asc(), *[F.col(c) for c in ties], F.col("_row")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "places")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = dealt.withColumn("_local", local).join(F.broadcast(before), "_part")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_local")).alias(name))


def top_n_by(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, ties: bool = False) -> DataFrame:
    """The first n rows per group; with ``ties`` every row as good as the n-th."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rk", (F.rank() if ties else F.row_number()).over(w)).filter(F.col("_rk") <= n).drop("_rk")
