import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from envspark.operators import (
    append_distinct,
    box_stats,
    densify,
    fill_with_agg,
    group_quantiles,
    histogram,
    impute_group_mean,
    lag_sum,
    nest,
    phase_features,
    roll_sum,
    section_fill,
    share_within,
    site_summary,
    top_k,
    unnest,
    unswap,
)
from envspark.operators.slices import POS, over_order, running_sum
from envspark.streaming import missing_keys, top_up

D0 = dt.date(2024, 1, 1)


def series(n, values=None):
    return [("a", D0 + dt.timedelta(days=i), float(values[i]) if values and values[i] is not None else (None if values else float(i))) for i in range(n)]


SERIES = "k string, d date, v double"


def test_rolling_sum_needs_seven_known_rows(spark):
    assert [r["s"] for r in roll_sum(spark.createDataFrame(series(6), SERIES), ["k"], "d", "v", 7, "s").collect()] == [None] * 6
    holed = [1, 1, 1, None, 1, 1, 1, 1, 1, 1, 1]
    got = [r["s"] for r in roll_sum(spark.createDataFrame(series(11, holed), SERIES), ["k"], "d", "v", 7, "s").orderBy("d").collect()]
    assert got == [None] * 10 + [7.0]


def test_lag_sum_skips_the_current_row(spark):
    got = [r["s"] for r in lag_sum(spark.createDataFrame(series(5), SERIES), ["k"], "d", "v", [1, 2], "s").orderBy("d").collect()]
    assert got == [None, None, 1.0, 3.0, 5.0]


@pytest.mark.parametrize("fn", ["roll", "lag", "phase"])
def test_sliced_windows_equal_plain_ones(spark, fn):
    rng = random.Random(11)
    rows = [(rng.choice(["hot", "hot", "hot", "x", "y"]), i, float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v double")

    def run(bits, block):
        rows = df.dropDuplicates(["k", "t"]).withColumn(POS, F.col("t"))
        build = {
            "roll": lambda w: {"s": F.sum("v").over(w.rowsBetween(-6, 0))},
            "lag": lambda w: {"s": F.lag("v", 1).over(w) + F.lag("v", 2).over(w)},
            "phase": lambda w: {"s": F.lead("v").over(w) - F.col("v")},
        }[fn]
        out = over_order(rows, ["k"], [F.col(POS)], build, before=6, after=1, bits=bits, block_rows=block)
        return sorted((r["k"], r["t"], str(r["s"])) for r in out.collect())

    plain = over_order(df.withColumn(POS, F.col("t")), ["k"], [F.col(POS)], lambda w: {"s": F.lit(0)}, bounded=True)
    assert plain.count() == len(run(12, 1000)) == 400
    assert run(12, 1000) == run(3, 20) == run(6, 7)


@pytest.mark.parametrize("descending", [False, True])
def test_sliced_running_sum(spark, descending):
    rows = [(k, float(i), i % 5) for k in ("hot", "b") for i in range(300 if k == "hot" else 4)]
    df = spark.createDataFrame(rows, f"k string, {POS} double, n long")
    run = lambda bits: sorted(tuple(r) for r in running_sum(df, ["k"], {"c": "n"}, descending, bits).collect())
    assert run(12) == run(2) == run(20)
    ahead = [r for r in rows if r[0] == "hot" and (r[1] >= 7 if descending else r[1] <= 7)]
    assert ("hot", 7.0, 2, sum(n for _, _, n in ahead)) in run(4)


def jobs_started(spark, define):
    """Jobs that defining a frame starts, before anything is asked of it."""
    spark.sparkContext.setJobGroup("definition", "")
    try:
        define()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("definition"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_ordered_work_starts_no_jobs_when_defined(spark):
    from envspark.models import roc_curve
    from envspark.operators import asof_backward, asof_forward, asof_with_fallback, nearest_value, next_value, profile

    rows = spark.createDataFrame([("a", D0, 1.0, True)], "k string, t date, v double, good boolean")
    events = rows.withColumnsRenamed({"t": "rt", "v": "rv"})
    for define in (
        lambda: asof_backward(rows, events, "k", "t", "rt", carry=["rv"]),
        lambda: asof_forward(rows, events, "k", "t", "rt", carry=["rv"]),
        lambda: asof_with_fallback(rows.drop("good"), events, "k", "t", "rt", 8.0, "z", "good", carry=["rv", "good"]),
        lambda: nearest_value(rows, events, "v", "rv", "n"),
        lambda: next_value(rows, events, "v", "rv", "n"),
        lambda: phase_features(rows, "k", "t", "v"),
        lambda: lag_sum(rows, ["k"], "t", "v", [1, 2], "s"),
        lambda: group_quantiles(rows, ["k"], "v", [0.5]),
        lambda: box_stats(rows, ["k"], "v"),
        lambda: profile(rows, ["v"]),
        lambda: roc_curve(rows, "k", {"a": "v"}),
        lambda: nest(rows, ["k"]),
    ):
        assert jobs_started(spark, define) == 0


def test_a_third_of_all_rows_at_one_time(spark):
    from envspark.operators import asof_backward

    n = 3000
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 3 == 0, 100).otherwise(F.col("id")).alias("t"))
    right = spark.createDataFrame([("hot", t % 99, t) for t in range(400)] + [("hot", 100, -1)], "k string, rt long, x long")
    for bits in (0, 3, 12):
        got = asof_backward(left, right, "k", "t", "rt", tie_break=[F.col("x")], bits=bits).groupBy("x").count().collect()
        assert {r["x"]: r["count"] for r in got} == {395: 1000, None: 2000}


@pytest.mark.parametrize("levels", [1, 2])
def test_exact_quantiles(spark, levels):
    import numpy as np

    rng = random.Random(2)
    rows = [(k, round(rng.lognormvariate(3, 2), 2)) for k, n in (("hot", 500), ("b", 3), ("c", 1)) for _ in range(n)] + [("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["q"]) for r in group_quantiles(df, ["k"], "v", [0, 0.25, 0.5, 0.9, 1], levels).collect()}
    for k in ("hot", "b", "c"):
        data = [v for kk, v in rows if kk == k]
        assert got[k][0] == len(data)
        assert got[k][1] == pytest.approx(list(np.quantile(data, [0, 0.25, 0.5, 0.9, 1])), rel=1e-12)
    assert got["d"] == (0, None)


def test_section_fill(spark):
    rows = [(i, "" if i % 6 == 2 else str(i), f"n{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "row long, id string, name string")
    got = {r["row"]: r["area"] for r in section_fill(df, "row", F.col("id") == "", F.col("name"), "area").collect()}
    assert len(got) == 25 and got[1] is None and got[3] == "n2" and got[13] == "n8" and got[29] == "n26"


def test_densify_has_every_entity_on_every_date(spark):
    df = spark.createDataFrame([("a", "A", D0, 1.0), ("b", "B", D0 + dt.timedelta(days=3), 2.0)], "id string, name string, d date, v double")
    assert densify(df, ["id", "name"], "d").count() == 4
    assert densify(df, ["id", "name"], "d", calendar=True).count() == 8
    with pytest.raises(TypeError):
        densify(df.withColumn("d", F.col("d").cast("timestamp")), ["id"], "d")


def test_group_mean_and_shares(spark):
    df = spark.createDataFrame([("d", 1.0), ("d", None), ("d", 3.0), ("e", None), (None, None), (None, 4.0)], "g string, v double")
    got = sorted((str(r["g"]), r["v"]) for r in impute_group_mean(df, ["g"], ["v"]).collect() if r["v"] is not None)
    assert got == [("None", 4.0), ("None", 4.0), ("d", 1.0), ("d", 2.0), ("d", 3.0)]
    shares = share_within(spark.createDataFrame([("x", 1), ("x", 3), ("z", 0)], "g string, n long"), ["g"], "n", "p").collect()
    assert sorted((r["g"], r["n"], r["p"]) for r in shares) == [("x", 1, 0.25), ("x", 3, 0.75), ("z", 0, None)]


def test_more_than_a_hundred_rows_and_ties(spark):
    rows = [("in", 1.0)] * 101 + [("out", 5.0)] * 100
    assert [r["s"] for r in site_summary(spark.createDataFrame(rows, "s string, v double"), ["s"], "v", 100).collect()] == ["in"]
    tied = spark.createDataFrame([(i, 10.0 - min(i, 9)) for i in range(14)], "i int, v double")
    assert top_k(tied, "v", 10).count() == 14
    assert top_k(tied, "v", 10, ties=False).count() == 10
    assert top_k(tied, "v", 3, largest=False).count() == 5


def test_box_and_histogram_count_every_row(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    row = box_stats(df, ["g"], "v").first()
    assert (row["n"], row["median"], row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (5, 3.0, 1.0, 4.0, 1)
    bins = histogram(df, ["v"], 10).collect()
    assert sum(r["n"] for r in bins) == 5 and {r["bin"] for r in bins} == {1, 10}


def test_top_up_twice_is_once(spark):
    old = spark.createDataFrame([(1, D0), (2, D0)], "id int, d date")
    new = spark.createDataFrame([(2, D0 + dt.timedelta(days=1)), (3, D0 + dt.timedelta(days=1)), (4, D0 - dt.timedelta(days=9))], "id int, d date")
    once = top_up(old, new, "d", ["id"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, D0), (2, D0 + dt.timedelta(days=1)), (3, D0 + dt.timedelta(days=1))]
    assert sorted(top_up(once, new, "d", ["id"]).collect()) == sorted(once.collect())
    assert top_up(old.limit(0), new, "d", ["id"]).count() == 3
    assert missing_keys(new, append_distinct(old, new, ["id"]), ["id"]).count() == 0


def test_nest_gives_one_row_per_group_and_loses_nothing(spark):
    df = spark.createDataFrame([("hot", i % 7) for i in range(300)] + [("b", 1), (None, 2)], "k string, v int")
    nested = nest(df, ["k"])
    assert {r["k"]: r["n"] for r in nested.select("k", F.size("data").alias("n")).collect()} == {"hot": 300, "b": 1, None: 1}
    assert sorted(unnest(nested).collect(), key=repr) == sorted(df.collect(), key=repr)


def test_swap_reads_old_values(spark):
    df = spark.createDataFrame([(-74.0, 40.7), (40.7, -74.0), (None, 1.0)], "lat double, lon double")
    got = [tuple(r) for r in unswap(df.coalesce(1), "lat", "lon", F.col("lat") < F.col("lon")).collect()]
    assert got == [(40.7, -74.0), (40.7, -74.0), (None, 1.0)]


def test_fill_with_the_table_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    assert sorted(r["v"] for r in fill_with_agg(df, "v", F.avg("v")).collect()) == [1.0, 2.0, 3.0]
