import pathlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from envspark.operators import with_place
from envspark.streaming import commit_top_up

SCHEMA = "k long, t long, day long, v string"


def rows(spark, items, v="a"):
    return spark.createDataFrame([(k, t, None if t is None else t // 10, v) for k, t in items], SCHEMA)


def held(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).select("k", "t", "day", "v").collect()))


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [(k, k) for k in range(35)]
    assert commit_top_up(rows(spark, [*first, (99, None)]), path, "t", ["k"], "day") == 35
    before = files(path)
    assert commit_top_up(rows(spark, first, "changed"), path, "t", ["k"], "day") == 0 and files(path) == before
    assert commit_top_up(rows(spark, [(k, k) for k in range(30, 45)], "b"), path, "t", ["k"], "day") == 10
    after = files(path)
    assert {f for f in before if "day=3" not in f} <= set(after) and all(after[f] == before[f] for f in before if "day=3" not in f)
    assert held(spark, path) == sorted([(k, k, k // 10, "a") for k in range(35)] + [(k, k, k // 10, "b") for k in range(35, 45)])


@pytest.mark.parametrize("done", ["newest partition only", "all but the mark", "no mark at all"])
def test_a_run_broken_off_is_made_good(spark, tmp_path, done):
    path = str(tmp_path / "store")
    commit_top_up(rows(spark, [(k, k) for k in range(15)]), path, "t", ["k"], "day")
    late = rows(spark, [(k, k) for k in range(60)], "b")
    part = late.filter("t >= 50" if done == "newest partition only" else "t >= 20")  # what a broken run had put in place
    part.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("day").parquet(path)
    if done == "no mark at all":
        (pathlib.Path(path + ".mark") / "_SUCCESS").unlink()
    commit_top_up(late, path, "t", ["k"], "day")
    old = 0 if done == "no mark at all" else 15
    assert held(spark, path) == sorted([(k, k, k // 10, "a") for k in range(old)] + [(k, k, k // 10, "b") for k in range(old, 60)])


def test_nothing_to_begin_with(spark, tmp_path):
    path = str(tmp_path / "store")
    assert commit_top_up(rows(spark, []), path, "t", ["k"], "day") == 0
    assert commit_top_up(rows(spark, [(1, 1), (1, 1)]), path, "t", ["k"], "day") == 2


@pytest.mark.parametrize("values", ["equal", "packed", "spread"])
def test_places_spread_over_the_tasks(spark, values):
    x = {"equal": F.lit(7.0), "packed": F.lit(7.0) + F.col("id") * 1e-12, "spread": F.col("id") * 7919 % 100_003}[values]
    df = spark.range(200_000).select("id", x.cast("double").alias("x"))
    placed = with_place(df, "x", ["id"], "place")
    got = placed.select("place", F.row_number().over(Window.orderBy("x", "id")).alias("want"))
    assert got.filter("place <> want").count() == 0 and got.count() == 200_000
    same = with_place(df.select("x"), "x", [], "place").agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()
    assert tuple(same) == (1, 200_000, 200_000)


def test_no_range_holds_most_of_equal_values(spark):
    from envspark.operators import aggregate

    seen = []
    keep = aggregate.staged
    aggregate.staged = lambda df, name: seen.append(keep(df, name)) or seen[-1]
    try:
        with_place(spark.range(200_000).select(F.lit(1).alias("x")), "x", [], "place").count()
    finally:
        aggregate.staged = keep
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * 50_000
