"""Keeping stores current: what is missing, and appending it without repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.operators.joins import natural_join
from envspark.operators.reshape import append_distinct
from envspark.session import remove, staged


#: A value below all others, by type.
_LEAST = {"date": "0001-01-01", "timestamp": "0001-01-01 00:00:00", "timestamp_ntz": "0001-01-01 00:00:00", "long": -(1 << 63), "integer": -(1 << 31)}


def missing_keys(needed: DataFrame, have: DataFrame, key: Sequence[str]) -> DataFrame:
    """The needed keys the store does not hold yet; running it again after the top-up gives nothing."""
    return needed.select(*key).distinct().join(have.select(*key), list(key), "left_anti")


def top_up(old: DataFrame, new: DataFrame, time_col: str, key: Sequence[str]) -> DataFrame:
    """Append the rows of ``new`` later than the store's newest row; a repeated key keeps the new row.

    The high-water mark is one value read as a scalar subquery and compared
    with the bare column, so it reaches the scan of ``new``. An empty store
    takes everything but rows without a time.
    """
    least = "-infinity" if old.schema[time_col].dataType.typeName() in ("double", "float") else _LEAST.get(old.schema[time_col].dataType.typeName())
    if least is None:
        raise TypeError(f"{time_col}: no high-water mark along {old.schema[time_col].dataType.simpleString()}")
    mark = old.agg(F.coalesce(F.max(time_col), F.lit(least).cast(old.schema[time_col].dataType))).scalar()
    late = new.filter(F.col(time_col) > mark)
    return append_distinct(old, late, key)


def _exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()).exists(folder)


def commit_top_up(new: DataFrame, path: str, time_col: str, key: Sequence[str], partition_by: str) -> int:
    """Bring a partitioned Parquet store up to date with ``new``; returns the number of rows that were late.

    Only rows beyond the committed mark are looked at, and only the partitions
    they touch are read, merged (a repeated key keeps the new row) and replaced,
    by dynamic partition overwrite. The mark lies beside the store and is
    written after the data, so a run that is broken off anywhere is made good by
    running it again: it merges the same rows into the same partitions, with the
    same outcome. A run without late rows writes nothing. ``partition_by``
    follows from the key and is not NULL; rows without a time are never taken.
    """
    spark, marks = new.sparkSession, f"{path}.mark"
    late = new.filter(F.col(time_col).isNotNull())
    if _exists(spark, f"{marks}/_SUCCESS"):
        late = late.filter(F.col(time_col) > spark.read.parquet(marks).select("mark").scalar())
    late = staged(late, "late")
    top = late.agg(F.max(time_col).alias("mark"), F.count(F.lit(1)).alias("n"))
    found = top.first()["n"]
    if found:
        merged = late
        if _exists(spark, path):
            store = spark.read.schema(new.schema).parquet(path)
            merged = append_distinct(natural_join(store, late.select(partition_by).distinct(), "left_semi"), late, key)
        merged = staged(merged.select(*new.columns), "merged")
        merged.hint("rebalance", partition_by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition_by).parquet(path)
        top.select("mark").coalesce(1).write.mode("overwrite").parquet(marks)
        remove(merged)
    remove(late)
    return found
