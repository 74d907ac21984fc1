"""Table files: parquet between stages, CSV and JSON at the edge."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet scan; filters and column choices made later reach the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet sink of a stage.

    With partition columns the rows are rebalanced by them first: small
    partitions are not scattered over one file per task, and a hot one is split
    over several tasks by size.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header, blanks around fields trimmed, quotes only where a field starts with one."""
    return spark.read.schema(schema).csv(
        path,
        header=True,
        enforceSchema=True,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        mode="PERMISSIVE",
    )


def export_csv(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write each table as a CSV folder of its own; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = os.path.join(folder, name)
        df.write.mode(mode).csv(paths[name], header=True)
    return paths


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON object per line, read with the declared schema."""
    return spark.read.schema(schema).json(path)
