"""Equal-width bins of a column and their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import bin_index


def bin_equal(df: DataFrame, col: str, n: int, name: str | None = None) -> DataFrame:
    """Add ``<col>_bin``, 1..n, over the column's own range (one row of minimum and maximum, read as scalars)."""
    low = df.agg(F.min(col)).scalar()
    high = df.agg(F.max(col)).scalar()
    return df.withColumn(name or f"{col}_bin", bin_index(F.col(col), low, high, n))


def label_bins(df: DataFrame, bin: str, labels: Sequence[str], name: str) -> DataFrame:
    """Label of a 1-based bin; NULL for a missing bin."""
    table = F.array(*[F.lit(l) for l in labels])
    return df.withColumn(name, F.when(F.col(bin).isNotNull(), F.get(table, F.col(bin) - 1)))
