"""Category codes as a joined table, for columns with more labels than a driver should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.operators.aggregate import with_place


def category_codes(df: DataFrame, col: str) -> DataFrame:
    """One row per label: (``col``, ``code``), the most frequent label being 0; equal counts by the label itself.

    Labels are counted with partial sums and placed by ranges of the whole
    order (:func:`with_place`), so neither the driver nor one task sees them
    all. NULL is no label.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_place(counts, "_n", ["_label"], "_place", descending=True)
    return placed.select(F.col("_label").alias(col), (F.col("_place") - 1).alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    """All rows with their label's code in ``out``; NULL and labels that have none share the next free code.

    The codes are joined, whatever their number; only how many there are is
    looked up beforehand by the same plan.
    """
    names = [f"_{k}_of_row" for k in range(len(df.columns))]  # no input column is called like a helper
    table = codes.select(F.col(col).alias("_label"), F.col("code").alias("_code"))
    free = codes.agg(F.count(F.lit(1))).scalar()
    found = df.toDF(*names).join(table, F.col(names[df.columns.index(col)]) == F.col("_label"), "left")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)], F.coalesce("_code", free).alias(out))
