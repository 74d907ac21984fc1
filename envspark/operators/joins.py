"""Join shapes built from plain equi, semi and anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_renamed(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "left") -> DataFrame:
    """Equi join on differently named keys ``{left: right}``; keeps the left names."""
    return left.join(right.withColumnsRenamed({r: l for l, r in keys.items()}), list(keys), how)


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all common column names."""
    common = [c for c in a.columns if c in b.columns]
    if not common:
        raise ValueError("no common columns")
    return a.join(b, common, how)


def left_join_with_default(
    left: DataFrame, right: DataFrame, by: Sequence[str], key: str, default, value_cols: Sequence[str], decide_on: str | None = None
) -> DataFrame:
    """Left join on ``by`` plus ``key``; rows left without a value take the default key's row (:func:`fill_from_default`)."""
    others = [c for c in by if c != key]
    joined = left.join(right.select(*others, key, *value_cols), [*others, key], "left")
    return fill_from_default(joined, right, others, key, default, value_cols, decide_on)


def fill_from_default(
    df: DataFrame, right: DataFrame, others: Sequence[str], key: str, default, value_cols: Sequence[str], decide_on: str | None = None
) -> DataFrame:
    """Rows whose ``decide_on`` value (the first value column) is NULL take key and all values from the default key's row.

    One pass over the rows, no split and union. ``right`` is unique on
    ``others`` plus ``key``.
    """
    missing = F.col(decide_on or value_cols[0]).isNull()
    spare = right.filter(F.col(key) == F.lit(default)).select(*others, *[F.col(c).alias(f"_d_{c}") for c in value_cols])
    joined = df.join(spare, list(others), "left")
    values = {c: F.when(missing, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in value_cols}
    return joined.withColumns({key: F.when(missing, F.lit(default)).otherwise(F.col(key)), **values}).select(*df.columns)


def cohort(df: DataFrame, key: str, having: Column, *aggs: Column) -> DataFrame:
    """Rows of the keys whose aggregates pass ``having``."""
    keep = df.groupBy(key).agg(*aggs).filter(having).select(key)
    return df.join(keep, key, "left_semi")


def compare_assignments(a: DataFrame, b: DataFrame, on: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Left join and one flag per pair: do the two sources agree (NULL where either is missing)."""
    return a.join(b, list(on), "left").withColumns({flag: F.col(x) == F.col(y) for flag, (x, y) in pairs.items()})
