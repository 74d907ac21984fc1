"""Unions, long / wide changes, nesting and densifying."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark.operators.slices import join_on


def append_distinct(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The store plus new rows, one row per key; where both have the key the new row wins.

    ``old`` has one row per key already, as this function leaves it. Only the
    new rows are grouped; the store passes an anti join, which needs no shuffle
    of it while the new rows are few. Of new rows with the same key the one
    sorting last is kept.
    """
    key = list(key)
    rest = [c for c in new.columns if c not in key]
    if rest:
        newest = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row"))
        fresh = newest.select(*key, "_row.*").select(*new.columns)
    else:
        fresh = new.distinct()
    kept = join_on(old, fresh.select(*key), key, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name without repeated rows."""
    return a.unionByName(b, allowMissingColumns=True).distinct()


def expand_days_back(df: DataFrame, date: str, n: int) -> DataFrame:
    """Every row for its date and the n days before it, without repeats."""
    days = F.sequence(F.date_sub(F.col(date), n), F.col(date))
    return df.filter(F.col(date).isNotNull()).distinct().withColumn(date, F.explode(days)).distinct()


def tagged_union(tables: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union by name with the name of the table each row came from."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pivot(df: DataFrame, by: Sequence[str], names: str, values: str, levels: Sequence[str]) -> DataFrame:
    """Long to wide for a declared list of codes; ``df`` holds one value per (by, code)."""
    return df.groupBy(*by).pivot(names, list(levels)).agg(F.first(values, ignorenulls=True))


def unpivot_year(df: DataFrame, ids: Sequence[str], pattern: str, value: str) -> DataFrame:
    """Columns with a year in their name → (year, value) rows; empty values are left out."""
    cols = [c for c in df.columns if re.search(pattern, c)]
    long = df.unpivot(list(ids), cols, "_name", value)
    return long.filter(F.col(value).isNotNull()).select(*ids, F.regexp_extract("_name", r"\d+", 0).cast("int").alias("year"), value)


def nest(df: DataFrame, by: Sequence[str], name: str = "data") -> DataFrame:
    """One row per group with its rows as a list column; a group has to fit in one row, whatever its size."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(name))


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = " ") -> DataFrame:
    """Split a column at the first separators; the last part keeps the rest."""
    parts = F.split(F.col(col), re.escape(sep), len(into))
    pieces = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into)]
    at = df.columns.index(col)
    return df.select(*df.columns[:at], *pieces, *df.columns[at + 1 :])


def densify(df: DataFrame, entity_cols: Sequence[str], date: str, calendar: bool = False) -> DataFrame:
    """Every existing entity on every date, facts where there are any.

    Dates are those that occur anywhere in the table, or with ``calendar`` all
    days from the first to the last. Either way the list is bounded by the days
    of the span, not by the rows, and is held as one array; a column of another
    type than DATE has no such bound and is refused.
    """
    if not isinstance(df.schema[date].dataType, T.DateType):
        raise TypeError(f"{date} is {df.schema[date].dataType.simpleString()}; cast it to a date")
    entity_cols = list(entity_cols)
    known = df.filter(F.col(date).isNotNull())
    if calendar:
        spine = known.agg(F.sequence(F.min(date), F.max(date)))
    else:
        spine = known.agg(F.sort_array(F.collect_set(date)))
    grid = df.select(*entity_cols).distinct().withColumn(date, F.explode(spine.scalar()))
    return join_on(grid, df, [*entity_cols, date], "left").select(*df.columns)


def first_by(df: DataFrame, by: Sequence[str], order: Sequence, n: int = 1) -> DataFrame:
    """The first n rows per group in the given order; Spark drops the others before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
