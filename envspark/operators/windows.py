"""Series features along an order within a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import rolling_sum
from envspark.functions.times import elapsed_hours, position
from envspark.operators.slices import BLOCK_ROWS, POS, join_on, last_known, over_order, position_bits


def phase_features(
    df: DataFrame,
    station: str,
    time: str,
    level: str,
    range_name: str = "tide_range_ft",
    duration_name: str = "tide_duration_hrs",
    max_hours: float = 8.0,
) -> DataFrame:
    """Change to the next turning point and hours until it; longer phases than ``max_hours`` have no duration.

    Of rows repeating a (station, time) the one with the highest level counts,
    then the one whose other columns sort last. Hours are elapsed time: wall
    clocks (TIMESTAMP_NTZ) are read in the session zone.
    """
    rest = [level, *[c for c in df.columns if c not in (station, time, level)]]
    points = df.groupBy(station, time).agg(F.max(F.struct(*rest)).alias("_row")).select(station, time, "_row.*").select(*df.columns)
    points = points.withColumn(POS, position(df, time))

    def build(w):
        hours = elapsed_hours(df, time, F.lead(time).over(w), F.col(time))
        return {range_name: F.lead(level).over(w) - F.col(level), duration_name: F.when(hours <= max_hours, hours)}

    return over_order(points, [station], [F.col(POS)], build, after=1, bits=position_bits(df, time)).drop(POS)


def lag_sum(
    df: DataFrame, by: Sequence[str], order: str, col: str, lags: Sequence[int], name: str, bounded: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sum of earlier rows' values, NULL when any of them is missing; one row per (by, order).

    ``bounded`` states that a key has no more rows than a task sorts, as in a
    daily series; then one window per key does.
    """
    rows = df.withColumn(POS, position(df, order))

    def build(w):
        first, *rest = [F.lag(col, k).over(w) for k in lags]
        return {name: sum(rest, first)}

    return over_order(rows, by, [F.col(POS)], build, before=max(lags), bits=position_bits(df, order), block_rows=block_rows, bounded=bounded).drop(POS)


def roll_sum(
    df: DataFrame, by: Sequence[str], order: str, col: str, n: int, name: str, bounded: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Right-aligned n-row sum; NULL while incomplete or over a NULL; one row per (by, order). ``bounded`` as in :func:`lag_sum`."""
    rows = df.withColumn(POS, position(df, order))
    build = lambda w: {name: rolling_sum(col, n, w)}
    return over_order(rows, by, [F.col(POS)], build, before=n - 1, bits=position_bits(df, order), block_rows=block_rows, bounded=bounded).drop(POS)


def impute_group_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """NULL → mean of the column over the rows of the group.

    Group means come from a partial aggregate and are joined back, so a group
    with a third of the rows is never gathered; AQE splits it in the join.
    """
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = join_on(df, means, by, "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}
    return joined.withColumns(filled).select(*df.columns)


def share_within(df: DataFrame, by: Sequence[str], n: str, name: str) -> DataFrame:
    """Each row's part of its group's total; NULL in a group that sums to 0."""
    totals = df.groupBy(*by).agg(F.sum(n).alias("_total"))
    return join_on(df, totals, by, "left").withColumn(name, F.try_divide(F.col(n), F.col("_total"))).select(*df.columns, name)


def group_extreme(df: DataFrame, by: Sequence[str], name: str, expression: Column) -> DataFrame:
    """The group's largest value of a row expression, on every row of the group."""
    top = df.groupBy(*by).agg(F.max(expression).alias("_top"))
    return join_on(df, top, by, "left").withColumn(name, F.col("_top")).drop("_top")


def section_fill(
    df: DataFrame, order: str, is_header: Column, name: Column, into: str, by: Sequence[str] = ()
) -> DataFrame:
    """Rows of a sectioned list with their section's name; the header rows themselves are dropped.

    ``order`` is the explicit row number within ``by`` (a file, say).
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    header = F.coalesce(is_header, F.lit(False))
    rows = rows.withColumns({POS: position(df, order), into: F.when(header, name), "_header": header})
    filled = last_known(rows, keys, [F.col(POS)], into, position_bits(df, order))
    return filled.filter(~F.col("_header")).select(*df.columns, into)
