"""Exact order statistics per group by radix selection: counts per cell narrow the wanted ranks down, nothing is sorted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.operators.slices import POS, join_on

#: Cells a range of values is cut into at each level: what a window sees of a group and range at most.
CELLS = 1 << 16

_LARGEST = 1.7976931348623157e308


def _compressed(x: Column) -> Column:
    """The 64th root with its sign: brings all magnitudes within a small range. Square roots are rounded correctly, so order is kept."""
    root = F.abs(F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST)))
    for _ in range(6):
        root = F.sqrt(root)
    return F.when(x < 0, -root).otherwise(root)


def _cell(x: Column, low: Column, high: Column) -> Column:
    """The place of a value among CELLS even cells of a range; never falls as the value rises."""
    share = (x / 2 - low / 2) / (high / 2 - low / 2)
    return F.when(high > low, F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int")


def group_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], levels: int = 1) -> DataFrame:
    """One row per group: ``n_rows``, ``n`` values, and ``q``, the exact interpolated quantiles in probs order.

    Values are counted per (group, value) once. The wanted ranks of all
    probabilities start in one range, the group's smallest to largest value.
    Each level counts the values of a range in CELLS even cells and keeps, for
    each rank, the cell it falls into, from its smallest to its largest value.
    Ranges follow the values, so values packed into a narrow range are told
    apart as well as others. The first level goes by magnitude, so that far
    outliers don't leave the rest in one cell. What remains after ``levels``
    is ranked value by value: of a group spread evenly, the
    CELLS ** levels-th part of its distinct values. The plan is the same at every size.
    NULL and NaN are no values.
    """
    by = list(by)
    keyed = df if by else df.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    value = F.col(col).cast("double")
    known = keyed.select(*keys, F.when(~F.isnan(value), value).alias(POS))
    counts = known.groupBy(*keys, POS).agg(F.count(F.lit(1)).alias("_c"))
    n = F.coalesce(F.sum(F.when(F.col(POS).isNotNull(), F.col("_c"))), F.lit(0))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n_rows"), n.alias("n"), F.min(POS).alias("_low"), F.max(POS).alias("_high"))
    at = [(F.col("n") - 1) * float(p) for p in probs]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    ranges = sizes.filter("n > 0").select(*keys, "_low", "_high", F.lit(0).cast("long").alias("_before"), ranks.alias("_ranks"))
    values = counts.filter(F.col(POS).isNotNull())
    own = [*keys, "_low"]
    for level in range(levels + 1):
        inside = join_on(values, ranges, keys).filter(F.col(POS).between(F.col("_low"), F.col("_high")))
        if level < levels:
            scale = _compressed if not level else (lambda x: x)
            marked = inside.withColumn("_cell", _cell(scale(F.col(POS)), scale(F.col("_low")), scale(F.col("_high"))))
            parts = marked.groupBy(*own, "_before", "_ranks", "_cell").agg(F.sum("_c").alias("_c"), F.min(POS).alias("_least"), F.max(POS).alias("_most"))
        else:
            parts = inside.select(*own, "_before", "_ranks", F.col(POS).alias("_cell"), "_c", F.col(POS).alias("_least"), F.col(POS).alias("_most"))
        earlier = F.sum("_c").over(W.partitionBy(*own).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
        placed = parts.withColumn("_before", F.col("_before") + F.coalesce(earlier, F.lit(0)))
        here = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
        ranges = placed.withColumn("_ranks", here).filter(F.size("_ranks") > 0).select(*keys, F.col("_least").alias("_low"), F.col("_most").alias("_high"), "_before", "_ranks")
    found = ranges.select(*keys, F.explode("_ranks").alias("_rank"), F.col("_low").alias("_value"))
    found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))  # two ranks a probability
    picked = join_on(sizes, found, keys, "left")
    values = []
    for a in at:
        low, high = (F.element_at("_at", f(a).cast("long")) for f in (F.floor, F.ceil))
        values.append(F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a))))
    return picked.select(*by, "n_rows", "n", F.when(F.col("n") > 0, F.array(*values)).alias("q"))


def group_median(df: DataFrame, by: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """One row per group: ``n`` and the exact median."""
    out = group_quantiles(df, by, col, [0.5])
    return out.select(*by, "n", F.col("q")[0].alias(name or f"median_{col}"))
