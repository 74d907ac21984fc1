"""Repeatable stratified splits with exact quotas.

Rows are ranked within their stratum by a salted hash of their key. The hash is
uniform, so its leading digits cut every stratum into even buckets: ranking
happens inside buckets and the bucket offsets come from a small count table. No
stratum, however large, is sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.operators.quantiles import group_quantiles
from envspark.operators.slices import join_on

BUCKET_DIGITS = 4  # hex digits by default: 65,536 buckets per stratum


def hash_rank(df: DataFrame, key: str, seed: int, strata: Sequence[str] = (), digits: int = BUCKET_DIGITS) -> DataFrame:
    """Add ``_rank`` (1-based, by hash) and ``_size`` of the stratum; ``key`` is unique.

    ``digits`` leading hex digits of the hash make a bucket: 16^digits tasks can
    share a stratum. It changes no rank.
    """
    strata = list(strata)
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    marked = df.withColumns({"_hash": digest, "_bucket": F.substring(digest, 1, digits)})
    if not strata:
        marked = marked.withColumn("_all", F.lit(0))
    groups = strata or ["_all"]
    counts = marked.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*groups).orderBy("_bucket")  # one row per bucket
    offsets = counts.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_size"),
    )
    within = Window.partitionBy(*groups, "_bucket").orderBy("_hash", key)
    placed = join_on(marked.withColumn("_rn", F.row_number().over(within)), offsets, [*groups, "_bucket"], "left")
    return placed.select(*df.columns, (F.col("_offset") + F.col("_rn")).alias("_rank"), "_size")


def split_stratified(df: DataFrame, strata: str, prop: float, key: str, seed: int) -> DataFrame:
    """Add ``split``: 'train' for floor(prop * n) rows of every stratum, 'test' for the rest."""
    ranked = hash_rank(df, key, seed, [strata])
    side = F.when(F.col("_rank") <= F.floor(F.col("_size") * F.lit(prop)), F.lit("train")).otherwise(F.lit("test"))
    return ranked.select(*df.columns, side.alias("split"))


def fold_column(df: DataFrame, k: int, key: str, seed: int, strata: str | None = None, breaks: int | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1, even to within one row; within each stratum when given.

    A numeric ``strata`` column is first cut at its quantiles into ``breaks`` strata.
    """
    work = df
    groups: list[str] = []
    if strata and breaks:
        cuts = group_quantiles(df, [], strata, [i / breaks for i in range(1, breaks)]).select("q").scalar()
        above = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(strata)))
        work = df.withColumn("_cuts", cuts).withColumn("_stratum", above).drop("_cuts")
        groups = ["_stratum"]
    elif strata:
        groups = [strata]
    ranked = hash_rank(work, key, seed, groups)
    return ranked.select(*df.columns, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold"))
