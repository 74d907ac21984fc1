"""Operator 4, mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import WORD, cut, sheltered, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _target(cells: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: its size, its target and the level's outcome.

    Targets are min(cap, level x weight) at the one level where they add up to
    the wanted total: with sources ordered by cap per weight, the level is that
    of the first source which all sources from it on can pay without reaching
    their caps. One row per source passes through the windows, no documents.
    """
    sizes = cells.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size"))
    at = F.row_number().over(W.orderBy("_null", "_source")) - 1
    named = sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int")))
    capped = named.withColumn("_cap", most * F.col("source_size")).withColumn("_total", share * F.sum("source_size").over(W.partitionBy()))
    order = W.orderBy(F.col("_cap") / F.col("_weight"), "_null", "_source")
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = capped.withColumn("_level", (F.col("_total") - before) / rest)
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.col("_level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("_at", level).select("_null", "_source", "source_size", F.coalesce(F.least("_cap", F.col("_at") * F.col("_weight")), "_cap").alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` with struct ``_mix``: size, source_size, target, copies, taken.

    A source's documents are ordered by size band, then by a hash of the id (256
    cells a band), then by size and id. The prefix sum of expected copies, each
    document's being target / source size, goes up by one rate a document;
    with a random offset per source, a document is emitted once per whole number
    it crosses. Neighbours in the order are of like size, so words taken come
    near the target. Positions are a prefix sum over cells (at most 256 a band
    and source) plus a rank inside a cell, so no source passes through one task.

    Null text has size 0, a null source is a source of its own and the last.
    Sources without words have target 0 and rate 0. Repeated rows are documents
    each. Ids decide the order, so reruns agree; rows with a null id share cells. Other
    columns are carried and may have any name but ``_mix``.
    """
    rows, held, back = sheltered(docs)
    rows = rows.withColumns({"_size": word_count(F.col(held[text_col])), "_null": F.col(held[source_col]).isNull(), "_source": F.coalesce(F.col(held[source_col]), F.lit(""))})
    bits = F.length(F.bin("_size"))
    band = bits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))")
    hashed = F.substring(F.md5(F.coalesce(F.col(held[id_col]).cast("string"), F.lit(""))), 1, 2)
    rows = rows.withColumns({"_band": band, "_hash": hashed})
    cell = ["_null", "_source", "_band", "_hash"]
    cells = cut(rows.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")))
    base = F.sum("_n").over(W.partitionBy("_null", "_source").orderBy("_band", "_hash").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("_source"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cells.withColumn("_base", base).join(_target(cells, weights, share, most), ["_null", "_source"]).select(*cell, "_base", "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    plan = plan.select(*cell, F.struct("_base", "source_size", "target", "_rate", "_offset").alias("_plan"))
    at = F.col("_plan._base") + F.row_number().over(W.partitionBy(*cell).orderBy("_size", held[id_col])) - 1
    crossed = F.floor((F.col("_at") + 1) * F.col("_plan._rate") + F.col("_plan._offset")) - F.floor(F.col("_at") * F.col("_plan._rate") + F.col("_plan._offset"))
    found = rows.join(plan, cell).withColumn("_at", at).withColumn("_copies", crossed.cast("long"))
    mix = F.struct(F.col("_size").alias("size"), F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))
    return found.select(*back, mix.alias("_mix"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    taken = mixed(docs, **options).filter("_mix.copies > 0")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.expr("sequence(1L, _mix.copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken", "_mix.copies")


SQL = r"""
WITH s AS (SELECT doc_id, source IS NULL AS z, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
p AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS band, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS h FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY z, source ORDER BY band, h, size, doc_id NULLS FIRST) - 1 AS pos FROM p),
g AS (SELECT z, source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY z, encode(source)) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total FROM g),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, z, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (ORDER BY cap / weight, z, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT first(lev ORDER BY cap / weight, z, encode(source)) AS lev FROM l WHERE lev <= cap / weight),
t AS (SELECT z, source, source_size, coalesce(least(cap, f.lev * weight), cap) AS target FROM l LEFT JOIN f ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate, CAST('0x' || substr(md5('mix:' || source), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS shift FROM t)
SELECT doc_id, size, source_size, target, CAST(floor((pos + 1) * rate + shift) - floor(pos * rate + shift) AS BIGINT) AS copies,
       CAST(floor((pos + 1) * rate + shift) - floor(pos * rate + shift) AS BIGINT) * size AS taken
FROM o JOIN r USING (z, source)
"""
