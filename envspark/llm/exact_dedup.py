"""Operator 3, exact dedup: 128-bit content hash, bytes compared inside its groups, one stable id kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import cut, lower_ascii, sheltered, table


def normalised(text: Column) -> Column:
    """The text as it is compared: null is empty, A-Z become a-z."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def _groups(rows: DataFrame, keep: str) -> DataFrame:
    """One row per distinct text: (_digest, _sha, keep_id, group_size).

    Grouping by digest and text compares the bytes, so texts that collide on the
    digest stay apart. Map tasks send each distinct text once, however many
    copies they hold. The result is cut, so that a later join shuffles both sides
    and can split a text with very many copies. Two texts equal in both hashes would make the narrow join
    ambiguous; the job then fails rather than answer wrongly.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    by_text = rows.groupBy("_digest", "_text").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
    by_text = by_text.select("_digest", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    unique = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long")).otherwise(F.max("group_size"))
    return cut(by_text.groupBy("_digest", "_sha").agg(F.max("keep_id").alias("keep_id"), unique.alias("group_size")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Every row with the group of texts it belongs to: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Ids may be null: the kept id of a group is its
    smallest (or largest) id that is not null. Rows repeating an id are counted
    and returned each; they are kept alike. Other columns are not read. An
    empty table gives an empty result. Only hashes and ids are joined, never texts.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.md5(text)).alias("_digest"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("_digest"), F.unhex(F.sha2(text, 256)).alias("_sha"))
    found = narrow.join(_groups(rows, keep), ["_digest", "_sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    The row with the smallest (or largest) id stays. Rows that repeat this id
    and text are one document: the one whose other columns hash lowest stays.
    Columns may have any name. An empty table stays empty.
    """
    docs, held, back = sheltered(docs)
    id_col, text = held[id_col], normalised(F.col(held[text_col]))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.md5(text)).alias("_digest"))
    keys = {"_op3_digest": F.unhex(F.md5(text)), "_op3_sha": F.unhex(F.sha2(text, 256))}
    groups = _groups(rows, keep).select(F.col("_digest").alias("_op3_digest"), F.col("_sha").alias("_op3_sha"), F.coalesce("keep_id", F.lit(0)).alias("_op3_id"), F.col("keep_id").isNull().alias("_op3_null"))
    marked = docs.withColumns(keys | {"_op3_id": F.coalesce(id_col, F.lit(0)), "_op3_null": F.col(id_col).isNull()})
    on = ["_op3_digest", "_op3_sha", "_op3_id", "_op3_null"]
    hashed = F.xxhash64(*[f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    first = F.row_number().over(W.partitionBy(*on).orderBy(hashed))
    return marked.join(groups, on).withColumn("_op3_first", first).filter("_op3_first = 1").select(*back)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
