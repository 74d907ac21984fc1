"""Operator 2, approximate nearest neighbours: shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.llm.common import cut, table

#: Orderings, their projected dimensions and bits per dimension, and rows in a block of keys.
CURVES, DIMS, BITS, BLOCK = 20, 12, 5, 1024

#: Least share of all ranks of an ordering that a query meets, half of it on either side.
SHARE = 0.06


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cell numbers on the Hilbert curve (Skilling's transform), as longs."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, block: int = BLOCK, seed: int = 7, share: float = SHARE) -> DataFrame:
    """The ``k`` nearest rows found for every row that ``queries`` (a condition on the id column) marks.

    Rows (query_id, rank, vec_id, score), score being the Euclidean distance in
    double precision, nearest first, ties to the smaller id. Each of ``curves``
    orderings projects the centred vectors to ``dims`` random orthogonal
    directions, shifts the grid, and sorts by position on the Hilbert curve. A
    range partitioning gives every vector its place, whatever the keys look
    like; places are cut into blocks of ``block`` rows. A query meets its own
    block and as many on either side as hold ``share`` of all rows together, one
    at least; candidates of all orderings are merged. So the window follows the
    table, and the work of a query grows with it: see the README for recall.

    Rows with a null id or a vector that is null, zero, or holds null or
    non-finite components take no part, nor do vectors of another length than
    most have. Of rows that repeat an id, the one with the smallest vector
    counts. Equal vectors are indexed once, with the k + 1 smallest ids that
    hold them; no other id among them can be in a result. With fewer candidates
    than k, all found are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    lengths = named.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths[0] if lengths else 1
    clean = cut(named.filter(F.size("v") == length).groupBy("vec_id").agg(F.min("v").alias("v")))
    top = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    few = clean.withColumn("_r", top).filter(F.col("_r") <= k + 1)
    members = cut(few.select("v", "vec_id", F.min("vec_id").over(W.partitionBy("v")).alias("rep")))
    reps = members.filter("rep = vec_id").select("rep", "v")
    asked = cut(clean.filter(queries).select(F.col("vec_id").alias("query_id"), "v").join(reps, "v").select("query_id", F.col("rep").alias("asked")))

    stats = clean.agg(F.array(*[F.avg(F.col("v")[i].cast("double")) for i in range(length)]), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    mean = np.array([x or 0.0 for x in stats[0]])
    spread = np.sqrt(max(((stats[1] or 1.0) - mean @ mean) / length, 1e-30))
    rng = np.random.default_rng(seed)
    width = min(dims, length)
    planes = [np.linalg.qr(rng.standard_normal((length, width)))[0] for _ in range(curves)]
    shifts = rng.random((curves, width))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = (np.stack(pdf["v"].to_numpy()).astype(np.float64) - mean) / spread
            for c in range(curves):
                unit = (np.clip(x @ planes[c], -3, 3) + 3) / 6
                cells = np.minimum((unit + shifts[c]) / 2 * (1 << bits), (1 << bits) - 1).astype(np.int64)
                yield pd.DataFrame({"curve": np.full(len(pdf), c, np.int32), "key": hilbert_keys(cells, bits), "rep": pdf["rep"]})

    keys = reps.mapInPandas(order, "curve int, key long, rep long")
    places = cut(keys.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep").withColumn("_at", F.monotonically_increasing_id()))
    parted = places.withColumn("_part", F.shiftright("_at", 33))
    firsts = parted.groupBy("curve", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("curve").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = parted.join(firsts.select("curve", "_part", "_first", before.alias("_before")), ["curve", "_part"])
    blocks = ranked.select("curve", "rep", F.floor((F.col("_before") + F.col("_at") - F.col("_first")) / block).alias("_block"))
    held = blocks.join(reps, "rep").select("curve", "_block", "rep", "v", F.lit(False).alias("_asks"))
    asking = asked.select(F.col("asked").alias("rep")).distinct()
    beside = max(1, math.ceil(share * reps.count() / (2 * block)))
    asks = held.join(asking, "rep").select("curve", F.explode(F.sequence(F.col("_block") - beside, F.col("_block") + beside)).alias("_block"), "rep", "v", F.lit(True).alias("_asks"))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["_asks"].to_numpy()
        ids = pdf["rep"].to_numpy()
        found = []
        if asks.any() and not asks.all():
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            rep, y = ids[~asks], x[~asks]
            for q, a in zip(x[asks], ids[asks]):
                apart = np.sqrt(((y - q) ** 2).sum(axis=1))
                best = np.lexsort((rep, apart))[: k + 1]
                found.append(pd.DataFrame({"asked": a, "rep": rep[best], "score": apart[best]}))
        return pd.concat(found) if found else pd.DataFrame({"asked": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})

    near = held.unionByName(asks).groupBy("curve", "_block").applyInPandas(score, "asked long, rep long, score double")
    near = near.groupBy("asked", "rep").agg(F.min("score").alias("score"))
    ids = near.join(members.select("rep", "vec_id"), "rep")
    best = ids.withColumn("_r", F.row_number().over(W.partitionBy("asked").orderBy("score", "vec_id"))).filter(F.col("_r") <= k + 1)
    pairs = best.join(asked, "asked").filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
