"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from envspark.session import remove, remove_at_end, shared_dir, staged

#: ASCII white space as a character class; words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts handed to Python at a time by steps that treat each one by itself; changes no result.
TEXTS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: computed once, and safe when executors are lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    remove_at_end(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


@contextmanager
def modest_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside hands at most TEXTS rows at a time to Python.

    Spark's 10,000 whole texts are held by the JVM as a growing Arrow buffer and
    by the worker twice, in every running task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(TEXTS if int(before) <= 0 else min(int(before), TEXTS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return to the system what this process has freed: allocators keep it, and idle workers would keep it beside the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError, TypeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over a task's batches; at its end the worker gives back the memory that the task has freed."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def sieve(rows: DataFrame, row_id: str, ids: DataFrame, id_col: str, slots: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be among ``ids``, and those whose id is not, told apart before any shuffle.

    A bitmap of ``slots`` bits holds the hashes of the ids: a table of at most
    ``slots / 64`` rows (2 MB), whatever the number of ids, so it is broadcast.
    Null ids are not among them.
    """
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(slots))
    held = ids.select(slot(id_col).alias("s")).select(F.shiftright("s", 6).alias("_slot_of_ids"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    bitmap = F.broadcast(held.groupBy("_slot_of_ids").agg(F.bit_or("b").alias("_bits_of_ids")))
    own = slot(f"`{row_id}`")
    found = rows.join(bitmap, F.shiftright(own, 6) == F.col("_slot_of_ids"), "left")
    bit = F.call_function("shiftright", F.col("_bits_of_ids"), own.bitwiseAND(F.lit(63)).cast("int"))
    there = F.col(f"`{row_id}`").isNotNull() & (F.coalesce(F.col("_bits_of_ids"), F.lit(0)) != 0)
    return tuple(found.filter(c).drop("_slot_of_ids", "_bits_of_ids") for c in (there & (bit.bitwiseAND(F.lit(1)) == 1), ~there | (bit.bitwiseAND(F.lit(1)) == 0)))


def sheltered(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """The rows under names that no helper column takes, where each column went, and the columns under their own names again.

    Operators that carry whole rows compute on these, so that input columns may
    have any names.
    """
    held = {c: f"_{k}_of_row" for k, c in enumerate(df.columns)}
    return df.toDF(*held.values()), held, [F.col(h).alias(c) for c, h in held.items()]


def tasks(spark: SparkSession) -> int:
    """Partitions to spread small rows over that become many rows each; asked for by number, they are not merged at run time."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def star(keyed: DataFrame, key: str, node: str) -> DataFrame:
    """Links (u, v) from every row to the smallest node of its key; one row per member, never one per pair.

    For keys that hold a bounded number of rows: one shuffle, and no map-side
    combination, which would hold every key once more.
    """
    hub = F.min(node).over(W.partitionBy(key))
    return keyed.select(F.col(node).alias("u"), hub.alias("v")).filter("u <> v").distinct()


class Rounds:
    """Tables that an iteration writes to the shared folder, read back with their true sizes.

    Joins of joins of checkpoints would have the planner multiply size estimates
    round after round. Tables of rounds before the last are removed.
    """

    def __init__(self) -> None:
        self.before: list[DataFrame] = []
        self.now: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.now.append(staged(df, "round"))
        return self.now[-1]

    def turn(self) -> None:
        for df in self.before:
            remove(df)
        self.before, self.now = self.now, []


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of links (u, v): rows (node, root), root being the component's smallest node.

    Alternates between pointing every node's larger neighbours and its smaller
    neighbours at its smallest one until every component is a star. Each round
    is two aggregations and two joins, written to the shared folder; the minima
    are written before they are joined, so that the join can split a node with very
    many links. Nulls and self links are ignored; nodes without links are not
    returned.
    """
    rounds = Rounds()
    links = rounds.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(links):
        rounds.turn()
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = rounds.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = rounds.keep(large)
        low = rounds.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = rounds.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _stars(links: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, nor both a smaller and a larger one."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).union(links.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return held.filter("smaller > 1 or smaller = 1 and larger = 1").isEmpty()
