"""Ordered work along a key's position, for keys of any size, as one lazy plan that is the same at every size.

A window over (key, order) puts a whole key into one task. Here positions fall
into buckets of a declared width, and buckets into spans of 1024 buckets.
Windows run per (key, bucket); what a bucket needs from its predecessors comes
from one row per (key, bucket), carried along the span, and from one row per
(key, span). Nothing is counted beforehand and no job runs before the result is
asked for. A task holds one bucket of a key: with micros and the default width
72 minutes of it, with integers 4096 values, with decimals 1/4096 of a factor e.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
_KEY, _BUCKET, _SPAN = "_slice_key", "_slice_bucket", "_slice_span"

#: Low bits of a position inside one bucket: 2^32 micros are 72 minutes. The width changes tasks, never results.
TIME_BITS, VALUE_BITS = 32, 12
SPAN_BITS = 10

#: Rows of one key that a window with a short reach sees at a time.
BLOCK_ROWS = 1_000_000


def position_bits(df: DataFrame, name: str) -> int:
    """The bucket width for positions along a column: time in micros, or plain values."""
    return TIME_BITS if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)) else VALUE_BITS


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named keys in which NULL matches NULL, as grouping does; keeps the left keys."""
    theirs = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(theirs, condition, how).drop(*[f"_r_{c}" for c in keys])


def _bucketed(df: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """The rows with their key as one struct (in which NULL equals NULL), bucket and span; both grow with ``_pos``."""
    kind = df.schema[POS].dataType
    at = F.col(POS)
    if isinstance(kind, T.IntegralType):
        bucket = F.shiftright(at.cast("long"), bits)
    else:
        size = F.signum(at.cast("double")) * F.asinh(F.abs(at.cast("double")) * 1e6)
        bucket = F.floor(size * float(1 << bits))
    # a NULL position sorts first, and so does its bucket
    rows = df.withColumns({_KEY: F.struct(*by), _BUCKET: F.coalesce(bucket.cast("long"), F.lit(-(1 << 63)).cast("long"))})
    return rows.withColumn(_SPAN, F.shiftright(_BUCKET, SPAN_BITS))


def _earlier(partition: Sequence[str], step: Column):
    return Window.partitionBy(*partition).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, by: Sequence[str], sums: dict[str, str], descending: bool = False, bits: int = VALUE_BITS, order: Sequence[Column] = ()
) -> DataFrame:
    """Inclusive running sums ``{new: source}`` along ``_pos``; rows are unique per (key, ``_pos``), or by ``order``."""
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = _bucketed(df, by, bits)
    frame = Window.partitionBy(_KEY, _BUCKET).orderBy(*(order or [way(POS)])).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({new: F.sum(src).over(frame) for new, src in sums.items()})
    buckets = rows.groupBy(_KEY, _BUCKET, _SPAN).agg(*[F.sum(src).alias(f"_sum_{new}") for new, src in sums.items()])
    spans = buckets.groupBy(_KEY, _SPAN).agg(*[F.sum(f"_sum_{new}").alias(f"_sum_{new}") for new in sums])
    of_span = spans.select(_KEY, _SPAN, *[F.sum(f"_sum_{new}").over(_earlier([_KEY], way(_SPAN))).alias(f"_far_{new}") for new in sums])
    of_bucket = buckets.select(_KEY, _SPAN, _BUCKET, *[F.sum(f"_sum_{new}").over(_earlier([_KEY, _SPAN], way(_BUCKET))).alias(f"_near_{new}") for new in sums])
    before = of_bucket.join(of_span, [_KEY, _SPAN]).drop(_SPAN)
    zero = F.lit(0)
    total = {new: F.col(new) + F.coalesce(F.col(f"_near_{new}"), zero) + F.coalesce(F.col(f"_far_{new}"), zero) for new in sums}
    return local.join(before, [_KEY, _BUCKET]).withColumns(total).select(*df.columns, *sums)


def last_known(rows: DataFrame, by: Sequence[str], order: Sequence[Column], payload: str, bits: int = VALUE_BITS) -> DataFrame:
    """Replace ``payload`` by its last non-NULL value at or before each row.

    ``rows`` carries ``_pos``, not NULL, and ``order`` is led by it; a (key,
    ``_pos``) has a bounded number of rows.
    """
    placed = _bucketed(rows, by, bits)
    frame = Window.partitionBy(_KEY, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn(payload, F.last(payload, ignorenulls=True).over(frame))
    known = F.col(payload).isNotNull()
    buckets = placed.groupBy(_KEY, _BUCKET, _SPAN).agg(F.max_by(payload, F.when(known, F.struct(*order))).alias(payload))
    spans = buckets.groupBy(_KEY, _SPAN).agg(F.max_by(payload, F.when(known, F.col(_BUCKET))).alias(payload))
    of_span = spans.select(_KEY, _SPAN, F.last(payload, ignorenulls=True).over(_earlier([_KEY], F.col(_SPAN))).alias("_far"))
    of_bucket = buckets.select(_KEY, _SPAN, _BUCKET, F.last(payload, ignorenulls=True).over(_earlier([_KEY, _SPAN], F.col(_BUCKET))).alias("_near"))
    before = of_bucket.join(of_span, [_KEY, _SPAN]).select(_KEY, _BUCKET, F.coalesce("_near", "_far").alias("_before"))
    return local.join(before, [_KEY, _BUCKET]).withColumn(payload, F.coalesce(payload, "_before")).select(*rows.columns)


def last_and_next(rows: DataFrame, by: Sequence[str], order: Sequence[Column], payload: str, bits: int = VALUE_BITS) -> DataFrame:
    """``payload``'s last non-NULL value at or before each row as ``_last``, and its first at or after it as ``_next``.

    As :func:`last_known`, with both ways carried by one pass over the rows;
    ``order`` holds plain columns, each sorted upwards.
    """
    placed = _bucketed(rows, by, bits)
    # a frame that ends at the last row is summed up anew for every row; the opposite order's running frame is not
    so_far = lambda *way: Window.partitionBy(_KEY, _BUCKET).orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)
    known_by = F.last(payload, ignorenulls=True)
    local = placed.withColumns({"_last": known_by.over(so_far(*order)), "_next": known_by.over(so_far(*[c.desc() for c in order]))})
    known = F.col(payload).isNotNull()
    ends = lambda at: [F.max_by("_last", F.when(F.col("_last").isNotNull(), at)).alias("_last"), F.min_by("_next", F.when(F.col("_next").isNotNull(), at)).alias("_next")]
    at = F.when(known, F.struct(*order))
    buckets = placed.groupBy(_KEY, _BUCKET, _SPAN).agg(F.max_by(payload, at).alias("_last"), F.min_by(payload, at).alias("_next"))
    spans = buckets.groupBy(_KEY, _SPAN).agg(*ends(F.col(_BUCKET)))

    def beside(partition: Sequence[str], step: str, names: tuple[str, str]) -> list[Column]:
        before, after = _earlier(partition, F.col(step)), _earlier(partition, F.col(step).desc())
        return [F.last("_last", ignorenulls=True).over(before).alias(names[0]), F.last("_next", ignorenulls=True).over(after).alias(names[1])]

    of_span = spans.select(_KEY, _SPAN, *beside([_KEY], _SPAN, ("_far_last", "_far_next")))
    of_bucket = buckets.select(_KEY, _SPAN, _BUCKET, *beside([_KEY, _SPAN], _BUCKET, ("_near_last", "_near_next")))
    around = of_bucket.join(of_span, [_KEY, _SPAN]).drop(_SPAN)
    both = {w: F.coalesce(w, f"_near{w}", f"_far{w}") for w in ("_last", "_next")}
    return local.join(around, [_KEY, _BUCKET]).withColumns(both).select(*rows.columns, "_last", "_next")


def over_order(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    build: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    bits: int = VALUE_BITS,
    block_rows: int = BLOCK_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``df`` carries ``_pos``; ``order`` is the full row order, led by ``_pos``
    and unique within a key. ``build`` maps a window to the columns to add.
    Every row gets its rank within its key, ranks are cut into blocks, and the
    rows at a block's edges visit the next block. ``bounded`` states that no
    key can outgrow a task, as in a daily series; then one window does.
    """
    if bounded:
        return df.withColumns(build(Window.partitionBy(*by).orderBy(*order)))
    ranked = running_sum(df.withColumn("_one", F.lit(1)), by, {"_rank": "_one"}, bits=bits, order=order).drop("_one")
    at, block = F.col("_rank") - 1, F.floor((F.col("_rank") - 1) / block_rows)
    targets = F.array_compact(F.array(
        block,
        F.when(at % block_rows >= block_rows - before, block + 1),
        F.when(at % block_rows < after, block - 1),
    ))
    whole = ranked.withColumns({"_home": block, "_block": F.explode(targets), _KEY: F.struct(*by)})
    window = Window.partitionBy(_KEY, "_block").orderBy("_rank")
    return whole.withColumns(build(window)).filter("_home = _block").drop("_home", "_block", "_rank", _KEY)
