"""As-of joins: the last (or next) event of the same key around each row's time.

Distinct positions of both sides go into one stream per key, ordered by time,
and the last known event is carried forward through time buckets
(:mod:`envspark.operators.slices`): no pairs of rows, one lazy plan at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions.times import UNITS_PER_HOUR, hours_between, kind_of, position_as
from envspark.operators.slices import POS, TIME_BITS, VALUE_BITS, last_and_next, last_known

_ROW_KEYS = "_key"


def _same_kind(left: DataFrame, left_time: str, right: DataFrame, right_time: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with times of one kind. A date meets a timestamp as its midnight; other mixtures are an error."""
    mine, theirs = kind_of(left, left_time), kind_of(right, right_time)
    if mine == theirs:
        return left, right
    stamps = {"instant": "timestamp", "clock": "timestamp_ntz"}
    if mine == "day" and theirs in stamps:
        return left.withColumn(_AT, F.col(left_time).cast(stamps[theirs])), right.withColumn(_AT, F.col(right_time))
    if theirs == "day" and mine in stamps:
        return left.withColumn(_AT, F.col(left_time)), right.withColumn(_AT, F.col(right_time).cast(stamps[mine]))
    raise TypeError(f"{left_time} ({mine}) and {right_time} ({theirs}) are times of different kinds; cast one of them")


_AT = "_asof_at"


def _positions(left: DataFrame, left_time: str, right: DataFrame, right_time: str) -> tuple[Column, Column, str]:
    """Comparable positions of both sides, and their kind."""
    both = _same_kind(left, left_time, right, right_time)
    mine = _AT if _AT in both[0].columns else left_time
    theirs = _AT if _AT in both[1].columns else right_time
    kind = kind_of(both[0], mine)
    cast = {"instant": "timestamp", "clock": "timestamp_ntz"}.get(kind)

    def at(df: DataFrame, name: str, source: str) -> Column:
        return position_as(F.col(source).cast(cast) if cast else F.col(source), df.schema[name].dataType)

    return at(both[0], mine, left_time), at(both[1], theirs, right_time), kind


def _asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[tuple[str, str]],
    left_pos: Column,
    right_pos: Column,
    bits: int,
    strict: bool,
    tie_break: Sequence[Column],
    carry: Sequence[str],
    forward: bool,
) -> DataFrame:
    """Left rows with the struct ``_event`` found for them.

    Distinct (key, position) pairs are looked up once and joined back to their
    rows, and of the events at one position only the one that wins the tie
    goes into the stream, so rows at one single time cannot pile up in a task.
    """
    keys = [f"{_ROW_KEYS}{i}" for i in range(len(by))] or [f"{_ROW_KEYS}all"]
    sign = -1 if forward else 1
    mine = {k: F.col(l) for k, (l, _) in zip(keys, by)} or {keys[0]: F.lit(0)}
    theirs = {k: F.col(r) for k, (_, r) in zip(keys, by)} or {keys[0]: F.lit(0)}
    rows = left.withColumns(mine | {POS: left_pos * sign})
    found = _looked_up(rows.select(*keys, POS), _events(right, theirs, right_pos * sign, tie_break, carry), keys, strict, bits)
    return rows.join(found, [*keys, POS], "left").select(*left.columns, "_event")


def _known(keys: Sequence[str]) -> str:
    return " and ".join(f"{k} is not null" for k in (*keys, POS))


def _events(right: DataFrame, keys: dict[str, Column], at: Column, tie_break: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """One event per key and position, the one that wins the tie."""
    tie = F.struct(*tie_break) if tie_break else F.struct(F.lit(0).alias("t"))
    events = right.select(*[c.alias(k) for k, c in keys.items()], at.alias(POS), F.struct(tie.alias("tie"), F.struct(*carry).alias("row")).alias("_event"))
    return events.filter(_known(list(keys))).groupBy(*keys, POS).agg(F.max("_event")["row"].alias("_event"))


def _looked_up(wanted: DataFrame, events: DataFrame, keys: Sequence[str], strict: bool, bits: int) -> DataFrame:
    """The distinct wanted (key, position) pairs with the last event before them (at or before, unless ``strict``)."""
    # at equal positions a strict join must not see the event, so the event sorts after the row
    row_first, event_first = (0, 1) if strict else (1, 0)
    pairs = wanted.filter(_known(keys)).distinct().withColumn("_kind", F.lit(row_first))
    stream = pairs.unionByName(events.withColumn("_kind", F.lit(event_first)), allowMissingColumns=True)
    return last_known(stream, keys, [F.col(POS), F.col("_kind")], "_event", bits).filter(F.col("_kind") == row_first).drop("_kind")


def _pairs(by) -> list[tuple[str, str]]:
    if isinstance(by, str):
        by = [by]
    return [b if isinstance(b, tuple) else (b, b) for b in by]


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by,
    left_time: str,
    right_time: str,
    strict: bool = True,
    tie_break: Sequence[Column] = (),
    carry: Sequence[str] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Every left row with the latest right event of its key before its time (at or before, unless ``strict``).

    ``by`` holds key names, or (left, right) pairs. Times are of one kind on
    both sides (a date meets a timestamp as its midnight). Of events at the same time
    the one sorting last by ``tie_break`` is taken. ``carry`` names the right
    columns to add; unmatched rows carry NULL.
    """
    pairs = _pairs(by)
    carry = list(carry or [c for c in right.columns if c not in {r for _, r in pairs}])
    at, event_at, kind = _positions(left, left_time, right, right_time)
    found = _asof(left, right, pairs, at, event_at, _bits(kind, bits), strict, tie_break, carry, False)
    return found.select(*left.columns, *[F.col("_event")[c].alias(c) for c in carry])


def _bits(kind: str, bits: int | None) -> int:
    return bits if bits is not None else TIME_BITS if kind in ("instant", "clock") else VALUE_BITS


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by,
    left_time: str,
    right_time: str,
    strict: bool = True,
    tie_break: Sequence[Column] = (),
    carry: Sequence[str] | None = None,
    offset_hours: float = 0.0,
    bits: int | None = None,
) -> DataFrame:
    """The earliest right event after (at or after, unless ``strict``) the left time plus ``offset_hours``.

    ``offset_hours=-6`` finds the first event later than six hours before the row.
    """
    pairs = _pairs(by)
    carry = list(carry or [c for c in right.columns if c not in {r for _, r in pairs}])
    at, event_at, kind = _positions(left, left_time, right, right_time)
    if offset_hours:
        if kind not in UNITS_PER_HOUR:
            raise TypeError(f"{left_time}: a plain number has no hours to move it by")
        step = offset_hours * UNITS_PER_HOUR[kind]
        if step != int(step):
            raise ValueError(f"{offset_hours} hours are no whole number of days, and {left_time} is a date")
        at = at + F.lit(int(step))
    found = _asof(left, right, pairs, at, event_at, _bits(kind, bits), strict, tie_break, carry, True)
    return found.select(*left.columns, *[F.col("_event")[c].alias(c) for c in carry])


def asof_with_fallback(
    left: DataFrame,
    right: DataFrame,
    by,
    left_time: str,
    right_time: str,
    max_gap_hours: float,
    fallback_key,
    flag: str,
    tie_break: Sequence[Column] = (),
    carry: Sequence[str] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Backward as-of; rows with no event within ``max_gap_hours`` take the fallback key's event and ``flag`` false.

    Positions are wanted of the own and of the fallback key, and looked up in one
    pass over one stream. Adds ``hours_since``. The flag column comes from the event where the own key
    served the row.
    """
    (pair,) = _pairs(by)
    carry = list(carry or [c for c in right.columns if c != pair[1]])
    if flag not in carry:
        raise ValueError(f"the events carry no column {flag}")
    if right_time not in carry:
        carry = [*carry, right_time]
    at, event_at, kind = _positions(left, left_time, right, right_time)
    if kind not in UNITS_PER_HOUR:
        raise TypeError(f"{left_time}: a plain number has no hours")
    key = f"{_ROW_KEYS}0"
    spare_key = F.lit(fallback_key).cast(left.schema[pair[0]].dataType)
    rows = left.withColumns({key: F.col(pair[0]), POS: at})
    wanted = rows.select(F.explode(F.array(key, spare_key)).alias(key), POS)
    found = _looked_up(wanted, _events(right, {key: F.col(pair[1])}, event_at, tie_break, carry), [key], True, _bits(kind, bits))
    own = found.withColumnRenamed("_event", "_own")
    default = found.filter(F.col(key) == spare_key).select(POS, "_event")
    both = rows.join(own, [key, POS], "left").join(default, POS, "left")

    def gap(event: str) -> Column:
        return hours_between(F.col(left_time), F.col(event)[right_time])

    served = F.coalesce(gap("_own") <= max_gap_hours, F.lit(False))
    spare = {c: F.when(F.col("_event").isNotNull(), F.lit(False)) if c == flag else F.col("_event")[c] for c in carry}
    values = [F.when(served, F.col("_own")[c]).otherwise(spare[c]).alias(c) for c in carry]
    return both.select(*left.columns, *values, F.when(served, gap("_own")).otherwise(gap("_event")).alias("hours_since"))


def _distance(df: DataFrame, high: str, low: str) -> Column:
    return position_as(F.col(high), df.schema[high].dataType) - position_as(F.col(low), df.schema[low].dataType)


def nearest_value(left: DataFrame, right: DataFrame, left_col: str, right_col: str, name: str, bits: int | None = None) -> DataFrame:
    """The value of ``right`` closest to each left value; of two equally close ones the smaller."""
    wanted = left.select(left_col).filter(F.col(left_col).isNotNull()).distinct()
    values = right.select(F.col(right_col).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    at, value_at, kind = _positions(wanted, left_col, values, "_v")
    all_of = F.lit(0).alias(f"{_ROW_KEYS}all")
    # a value at a row's own position sorts before the row: it is the last one there, at no distance
    stream = wanted.select(F.col(left_col), all_of, at.alias(POS), F.lit(1).alias("_kind")).unionByName(values.select(all_of, value_at.alias(POS), F.lit(0).alias("_kind"), F.struct("_v").alias("_event")), allowMissingColumns=True)
    found = last_and_next(stream, [f"{_ROW_KEYS}all"], [F.col(POS), F.col("_kind")], "_event", _bits(kind, bits)).filter("_kind = 1")
    both = found.select(left_col, F.col("_last._v").alias("_below"), F.col("_next._v").alias("_above"))
    down, up = _distance(both, left_col, "_below"), _distance(both, "_above", left_col)
    pick = F.when(F.col("_above").isNull() | (down <= up), F.col("_below")).otherwise(F.col("_above"))
    return left.join(both.select(left_col, pick.alias(name)), left_col, "left")


def next_value(left: DataFrame, right: DataFrame, left_col: str, right_col: str, name: str, bits: int | None = None) -> DataFrame:
    """The smallest value of ``right`` that is not below each left value; NULL past the last one."""
    wanted = left.select(left_col).filter(F.col(left_col).isNotNull()).distinct()
    values = right.select(F.col(right_col).alias(name)).filter(F.col(name).isNotNull()).distinct()
    found = asof_forward(wanted, values, [], left_col, name, strict=False, bits=bits)
    return left.join(found, left_col, "left")
