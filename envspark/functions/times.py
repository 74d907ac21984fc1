"""Dates, instants and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Day names, Sunday first.
DAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_name(d) -> Column:
    return F.get(F.array(*[F.lit(n) for n in DAY_NAMES]), F.dayofweek(_col(d)) - 1)


def position(df: DataFrame, name: str) -> Column:
    """A number that orders rows like the column ``name`` (see :func:`position_as`)."""
    return position_as(F.col(name), df.schema[name].dataType)


def position_as(col: Column, kind: T.DataType) -> Column:
    """A number in the order of a column: microseconds for times, days for dates, the value itself for numbers.

    An instant (TIMESTAMP) counts true elapsed time, a wall clock
    (TIMESTAMP_NTZ) clock time; neither depends on the session zone.
    """
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.TimestampNTZType):
        return _interval_micros(col - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.NumericType):
        return col
    raise TypeError(f"cannot order along {kind.simpleString()}")


def kind_of(df: DataFrame, name: str) -> str:
    """What positions along a column count: days, instants, wall clock or plain values."""
    kind = df.schema[name].dataType
    names = {T.TimestampType: "instant", T.TimestampNTZType: "clock", T.DateType: "day"}
    return names.get(type(kind), "value")


#: Position units in an hour; plain values have none.
UNITS_PER_HOUR = {"instant": 3_600_000_000, "clock": 3_600_000_000, "day": 1 / 24}


def elapsed_hours(df: DataFrame, name: str, later: Column, earlier: Column) -> Column:
    """Elapsed hours between two values of a column like ``name``; of plain values, which have no hours, an error."""
    if kind_of(df, name) == "value":
        raise TypeError(f"{name}: a plain number has no hours")
    return hours_between(later, earlier)


def _interval_micros(gap: Column) -> Column:
    whole = (F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600 + F.extract(F.lit("MINUTE"), gap) * 60)
    return whole.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("long")


def _micros_between(later: Column, earlier: Column) -> Column:
    """Elapsed microseconds. Subtracting timestamps would compare clocks and miss a change of the clock in between."""
    return F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))


def hours_between(later, earlier) -> Column:
    """Signed elapsed hours from ``earlier`` to ``later``; wall clocks (TIMESTAMP_NTZ) are read in the session zone."""
    return _micros_between(_col(later), _col(earlier)) / F.lit(3.6e9)


def hms_text(a, b) -> Column:
    """The absolute gap between two timestamps as ``1H 5M 30S``; hours and zero seconds are left out when absent."""
    seconds = F.floor(F.abs(_micros_between(_col(a), _col(b))) / 1_000_000)
    h = F.floor(seconds / 3600)
    m = F.floor(seconds % 3600 / 60)
    s = seconds % 60
    parts = [
        F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))),
        F.when((h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("M"))),
        F.when((s > 0) | ((h == 0) & (m == 0)), F.concat(s.cast("string"), F.lit("S"))),
    ]
    return F.when(seconds.isNotNull(), F.concat_ws(" ", *parts))


_CLOCK_24 = r"^(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?$"
_CLOCK_12 = r"^(?:0?[1-9]|1[0-2]):[0-5]\d(?::[0-5]\d)? ?[AP]M$"


def clock_24(clock) -> Column:
    """``H:mm[:ss]`` kept, ``h:mm[:ss] AM`` turned into it; NULL for anything else.

    Texts are checked by pattern and then cast: a format parser raises and
    catches an exception for every text it cannot read.
    """
    text = F.upper(F.trim(_col(clock)))
    hour = F.substring_index(text, ":", 1).cast("int") % 12 + F.when(text.endswith("PM"), F.lit(12)).otherwise(F.lit(0))
    rest = F.regexp_extract(text, "(:[0-9:]+)", 1)
    return F.when(text.rlike(_CLOCK_24), text).when(text.rlike(_CLOCK_12), F.concat(hour.cast("string"), rest))


def seconds_of_day(clock) -> Column:
    """Seconds since midnight of clock text; NULL when it is none."""
    at = F.concat(F.lit("1970-01-01 "), clock_24(clock)).try_cast("timestamp_ntz")
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def at_second(d, seconds) -> Column:
    """Timestamp in the session zone of a date and the seconds on its clock."""
    d, s = _col(d), _col(seconds).cast("int")
    return F.make_timestamp(F.year(d), F.month(d), F.day(d), F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)


def at_time(d, clock) -> Column:
    """Date plus clock text → timestamp in the session zone; NULL when either part is missing or malformed."""
    return F.concat(_col(d).cast("string"), F.lit(" "), clock_24(clock)).try_cast("timestamp")


def parse_ts(d, clock, default: str = "12:00") -> Column:
    """Date text (only its first ten characters count) plus clock text; an absent or unreadable clock becomes ``default``."""
    day = F.substring(_col(d).cast("string"), 1, 10)
    return F.concat(day, F.lit(" "), F.coalesce(clock_24(clock), F.lit(default))).try_cast("timestamp")
