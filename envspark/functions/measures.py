"""Numeric measures: unit conversion, classes, bins, row-wise and rolling sums."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# The sixteen compass points, clockwise from north.
COMPASS_POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]

# Enterococci and fecal coliform class limits, and the four-step dashboard scale.
ENTEROCOCCI_BREAKS = [-1, 34, 104, float("inf")]
FECAL_BREAKS = [-1, 200, 1000, float("inf")]
QUALITY_LEVELS = ["Safe", "Caution", "Unsafe"]
DASHBOARD_BREAKS = [-1, 0, 35, 104, 49999]
DASHBOARD_LEVELS = ["NotDetected", "Good", "Fair", "Unacceptable"]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def c_to_f(t) -> Column:
    return _col(t) * 9 / 5 + 32


def mid_tenths(tmin, tmax) -> Column:
    """Midpoint in °C of a minimum and maximum given in tenths of a degree."""
    return (_col(tmin) + _col(tmax)) / 20


def mm_to_in(x, factor: float = 0.039, scale: float = 1.0) -> Column:
    """Millimetres to inches; ``scale=10`` (or 100) takes tenths (hundredths) of a millimetre."""
    return _col(x) / F.lit(float(scale)) * F.lit(factor)


def current_index(hours, tide_range, duration) -> Column:
    """Sine-shaped current between two turning points: positive flooding, negative ebbing."""
    return _col(tide_range) * F.sin(F.pi() * F.try_divide(_col(hours), _col(duration)))


def compass16(degrees) -> Column:
    """Sixteen-point compass name; sectors are 22.5° wide and centred on the points. Below 0 and from 360 on is N."""
    d = _col(degrees)
    sector = F.when(d < 0, F.lit(0)).when(d >= 360, F.lit(0)).otherwise(F.floor((d + 11.25) / 22.5).cast("int") % 16)
    # get, not element_at: under ANSI the latter takes a NULL index into an all-literal array for an ordinary one
    return F.get(F.array(*[F.lit(p) for p in COMPASS_POINTS]), sector)


def direction(x) -> Column:
    """A direction given as degrees or as text: degrees become compass points, text is kept."""
    x = _col(x)
    return F.coalesce(compass16(x.try_cast("double")), x)


def cut(x, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Class label of the right-closed interval ``(lo, hi]`` holding x; NULL outside all intervals."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("cut needs one label per interval")
    x = _col(x)

    def within(lo, hi):
        above = F.lit(True) if lo == float("-inf") else x > F.lit(float(lo))
        below = F.lit(True) if hi == float("inf") else x <= F.lit(float(hi))
        return above & below & x.isNotNull() & ~F.isnan(x.cast("double"))

    steps = zip(breaks[:-1], breaks[1:], labels)
    first = next(steps)
    chain = F.when(within(first[0], first[1]), F.lit(first[2]))
    for lo, hi, label in steps:
        chain = chain.when(within(lo, hi), F.lit(label))
    return chain


def bin_index(x, low, high, n: int) -> Column:
    """1..n for n equal-width right-closed bins over [low, high]; a flat range falls in the middle bin."""
    x, low, high = _col(x), _col(low), _col(high)
    raw = F.ceil((x - low) / (high - low) * n)
    clamped = F.least(F.greatest(raw, F.lit(1)), F.lit(n)).cast("int")
    return F.when(x.isNotNull() & (high == low), F.lit((n + 1) // 2)).when(x.isNotNull(), clamped)


def season_index(d) -> Column:
    """1 in January rising to 7 in July and back to 2 in December."""
    return (F.lit(7) - F.abs(F.month(_col(d)) - 7)).cast("int")


def row_sum(*cols) -> Column:
    """Row-wise sum that skips NULL; all NULL gives 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_max(*cols) -> Column:
    """Row-wise maximum that skips NULL; all NULL gives NULL."""
    return F.greatest(*[_col(c) for c in cols])


def finite(x) -> Column:
    """±Inf and NaN become NULL."""
    x = _col(x)
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def log_capped(x, cap: float | None = None, scale: float = 1.0, plus_one: bool = True) -> Column:
    """``ln(x + 1) * scale`` (``ln(x)`` when plus_one is off), capped; the log of a non-positive number is NULL."""
    x = _col(x)
    logged = F.ln(x + 1 if plus_one else x) * F.lit(scale)
    return logged if cap is None else F.when(logged.isNotNull(), F.least(logged, F.lit(float(cap))))


def share(condition) -> Column:
    """Aggregate: fraction of all rows of the group on which the condition holds."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def annualised(x, periods: int) -> Column:
    """Aggregate: mean per period scaled to a year (365 for daily, 52 for weekly values)."""
    return F.avg(_col(x)) * F.lit(periods)


def rolling_sum(x, n: int, window: WindowSpec) -> Column:
    """Sum over the last n rows of an ordered window; NULL while incomplete or when any of them is NULL."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(_col(x)).over(frame) == n, F.sum(_col(x)).over(frame))
