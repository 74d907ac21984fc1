"""Tides: what to request, appending turning points, and the tide's position at every sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import current_index
from envspark.operators.asof import asof_with_fallback
from envspark.operators.joins import natural_join
from envspark.operators.project import drop_na
from envspark.operators.reshape import append_distinct
from envspark.operators.windows import phase_features
from envspark.streaming.topup import missing_keys

DEFAULT_STATION = "8518750"  # The Battery
MAX_PHASE_HOURS = 8.0


def needed_tides(key: DataFrame, samples: DataFrame) -> DataFrame:
    """The distinct (station, date) pairs some sample needs."""
    days = samples.select("site_id", "date").distinct()
    return natural_join(key.select("site_id", "tide_noaa_id"), days, "left").select("tide_noaa_id", "date").distinct()


def missing_tides(key: DataFrame, samples: DataFrame, tides: DataFrame) -> DataFrame:
    """Needed pairs the store does not hold yet."""
    return missing_keys(needed_tides(key, samples), tides, ["tide_noaa_id", "date"])


def append_tides(store: DataFrame, new: DataFrame) -> DataFrame:
    """New turning points with range and duration of their phase, added to the store once each."""
    featured = phase_features(new, "tide_noaa_id", "datetime", "tide_level", max_hours=MAX_PHASE_HOURS)
    return append_distinct(store, featured, ["tide_noaa_id", "datetime"])


def tide_positions(key: DataFrame, samples: DataFrame, tides: DataFrame, default_station: str = DEFAULT_STATION) -> DataFrame:
    """For every sample the turning point before it, hours since, and the current index.

    A station with no turning point in the last eight hours is replaced by the
    default station and flagged. Of two answers at the same time the station's
    own wins over a stand-in's.
    """
    linked = drop_na(
        samples.select("site", "site_id", "sample_time").join(drop_na(key.select("site_id", "tide_noaa_id")), "site_id", "left")
    )
    found = asof_with_fallback(
        linked,
        tides,
        "tide_noaa_id",
        "sample_time",
        "datetime",
        MAX_PHASE_HOURS,
        default_station,
        "good_tide_station",
        tie_break=[F.col("good_tide_station"), F.col("tide_level")],
        carry=["datetime", "tide_level", "good_tide_station", "tide_range_ft", "tide_duration_hrs"],
    )
    return found.select(
        "site_id",
        "sample_time",
        F.col("datetime").alias("tide_time"),
        "tide_level",
        "good_tide_station",
        F.col("hours_since").alias("hours_since_last"),
        current_index("hours_since", "tide_range_ft", "tide_duration_hrs").alias("current"),
    )
