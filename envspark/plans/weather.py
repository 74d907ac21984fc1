"""Weather: widening service rows, what to request, and rain and temperature for every sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import annualised, c_to_f, mid_tenths, mm_to_in
from envspark.functions.text import remove_first
from envspark.operators.joins import fill_from_default, left_join_with_default
from envspark.operators.project import drop_na
from envspark.operators.reshape import densify, expand_days_back, nest, pivot
from envspark.operators.windows import impute_group_mean, lag_sum

DEFAULT_STATION = "USW00094728"  # Central Park
CODES = ["TMIN", "TMAX", "PRCP"]


def widen_weather(long: DataFrame, stations: DataFrame, precip_scale: float = 10.0) -> DataFrame:
    """Service rows (date, station, datatype, value in tenths) → one row per station and day in °F and inches."""
    rows = long.select(
        F.substring(F.col("date").cast("string"), 1, 10).try_cast("date").alias("date"),
        remove_first("station", "GHCND:").alias("ghcn_station_id"),
        "datatype",
        F.col("value").cast("double").alias("value"),
    )
    # of repeated readings the largest counts
    rows = rows.groupBy("date", "ghcn_station_id", "datatype").agg(F.max("value").alias("value"))
    wide = pivot(rows, ["date", "ghcn_station_id"], "datatype", "value", CODES)
    names = stations.groupBy(F.col("id").alias("ghcn_station_id")).agg(F.max("name").alias("ghcn_station_name"))
    return wide.join(names, "ghcn_station_id", "left").select(
        "date",
        "ghcn_station_id",
        "ghcn_station_name",
        c_to_f(mid_tenths("TMIN", "TMAX")).alias("temperature_f"),
        mm_to_in("PRCP", scale=precip_scale).alias("precip_in"),
    )


def _needed(key: DataFrame, samples: DataFrame, stations: DataFrame, key_col: str, element: str) -> DataFrame:
    days = key.select("site_id", key_col).join(samples.select("site_id", "date").distinct(), "site_id", "left")
    pairs = days.select(F.col(key_col).alias("ghcn_station_id"), "date").distinct()
    spans = stations.filter(F.col("element") == element).select(F.col("id").alias("ghcn_station_id"), "first_year", "last_year").distinct()
    reporting = pairs.join(spans, "ghcn_station_id").filter(F.year("date").between(F.col("first_year"), F.col("last_year")))
    return reporting.select("ghcn_station_id", "date")


def needed_weather(key: DataFrame, samples: DataFrame, stations: DataFrame) -> DataFrame:
    """(station, date) pairs to hold: temperature on the sampling day, rain on it and the two days before."""
    warm = _needed(key, samples, stations, "temperature_ghcn_id", "TMAX")
    wet = expand_days_back(_needed(key, samples, stations, "precip_ghcn_id", "PRCP"), "date", 2)
    return warm.unionByName(wet).distinct()


def missing_weather(needed: DataFrame, have: DataFrame) -> DataFrame:
    """What the store lacks, as one request list of stations per date; a list is at most as long as the station table."""
    pairs = needed.join(have.select("ghcn_station_id", "date"), ["date", "ghcn_station_id"], "left_anti").dropna()
    return nest(pairs.select("date", "ghcn_station_id").distinct(), ["date"], "station_ids")


def _linked(samples: DataFrame, key: DataFrame) -> DataFrame:
    keys = drop_na(key.select("site_id", "precip_ghcn_id", "temperature_ghcn_id"))
    return drop_na(samples.select("site", "site_id", "sample_time").join(keys, "site_id", "left").withColumn("date", F.to_date("sample_time")))


def daily_rain(weather: DataFrame) -> DataFrame:
    """Every station on every reported date with rain and the sum of the two reported days before.

    A station is its id, whatever names it went by; of repeated rows of a date
    the one with the most rain counts. One row per station and date makes a
    station at most as long as the calendar.
    """
    facts = weather.groupBy("ghcn_station_id", "date").agg(F.max(F.struct("precip_in", "temperature_f")).alias("_row")).select("ghcn_station_id", "date", "_row.*")
    grid = densify(facts, ["ghcn_station_id"], "date")
    return lag_sum(grid, ["ghcn_station_id"], "date", "precip_in", [1, 2], "precip_in_48", bounded=True)


def rain_for_samples(samples: DataFrame, key: DataFrame, weather: DataFrame, default_station: str = DEFAULT_STATION) -> DataFrame:
    """Gauge rain of every sample's station and date.

    Gaps take the mean over the date's sample rows; where that is missing too,
    station and both values come from the default station.
    """
    daily = daily_rain(weather).select("date", F.col("ghcn_station_id").alias("precip_ghcn_id"), "precip_in", "precip_in_48")
    links = _linked(samples, key).select("date", "precip_ghcn_id", "site", "site_id")
    own = links.join(daily, ["date", "precip_ghcn_id"], "left")
    imputed = impute_group_mean(own, ["date"], ["precip_in", "precip_in_48"])
    return fill_from_default(imputed, daily, ["date"], "precip_ghcn_id", default_station, ["precip_in", "precip_in_48"])


def temperature_for_samples(samples: DataFrame, key: DataFrame, weather: DataFrame, default_station: str = DEFAULT_STATION) -> DataFrame:
    """Temperature of every sample's station and date, or of the default station on that date."""
    daily = weather.groupBy("date", F.col("ghcn_station_id").alias("temperature_ghcn_id")).agg(F.max("temperature_f").alias("temperature_f"))
    links = _linked(samples, key).select("date", "temperature_ghcn_id", "site", "site_id")
    return left_join_with_default(links, daily, ["date", "temperature_ghcn_id"], "temperature_ghcn_id", default_station, ["temperature_f"])


def station_annual_rain(weather: DataFrame, year: int, min_n: int = 200) -> DataFrame:
    """Annualised rain per station in one year, for stations with more than ``min_n`` rows."""
    yearly = weather.filter(F.year("date") == year).groupBy(F.year("date").alias("year"), "ghcn_station_name")
    out = yearly.agg(F.count(F.lit(1)).alias("n"), annualised("precip_in", 365).alias("precip"))
    return drop_na(out).filter(F.col("n") > min_n)
