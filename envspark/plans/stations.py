"""Stations: the list with areas, the nearest ones to every site, those in use, and conflicts between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.operators.joins import compare_assignments
from envspark.operators.spatial import nearest, nearest_to_spots
from envspark.operators.project import cols_like
from envspark.operators.reshape import tagged_union
from envspark.operators.windows import section_fill


def station_list(listing: DataFrame, row: str = "row_id") -> DataFrame:
    """The printed station list, where a row without id is an area heading → stations with their area."""
    heading = F.coalesce(F.trim("Id"), F.lit("")) == ""
    filled = section_fill(listing, row, heading, F.col("Name"), "area")
    return filled.select(
        "area", F.col("Name").alias("name"), F.col("Id").alias("id"), F.col("Lat").alias("latitude"), F.col("Lon").alias("longitude"), "Predictions"
    )


def station_key(sites: DataFrame, tide_stations: DataFrame, weather_stations: DataFrame, as_of_year: int) -> DataFrame:
    """Nearest tide, temperature and rain station of every site; weather stations must still report."""
    reporting = weather_stations.filter(F.col("last_year") == as_of_year)
    sources = {
        "tide_noaa": tide_stations,
        "temperature_ghcn": reporting.filter("element = 'TMAX'"),
        "precip_ghcn": reporting.filter("element = 'PRCP'"),
    }
    spots = sites.select("latitude", "longitude").dropna().distinct()
    keyed = sites
    for label, stations in sources.items():
        keyed = keyed.join(nearest_to_spots(spots, stations, label), ["latitude", "longitude"], "left")
    picked = [c for p in ("tide", "temperature", "precip") for c in cols_like(keyed, prefix=p)]
    return keyed.select("site", "site_id", *picked)


def stations_in_use(stations: DataFrame, key: DataFrame, key_col: str) -> DataFrame:
    """The stations some site is linked to, with their id named as in the key."""
    return stations.withColumnRenamed("id", key_col).join(key.select(key_col), key_col, "left_semi")


def assignment_conflicts(key: DataFrame, sites: DataFrame) -> DataFrame:
    """Computed station links next to the ones noted by hand, with agreement flags."""
    ours = key.select("site", "site_id", "tide_noaa_id", "precip_ghcn_id")
    noted = sites.select("site_id", "water_body", "borough_state", "harmonic_noaa_tide_stations", "noaa_rainfall_stations_id")
    pairs = {
        "tides_agree": ("tide_noaa_id", "harmonic_noaa_tide_stations"),
        "precip_agree": ("precip_ghcn_id", "noaa_rainfall_stations_id"),
    }
    return compare_assignments(ours, noted, ["site_id"], pairs)


def network_pairs(ours: DataFrame, theirs: DataFrame, since_year: int) -> DataFrame:
    """Each active site of one network with the nearest recently sampled station of the other, farthest pairs first.

    The pairing goes through the nested grids of :func:`nearest`; no table of all pairs is made.
    """
    recent = theirs.filter(F.year("last_sample_date") > since_year)
    active = ours.filter("currently_testing")
    pairs = nearest(active, recent, "dep", id="sampling_location", right_lat="lat", right_lon="long")
    pairs = pairs.withColumnsRenamed({"dep_id": "sampling_location", "dep_dist_km": "dist"})
    return pairs.join(theirs, "sampling_location", "left").orderBy(F.desc("dist"), "site_id")


def network_sites(ours: DataFrame, theirs: DataFrame, since_year: int, names: tuple[str, str], east_limit: float = -69.0) -> DataFrame:
    """Both networks' current sites in one layout with their source; nameless or misplaced ones are left out."""
    recent = theirs.filter(F.year("last_sample_date") > since_year).select(
        F.col("sampling_location").alias("site_id"), F.col("station_name").alias("site"), F.col("lat").alias("latitude"), F.col("long").alias("longitude")
    )
    active = ours.filter("currently_testing").select("site_id", "site", "latitude", "longitude")
    both = tagged_union({names[0]: active, names[1]: recent})
    return both.filter(F.col("site").isNotNull() & (F.col("longitude") < east_limit))
