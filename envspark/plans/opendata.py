"""The city's open water-quality rows: timestamps, stations, a typed subset, imputation and yearly trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import COMPASS_POINTS, compass16, finite, row_max
from envspark.functions.text import extract, is_in, remove_first
from envspark.functions.times import parse_ts
from envspark.operators.aggregate import first_last
from envspark.operators.project import cols_like, cols_of_type, drop_na, unswap
from envspark.operators.reshape import separate
from envspark.operators.windows import group_extreme, impute_group_mean

# measure → landed column
MEASURES = {
    "sample_temperature_c": "top_sample_temperature_c",
    "salinity_psu": "top_salinity_psu",
    "ph": "top_ph",
    "nutrient_nitrate_mg_l": "top_nitrate_nitrite_mg_l",
    "nutrient_phosphorus_mg_l": "total_phosphorus_mg_l",
    "nutrient_ammonium_mg_l": "top_ammonium_mg_l",
    "bacteria_enterococci_100ml": "top_enterococci_bacteria_cells_100ml",
    "bacteria_fecal_coliform_100ml": "top_fecal_coliform_bacteria_cells_100ml",
}


def with_sample_datetime(raw: DataFrame) -> DataFrame:
    """Date and time text in either clock format → ``sample_datetime``; no readable time means noon."""
    return raw.withColumn("sample_datetime", parse_ts("sample_date", "sample_time"))


def station_names(listing: DataFrame) -> DataFrame:
    """``"CODE Name of the place"`` → sampling_location, station_name."""
    return separate(listing, "Station", ["sampling_location", "station_name"], " ")


def station_metadata(rows: DataFrame, names: DataFrame) -> DataFrame:
    """First and last sampling of every station, its latest known position (swapped pairs put right) and its name."""
    located = rows.select(
        "sampling_location", "sample_datetime", F.col("lat").try_cast("double").alias("lat"), F.col("long").try_cast("double").alias("long")
    )
    out = first_last(located, "sampling_location", "sample_datetime", ["lat", "long"])
    out = unswap(out, "lat", "long", F.col("lat") < F.col("long"))
    return out.withColumnsRenamed(
        {"first_sample_datetime": "first_sample_date", "last_sample_datetime": "last_sample_date"}
    ).join(names, "sampling_location", "left")


def typed_subset(rows: DataFrame) -> DataFrame:
    """Rows with a coliform count, the better-filled measures as numbers, and current speed and direction put right.

    Oxygen is the highest top or bottom reading of the station at that time.
    Speeds sit in the direction column and the other way round, both can share
    one cell (``NE-0.5``), degrees become compass points, words such as slack
    mean no speed, and what is no compass point is ``UNKN``.
    """
    known = rows.filter(F.col(MEASURES["bacteria_fecal_coliform_100ml"]).isNotNull())
    top = F.col("winkler_method_top_dissolved_oxygen_mg_l").try_cast("double")
    bottom = F.col("winkler_method_bottom_dissolved_oxygen_mg_l").try_cast("double")
    known = group_extreme(known, ["sampling_location", "sample_datetime"], "oxygen_mg_l", finite(row_max(top, bottom)))
    df = known.select(
        "sampling_location",
        "sample_datetime",
        F.col("current_direction_current_direction").alias("current_direction"),
        "current_speed_knot",
        "oxygen_mg_l",
        *[F.col(c).try_cast("double").alias(n) for n, c in MEASURES.items()],
    )
    df = unswap(df, "current_speed_knot", "current_direction", is_in("current_speed_knot", COMPASS_POINTS))
    cell = F.col("current_direction")
    speed = F.when(cell.rlike(r"-[0-9.]+"), extract(cell, r"[0-9.]+")).otherwise(F.col("current_speed_knot"))
    point = F.upper(F.coalesce(compass16(cell.try_cast("double")), extract(cell, r"^[A-Za-z]+")))
    return df.withColumns(
        {
            "current_speed_knot": F.coalesce(speed.try_cast("double"), F.lit(0.0)),
            "current_direction": F.when(is_in(point, COMPASS_POINTS), point).otherwise(F.lit("UNKN")),
        }
    )


def impute_by_date(subset: DataFrame) -> DataFrame:
    """Missing measures take the mean over all stations on that date."""
    dated = subset.withColumn("date", F.to_date("sample_datetime"))
    return impute_group_mean(dated, ["date"], cols_of_type(dated, "numeric"))


def nutrient_trend(subset: DataFrame) -> DataFrame:
    """Mean of every nutrient, and oxygen in hundreds, per year."""
    cols = [*cols_like(subset, prefix="nutrient"), "oxygen_mg_l"]
    wide = subset.select(F.year("sample_datetime").alias("year"), *cols).withColumn("oxygen_mg_l", F.col("oxygen_mg_l") / 100)
    long = drop_na(wide.unpivot(["year"], cols, "nutrient", "value"))
    name = remove_first(remove_first("nutrient", "nutrient_"), "_m(?:g|l)_l")
    return long.withColumn("nutrient", name).groupBy("year", "nutrient").agg(F.avg("value").alias("value"))


def bacteria_trend(subset: DataFrame) -> DataFrame:
    """Mean count of every indicator per year, with the number of stations that reported."""
    yearly = subset.withColumn("year", F.year("sample_datetime"))
    stations = yearly.select("year", "sampling_location").distinct().groupBy("year").agg(F.count(F.lit(1)).alias("station_count"))
    cols = cols_like(yearly, contains="bacteria")
    long = drop_na(yearly.select("year", "sampling_location", *cols).unpivot(["year", "sampling_location"], cols, "bacteria", "count"))
    means = long.groupBy("year", remove_first("bacteria", "bacteria_").alias("bacteria")).agg(F.avg("count").alias("bacteria_count"))
    return means.join(stations, "year", "left")
