"""Site rankings, cohort trends and the dashboard's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import DASHBOARD_BREAKS, DASHBOARD_LEVELS, annualised, cut, log_capped
from envspark.functions.text import thousands
from envspark.functions.times import hms_text
from envspark.operators.aggregate import quartiles, reference_agreement, top_k, trend, whiskers
from envspark.operators.bins import bin_equal
from envspark.operators.joins import cohort
from envspark.operators.quantiles import group_median
from envspark.operators.windows import roll_sum


def ranked_sites(df: DataFrame, site: str, level: str, min_n: int, k: int, cleanest: bool) -> DataFrame:
    """The k cleanest or dirtiest sites by median (ties kept) among those with more than ``min_n`` rows, with their box."""
    boxes = quartiles(df, [site], level).filter(F.col("n_rows") > min_n).drop("n").withColumnRenamed("n_rows", "n_obs")
    return whiskers(df, top_k(boxes, "median", k, ties=True, largest=not cleanest, once=True), [site], level)


def cohort_trend(df: DataFrame, site: str, date: str, level: str, rain: str, min_years: int, since_year: int, periods: int = 52) -> DataFrame:
    """Yearly median level of the sites that reported in at least ``min_years`` years, with all sites' scaled rain."""
    yearly = df.withColumn("year", F.year(date))
    rainfall = yearly.groupBy("year").agg(annualised(rain, periods).alias("annual_rainfall"))
    loyal = cohort(yearly, site, F.col("n_years") >= min_years, F.countDistinct("year").alias("n_years"))
    medians = group_median(loyal.filter(F.col("year") > since_year), ["year"], level, f"median_{level}")
    return medians.join(rainfall, "year", "left").orderBy("year")


def stations_per_year(df: DataFrame, site: str, date: str) -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.countDistinct(site).alias("n"))


def weather_gauges(weather: DataFrame, dates: DataFrame, bins: int = 5) -> DataFrame:
    """Daily gauge values on sampled dates: temperature, seven-day rain, and a colour bin of each (date, temp, rain).

    ``weather`` is one station's series; of repeated rows of a date the one
    with the most rain counts, so the series is at most as long as the calendar.
    """
    daily = weather.groupBy("date").agg(F.max(F.struct("rain", "temp")).alias("_row")).select("date", "_row.*")
    rolled = roll_sum(daily.withColumn("_series", F.lit(0)), ["_series"], "date", "rain", 7, "rain_7d", bounded=True).drop("_series")
    sampled = rolled.join(dates.select("date").distinct(), "date", "left_semi")
    return bin_equal(bin_equal(sampled, "temp", bins), "rain_7d", bins)


def day_view(samples: DataFrame, sites: DataFrame, weather: DataFrame, day) -> DataFrame:
    """The dashboard at a chosen day: samples of the next sampled date with their site, marker, popup and gauges."""
    wanted = F.lit(day).cast("date")
    shown = samples.filter(F.col("date") >= wanted).agg(F.min("date")).scalar()
    rows = samples.filter(F.col("date") == shown).join(sites, "site_id", "left").filter(F.col("latitude").isNotNull())
    popup = F.concat_ws(
        "<br/>",
        F.concat(F.lit("<b> "), F.col("site"), F.lit(" </b>")),
        F.concat_ws(" ", F.lit("Sample Time"), F.date_format("sample_time", "yyyy-MM-dd HH:mm:ss")),
        F.concat_ws(" ", hms_text("high_tide", "sample_time"), F.lit("From High Tide")),
        F.concat_ws(" ", thousands("bacteria"), F.lit("Enterococci Colonies")),
    )
    rows = rows.withColumns({"radius": log_capped("bacteria", scale=100.0, plus_one=False), "popup": popup})
    return rows.join(weather_gauges(weather, samples), "date", "left")


def site_map(samples: DataFrame, sites: DataFrame, level: str = "bacteria") -> DataFrame:
    """Sites under test with their all-time median, its class on the four-step scale, and the marker radius."""
    medians = group_median(samples, ["site_id"], level, f"median_{level}").drop("n")
    placed = sites.filter(F.coalesce("currently_testing", F.lit(False))).join(medians, "site_id", "left")
    classed = placed.withColumns(
        {
            "median_quality": cut(f"median_{level}", DASHBOARD_BREAKS, DASHBOARD_LEVELS),
            "radius": log_capped(f"median_{level}", scale=100.0, plus_one=False),
        }
    )
    return classed.filter(F.col("median_quality").isNotNull())


def rain_agreement(samples: DataFrame, reference: DataFrame, week: str = "precip_week", day: str = "precip_t0") -> DataFrame:
    """Sheet rain by date, averaged over sites, next to the gauge's day and seven-day rain (``rain``, ``rain_7d``)."""
    return reference_agreement(samples, "date", [week, day], reference.select("date", "rain", "rain_7d"))


def rain_trend(agreement: DataFrame, y: str = "precip_t0", x: str = "rain") -> DataFrame:
    """How well the two sources line up: least-squares line of sheet rain on gauge rain."""
    return trend(agreement, [], y, x)


def level_shares(df: DataFrame, by: Sequence[str], condition: Column, name: str) -> DataFrame:
    """Share of each group's rows that meet a condition, largest first."""
    return df.groupBy(*by).agg(F.avg(F.coalesce(condition, F.lit(False)).cast("double")).alias(name)).orderBy(F.desc(name), *by)
