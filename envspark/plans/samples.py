"""Cleaning the sample and site sheets, model features, and the assembled model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envspark.functions.measures import ENTEROCOCCI_BREAKS, QUALITY_LEVELS, cut, row_sum, season_index
from envspark.functions.text import parse_censored, replace_first
from envspark.functions.times import at_second, at_time, day_name, hours_between, seconds_of_day
from envspark.operators.project import across, cols_like, cols_of_type, drop_na, fix_sign, place, with_levels
from envspark.operators.reshape import unpivot_year
from envspark.sources.landing import normalise_sheet
from envspark.sources.schemas import SAMPLE_SHEET_COLUMNS

PRECIP = [f"precip_t{i}" for i in range(7)]
PLACE_LEVELS = ["water_body", "neighborhood_town", "nys_dec_water_body_classification", "nyc_dep_wrrf_or_sewershed"]

# Misspelt site names of the sheet and their corrections.
SITE_TYPOS = {"Daylighted Section": "daylighted section", "Govenors": "Governors"}

# New York State water body classes, best use first.
WATER_CLASS_LEVELS = ["A", "AA", "A-S", "AA-S", "B", "C", "D", "SA", "SB", "SC", "I", "SD"]


def clean_samples(raw: DataFrame) -> DataFrame:
    """The landed sample sheet (all text, sheet column order) → typed samples with day name, 48 h rain and class.

    An absent sampling time becomes the mean time of day of the whole sheet.
    Only measures lose their bracketed remarks; names keep them.
    """
    df = normalise_sheet(raw, SAMPLE_SHEET_COLUMNS, key="site")
    df = df.withColumns(
        {
            "date": F.substring("date", 1, 10).try_cast("date"),
            "year": F.col("year").try_cast("int"),
            "month": F.col("month").try_cast("int"),
            "_at": seconds_of_day("sample_time"),
        }
    )
    mean_time = df.agg(F.avg("_at")).scalar()
    site = F.col("site")
    for wrong, right in SITE_TYPOS.items():
        site = replace_first(site, wrong, right)
    df = df.withColumns(
        {
            "site": F.nullif(site, F.lit("N/A")),
            "sample_time": at_second("date", F.round(F.coalesce("_at", mean_time))),
            "high_tide": at_time("date", "high_tide"),
            "sample_day": day_name("date"),
            "notes": F.coalesce(F.nullif("notes", F.lit("N/A")), F.lit("")),
        }
    ).drop("_at")
    df = across(df, ["bacteria", *PRECIP], parse_censored)
    df = df.withColumn("precip_48", row_sum("precip_t1", "precip_t2"))
    df = df.withColumn("quality", cut("bacteria", ENTEROCOCCI_BREAKS, QUALITY_LEVELS))
    return place(place(df, "precip_48", after="bacteria"), "sample_day", before="bacteria")


def clean_sites(raw: DataFrame, site_column: str, elsewhere: str = "NJ") -> DataFrame:
    """The landed site sheet → snake-case site table.

    Longitudes are western, a filled ``currently_testing`` cell means yes,
    ``N/A`` is NULL, and sites outside the state's district, sewershed and
    class systems carry ``elsewhere`` in them.
    """
    df = normalise_sheet(raw, key=site_column).withColumnRenamed(site_column, "site")
    renamed = {c: "nyc_dep_wrrf_or_sewershed" for c in cols_like(df, prefix="associated")}
    df = df.withColumnsRenamed(renamed)
    df = across(df, [c for c in cols_of_type(df, "string") if c != "currently_testing"], lambda c: F.nullif(F.trim(c), F.lit("N/A")))
    numeric = [c for c in ("latitude", "longitude") if c in df.columns]
    df = across(df, numeric, lambda c: c.try_cast("double"))
    df = fix_sign(df, "longitude")
    df = df.withColumn("currently_testing", F.col("currently_testing").isNotNull())
    outside = [c for c in ("district_council_number", "nyc_dep_wrrf_or_sewershed", "nys_dec_water_body_classification") if c in df.columns]
    return across(df, outside, lambda c: F.coalesce(c, F.lit(elsewhere)))


def site_levels(sites: DataFrame, cols: Sequence[str] = ("nys_dec_water_body_classification",), levels: Sequence[str] = WATER_CLASS_LEVELS) -> DataFrame:
    """Categorical site columns with a level for missing values and the level's position."""
    for c in cols:
        sites = with_levels(sites, c, levels)
    return sites


def lab_by_year(sites: DataFrame) -> DataFrame:
    """Which laboratory analysed a site's samples in each year: (site_id, year, lab)."""
    labs = cols_like(sites, contains="lab_analysis")
    texts = across(sites.select("site_id", *labs), labs, lambda c: F.nullif(c.cast("string"), F.lit("NA")))
    return unpivot_year(texts, ["site_id"], r"\d{4}.*lab_analysis", "lab")


def sample_features(samples: DataFrame, sites: DataFrame, labs: DataFrame | None = None) -> DataFrame:
    """Model features: three rain sums, hours from high tide, season, place categories and the year's laboratory.

    Rows with anything still missing are dropped.
    """
    df = samples.withColumns(
        {
            "precip_week": row_sum(*PRECIP),
            "precip_48": row_sum("precip_t1", "precip_t2"),
            "precip_earlier": row_sum("precip_t3", "precip_t4", "precip_t5", "precip_t6"),
            "time_since_high_tide": hours_between("sample_time", "high_tide"),
            "season": season_index("date"),
            "quality": cut("bacteria", ENTEROCOCCI_BREAKS, QUALITY_LEVELS),
        }
    ).drop(*PRECIP[1:])
    places = sites.select(
        "site_id",
        "water_body",
        F.col("nys_dec_water_body_classification").alias("water_class"),
        F.col("nyc_dep_wrrf_or_sewershed").alias("sewershed"),
    )
    places = across(places, ["water_body", "water_class", "sewershed"], lambda c: F.coalesce(c, F.lit("missing")))
    df = df.join(places, "site_id", "left")
    if labs is not None:
        df = df.join(labs, ["site_id", "year"], "left").withColumn("lab", F.coalesce("lab", F.lit("missing")))
    return drop_na(df)


def _once(links: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in links.columns if c not in key]
    return links.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row")).select(*key, "_row.*")


def model_table(samples: DataFrame, sites: DataFrame, tides: DataFrame, temperature: DataFrame, rain: DataFrame, sheet_prefix: str = "sheet_") -> DataFrame:
    """Samples with place, tide position, temperature and gauge rain: one row per sample.

    Tides are linked on (site_id, sample_time), weather on (site_id, date).
    Links of a site's further samples on the same day repeat the same values,
    so each key is taken once and no site-day is multiplied with itself; where
    repeats differ, the row sorting last counts.
    """
    base = samples.select("bacteria", "quality", "site_id", "date", "sample_time", "precip_t0", "precip_t1", "precip_48")
    base = base.withColumnsRenamed({c: f"{sheet_prefix}{c}" for c in ("precip_t0", "precip_t1", "precip_48")})
    places = sites.select("site_id", "site", *[c for c in PLACE_LEVELS if c in sites.columns])
    tide = tides.select("site_id", "sample_time", "tide_level", "hours_since_last", "current")
    warm = temperature.select("site_id", "date", "temperature_f")
    wet = rain.select("site_id", "date", F.col("precip_in").alias("ghcn_precip_in"), F.col("precip_in_48").alias("ghcn_precip_in_48"))
    df = base.join(places, "site_id", "left").join(_once(tide, ["site_id", "sample_time"]), ["site_id", "sample_time"], "left").drop("sample_time")
    for link in (warm, wet):
        df = df.join(_once(link, ["site_id", "date"]), ["site_id", "date"], "left")
    first = ["bacteria", "quality", "site_id", "site", "date"]
    return df.select(*first, *[c for c in df.columns if c not in first])
