"""Shapes in which field data lands: sheets, service answers, printed calendars, and lists of what to request."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envspark.functions.times import at_time
from envspark.operators.project import across, clean_names
from envspark.sources.schemas import CALENDAR_COLUMNS, TIDE_RESPONSE


def normalise_sheet(
    df: DataFrame, names: Sequence[str] | None = None, key: int | str = 0, unit_row: Column | None = None
) -> DataFrame:
    """A sheet as landed → named columns and filled rows.

    Columns whose header does not start with a letter are unnamed cells of the
    sheet and are dropped. ``names`` renames by position, otherwise headers
    become snake case. Rows without the key column are empty rows;
    ``unit_row`` recognises a row of units under the header by its content.
    """
    if names:
        df = df.toDF(*names)
    else:
        df = clean_names(df.select(*[F.col(f"`{c}`") for c in df.columns if re.match(r"[A-Za-z0-9]", c) and not re.match(r"_c\d+$", c)]))
    key = df.columns[key] if isinstance(key, int) else key
    df = df.filter(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return df if unit_row is None else df.filter(~F.coalesce(unit_row, F.lit(False)))


def explode_predictions(df: DataFrame, json_col: str, station_col: str, schema: str = TIDE_RESPONSE) -> DataFrame:
    """Service answers → one row per predicted turning point, under the station that was asked for.

    An ``error`` member marks an answer that was filled from a stand-in station.
    """
    answer = F.from_json(json_col, schema)
    rows = df.select(
        F.col(station_col).alias("tide_noaa_id"), answer["error"].isNull().alias("good_tide_station"), answer["predictions"].alias("_p")
    ).select("tide_noaa_id", "good_tide_station", F.inline("_p").alias("_t", "_v", "hi_lo"))
    when = F.col("_t").try_cast("timestamp")
    return rows.select(
        F.to_date(when).alias("date"),
        when.alias("datetime"),
        "tide_noaa_id",
        F.col("_v").try_cast("double").alias("tide_level"),
        "hi_lo",
        "good_tide_station",
    )


def request_grid(items: DataFrame, start, end, floor_year: int | None = None) -> DataFrame:
    """One row per item and year to request, from ``start`` (not before ``floor_year``) to ``end``.

    ``start`` and ``end`` are years or names of year columns.
    """
    year = lambda y: F.col(y) if isinstance(y, str) else F.lit(y)
    first = year(start) if floor_year is None else F.greatest(year(start), F.lit(floor_year))
    spans = items.withColumns({"_from": first.cast("int"), "_to": year(end).cast("int")}).filter("_from <= _to")
    return spans.withColumn("year", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def calendar_to_events(df: DataFrame, year_month: str) -> DataFrame:
    """A wide monthly hi-lo calendar → one row per turning point: date, datetime, tide_level, hi_lo.

    ``year_month`` names a ``yyyy-MM`` column. Day numbers a month does not have
    give no date and drop out; so do empty cells.
    """
    day = F.concat_ws("-", F.col(year_month), F.trim("daynum")).try_cast("date")
    dated = df.withColumn("date", day).filter(F.col("date").isNotNull())
    dated = across(dated, [c for c in CALENDAR_COLUMNS if c.endswith("_ft")], lambda c: c.try_cast("double"))
    cells = [
        F.struct(
            F.lit("H" if tide == "high" else "L").alias("hi_lo"),
            F.lit(half.upper()).alias("half"),
            F.col(f"{tide}_tide_{half}_time").alias("clock"),
            F.col(f"{tide}_tide_{half}_ft").alias("tide_level"),
        )
        for tide in ("high", "low")
        for half in ("am", "pm")
    ]
    keep = [c for c in df.columns if c not in CALENDAR_COLUMNS and c != year_month]
    long = dated.select(*keep, "date", F.inline(F.array(*cells)))
    stamp = at_time("date", F.concat_ws(" ", F.trim("clock"), F.col("half")))
    return long.withColumn("datetime", stamp).filter(F.col("datetime").isNotNull()).select(*keep, "date", "datetime", "tide_level", "hi_lo")
