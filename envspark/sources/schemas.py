"""Declared schemas of the tables the engine reads. No schema is inferred."""

from __future__ import annotations

# Column names of the sample sheet, in sheet order.
SAMPLE_SHEET_COLUMNS = [
    "site",
    "site_id",
    "date",
    "year",
    "month",
    "high_tide",
    "sample_time",
    "bacteria",
    "precip_t0",
    "precip_t1",
    "precip_t2",
    "precip_t3",
    "precip_t4",
    "precip_t5",
    "precip_t6",
    "notes",
]

# Column names of the printed hi-lo calendar, in page order.
CALENDAR_COLUMNS = [
    "daynum",
    "day_of_week",
    "high_tide_am_time",
    "high_tide_am_ft",
    "high_tide_pm_time",
    "high_tide_pm_ft",
    "low_tide_am_time",
    "low_tide_am_ft",
    "low_tide_pm_time",
    "low_tide_pm_ft",
]

# Fields of the tide service's answer.
TIDE_RESPONSE = "predictions array<struct<t string, v string, type string>>, error struct<message string>"
