import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from envspark.functions import (
    at_time,
    compass16,
    current_index,
    cut,
    direction,
    extract,
    finite,
    great_circle_km,
    hms_text,
    hours_between,
    if_else,
    is_in,
    parse_censored,
    parse_ts,
    replace_first,
    row_max,
    row_sum,
    season_index,
    seconds_of_day,
)
from envspark.functions.measures import DASHBOARD_BREAKS, DASHBOARD_LEVELS, ENTEROCOCCI_BREAKS, QUALITY_LEVELS


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expression).collect()]


def test_classes_are_right_closed(spark):
    rows = [(34.0,), (34.1,), (104.0,), (104.1,), (0.0,), (-1.0,), (None,), (float("nan"),)]
    got = values(spark, rows, "x double", cut("x", ENTEROCOCCI_BREAKS, QUALITY_LEVELS))
    assert got == ["Safe", "Caution", "Caution", "Unsafe", "Safe", None, None, None]
    got = values(spark, [(0.0,), (35.0,), (49999.0,), (50000.0,)], "x double", cut("x", DASHBOARD_BREAKS, DASHBOARD_LEVELS))
    assert got == ["NotDetected", "Good", "Unacceptable", None]


def test_compass_sectors(spark):
    rows = [(0.0,), (11.24,), (11.25,), (348.74,), (348.75,), (360.0,), (-5.0,), (None,)]
    assert values(spark, rows, "d double", compass16("d")) == ["N", "N", "NNE", "NNW", "N", "N", "N", None]
    assert values(spark, [("90",), ("slack",), (None,)], "d string", direction("d")) == ["E", "slack", None]


def test_censored_values(spark):
    rows = [("<10",), ("<100",), ("Trace",), (">24196",), ("0.2 (3 in)",), ("(est) > 5",), ("N/A",), ("12",), (None,), ("",)]
    assert values(spark, rows, "x string", parse_censored("x")) == [0.0, None, 0.0, 24196.0, 0.2, 5.0, None, 12.0, None, None]


def test_three_valued_choice(spark):
    rows = [(True,), (False,), (None,)]
    assert values(spark, rows, "c boolean", if_else(F.col("c"), "a", "b")) == ["a", "b", None]
    assert values(spark, [("x",), (None,)], "c string", is_in("c", ["x"])) == [True, False]


def test_distance(spark):
    rows = [(40.6, -73.6, 40.6, -73.6), (0.0, 0.0, 0.0, 180.0), (40.0, -73.0, 41.0, None)]
    same, half, missing = values(spark, rows, "a double, b double, c double, d double", great_circle_km("a", "b", "c", "d"))
    assert same == 0.0
    assert half == pytest.approx(math.pi * 6371, rel=1e-9)
    assert missing is None


def test_clock_texts(spark):
    rows = [("7:05",), ("07:05:09",), ("12:00 AM",), ("12:30 pm",), ("1:05PM",), ("25:00",), ("13:00 PM",), ("noon",), (None,)]
    assert values(spark, rows, "t string", seconds_of_day("t")) == [25500, 25509, 0, 45000, 47100, None, None, None, None]
    day = F.lit("2024-05-06T00:00:00.000")
    got = values(spark, rows, "t string", F.date_format(parse_ts(day, F.col("t")), "dd HH:mm:ss"))
    assert got == ["06 07:05:00", "06 07:05:09", "06 00:00:00", "06 12:30:00", "06 13:05:00"] + ["06 12:00:00"] * 4
    got = values(spark, rows, "t string", at_time(F.lit("2024-05-06").cast("date"), "t").isNull())
    assert got == [False] * 5 + [True] * 4


def test_hours_follow_the_instant_over_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp'2024-03-10 03:30:00' AS b, timestamp'2024-03-10 01:30:00' AS a, timestamp_ntz'2024-03-10 03:30:00' AS d, timestamp_ntz'2024-03-10 01:30:00' AS c")
        row = df.select(hours_between("b", "a").alias("instants"), hours_between("d", "c").alias("clocks"), hms_text("a", "b").alias("text")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row["instants"], row["clocks"], row["text"]) == (1.0, 1.0, "1H 0M")


def test_row_helpers(spark):
    rows = [(None, None), (1.0, None), (1.0, 2.0)]
    assert values(spark, rows, "a double, b double", row_sum("a", "b")) == [0.0, 1.0, 3.0]
    assert values(spark, rows, "a double, b double", row_max("a", "b")) == [None, 1.0, 2.0]
    assert values(spark, [(float("-inf"),), (float("nan"),), (2.0,)], "a double", finite("a")) == [None, None, 2.0]


def test_texts(spark):
    assert values(spark, [("a.b.c",), ("x",)], "s string", replace_first("s", r"\.", "$")) == ["a$b.c", "x"]
    assert values(spark, [("year 2021 x",), ("none",)], "s string", extract("s", "[0-9]+")) == ["2021", None]


def test_season_and_current(spark):
    months = [(dt.date(2024, m, 1),) for m in range(1, 13)]
    assert values(spark, months, "d date", season_index("d")) == [1, 2, 3, 4, 5, 6, 7, 6, 5, 4, 3, 2]
    got = values(spark, [(3.0, 5.0, 6.0), (3.0, -5.0, 6.0), (1.0, 1.0, 0.0)], "h double, r double, d double", current_index("h", "r", "d"))
    assert got == [5.0, -5.0, None]
