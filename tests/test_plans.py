import datetime as dt

import pytest
from pyspark.sql import functions as F

from envspark.plans import opendata, samples, weather
from envspark.sources import calendar_to_events, explode_predictions, normalise_sheet, request_grid
from envspark.sources.schemas import CALENDAR_COLUMNS, SAMPLE_SHEET_COLUMNS

D = dt.date


def sheet_row(**cells):
    base = {c: None for c in SAMPLE_SHEET_COLUMNS} | {"site": "Pier (mouth)", "site_id": "1", "date": "2024-05-05", "year": "2024", "month": "5"}
    return tuple((base | cells)[c] for c in SAMPLE_SHEET_COLUMNS)


def test_sample_sheet(spark):
    rows = [
        sheet_row(site_id="1", sample_time="08:00", bacteria="<10", precip_t1="0.2 (3 in)", precip_t2="Trace"),
        sheet_row(site_id="2", sample_time="10:00", bacteria=">24196", notes="N/A", high_tide="7:30"),
        sheet_row(site_id="3", bacteria="N/A", site="Govenors Island"),
        sheet_row(site=None),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{i} cell` string" for i in range(len(SAMPLE_SHEET_COLUMNS))))
    out = {r["site_id"]: r for r in samples.clean_samples(raw).collect()}
    assert set(out) == {"1", "2", "3"}
    assert (out["1"]["bacteria"], out["1"]["quality"], out["1"]["precip_48"]) == (0.0, "Safe", 0.2)
    assert (out["2"]["bacteria"], out["2"]["quality"], out["2"]["notes"], out["2"]["precip_48"]) == (24196.0, "Unsafe", "", 0.0)
    assert out["2"]["high_tide"].hour == 7 and out["2"]["sample_day"] == "Sun"
    assert out["3"]["sample_time"].hour == 9  # the mean of eight and ten
    assert (out["3"]["quality"], out["3"]["site"], out["1"]["site"]) == (None, "Governors Island", "Pier (mouth)")


def test_sheet_headers(spark):
    df = spark.createDataFrame([("a", "x", "1"), (None, "y", "2"), (" ", "z", "3")], "`Site Name` string, `...2` string, `2021 Lab` string")
    out = normalise_sheet(df)
    assert out.columns == ["site_name", "x2021_lab"] and out.count() == 1


def test_current_cells(spark):
    cases = {
        ("0.7", "SW"): ("SW", 0.7),
        ("NE-0.5", None): ("NE", 0.5),
        ("11.25", "1"): ("NNE", 1.0),
        ("348.75", "1"): ("N", 1.0),
        ("slack", "slack"): ("UNKN", 0.0),
        (None, None): ("UNKN", 0.0),
        ("ese", "2"): ("ESE", 2.0),
    }
    schema = ["sampling_location", "current_direction_current_direction", "current_speed_knot", "sample_datetime", "winkler_method_top_dissolved_oxygen_mg_l", "winkler_method_bottom_dissolved_oxygen_mg_l"]
    rows = [(f"L{i}", a, b, "t", "5" if i else None, "7" if i else None) for i, (a, b) in enumerate(cases)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schema))
    df = df.withColumns({c: F.lit("3") for c in opendata.MEASURES.values()})
    out = {r["sampling_location"]: r for r in opendata.typed_subset(df).collect()}
    for i, want in enumerate(cases.values()):
        assert (out[f"L{i}"]["current_direction"], out[f"L{i}"]["current_speed_knot"]) == want
    assert out["L0"]["oxygen_mg_l"] is None and out["L1"]["oxygen_mg_l"] == 7.0


def test_rain_gaps(spark):
    days = [D(2024, 1, d) for d in (1, 2, 3, 4)]
    facts = [("A", "a", d, 1.0, 50.0) for d in days[:3]] + [("B", "b", days[0], 3.0, 40.0), ("Z", "z", days[3], 9.0, 30.0)]
    store = spark.createDataFrame(facts, "ghcn_station_name string, ghcn_station_id string, date date, precip_in double, temperature_f double")
    key = spark.createDataFrame([("1", "a", "a"), ("2", "b", "b"), ("3", None, "a")], "site_id string, precip_ghcn_id string, temperature_ghcn_id string")
    at = lambda d: dt.datetime(2024, 1, d, 9)
    rows = [("s1", "1", at(3)), ("s2", "2", at(3)), ("s1", "1", at(4)), ("s3", "3", at(3))]
    taken = spark.createDataFrame(rows, "site string, site_id string, sample_time timestamp")
    rain = {(r["site_id"], r["date"].day): (r["precip_ghcn_id"], r["precip_in"], r["precip_in_48"]) for r in weather.rain_for_samples(taken, key, store, "z").collect()}
    # the second site has no gauge row on the third and takes the mean of the day's samples
    assert rain == {("1", 3): ("a", 1.0, 2.0), ("2", 3): ("b", 1.0, 2.0), ("1", 4): ("z", 9.0, None)}
    warm = {(r["site_id"], r["date"].day): (r["temperature_ghcn_id"], r["temperature_f"]) for r in weather.temperature_for_samples(taken, key, store, "z").collect()}
    assert warm == {("1", 3): ("a", 50.0), ("2", 3): ("z", None), ("1", 4): ("z", 30.0)}


def test_model_table_keeps_one_row_per_sample(spark):
    at = dt.datetime(2024, 1, 1, 9)
    taken = spark.createDataFrame(
        [(5.0, "Safe", "1", at.date(), t, 0.0, 0.0, 0.0) for t in (at, at + dt.timedelta(hours=4))],
        "bacteria double, quality string, site_id string, date date, sample_time timestamp, precip_t0 double, precip_t1 double, precip_48 double",
    )
    places = spark.createDataFrame([("1", "pier", "bay")], "site_id string, site string, water_body string")
    tide = taken.select("site_id", "sample_time", F.lit(1.0).alias("tide_level"), F.lit(2.0).alias("hours_since_last"), F.lit(3.0).alias("current"))
    day = taken.select("site_id", "date", F.lit(60.0).alias("temperature_f"), F.lit(0.1).alias("precip_in"), F.lit(0.2).alias("precip_in_48"))
    out = samples.model_table(taken, places, tide, day, day)
    assert out.count() == 2 and out.dropna().count() == 2


def test_service_answers(spark):
    good = '{"predictions":[{"t":"2024-03-01 04:05","v":"1.5","type":"H"},{"t":"2024-03-01 10:15","v":"x","type":"L"}]}'
    bad = '{"predictions":[{"t":"2024-03-01 04:06","v":"2.5","type":"H"}],"error":{"message":"none"}}'
    df = spark.createDataFrame([("A", good), ("B", bad), ("C", "not json")], "station string, body string")
    out = sorted((r["tide_noaa_id"], r["datetime"].strftime("%H:%M"), r["tide_level"], r["hi_lo"], r["good_tide_station"]) for r in explode_predictions(df, "body", "station").collect())
    assert out == [("A", "04:05", 1.5, "H", True), ("A", "10:15", None, "L", True), ("B", "04:06", 2.5, "H", False)]


def test_calendar_leaves_out_days_the_month_does_not_have(spark):
    row = lambda day: (day, "Mon", "4:05", "5.1", "4:30", "4.9", "10:00", "0.2", None, "-")
    page = spark.createDataFrame([row("28"), row("30")], ", ".join(f"{c} string" for c in CALENDAR_COLUMNS)).withColumn("ym", F.lit("2023-02"))
    out = sorted((r["datetime"].strftime("%d %H:%M"), r["tide_level"], r["hi_lo"]) for r in calendar_to_events(page, "ym").collect())
    assert out == [("28 04:05", 5.1, "H"), ("28 10:00", 0.2, "L"), ("28 16:30", 4.9, "H")]


def test_request_grid_starts_at_the_floor(spark):
    df = spark.createDataFrame([("a", 2000, 2012), ("b", 2013, 2012)], "id string, first int, last int")
    assert sorted(r["year"] for r in request_grid(df, "first", "last", floor_year=2011).collect()) == [2011, 2012]


@pytest.mark.parametrize("name", ["j9_nearest_station", "j10_asof_backward", "j11_asof_with_fallback", "q11_rain_for_samples", "w4_impute_group_mean", "rs6_densify"])
def test_plans_hold_no_cross_product(spark, sf_dir, name):
    from envspark.catalog import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "EvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from envspark.catalog import QUERIES

    plan = QUERIES["io1_parquet_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_a_renamed_gauge_stays_one_gauge(spark):
    from envspark.plans.weather import daily_rain, rain_for_samples

    days = [dt.date(2024, 1, d) for d in range(1, 5)]
    rows = [("old" if i < 2 else "new", "G1", d, float(i + 1), 50.0) for i, d in enumerate(days)] + [("new", "G1", days[3], 0.5, 40.0)]
    for some in (rows, rows[::-1]):
        weather = spark.createDataFrame(some, "ghcn_station_name string, ghcn_station_id string, date date, precip_in double, temperature_f double")
        got = {r["date"]: (r["precip_in"], r["precip_in_48"]) for r in daily_rain(weather).collect()}
        assert got == {days[0]: (1.0, None), days[1]: (2.0, None), days[2]: (3.0, 3.0), days[3]: (4.0, 5.0)}
    key = spark.createDataFrame([("1", "G1", "G1")], "site_id string, precip_ghcn_id string, temperature_ghcn_id string")
    samples = spark.createDataFrame([("s", "1", dt.datetime(2024, 1, 4, 9, 0))], "site string, site_id string, sample_time timestamp")
    assert [r["precip_in_48"] for r in rain_for_samples(samples, key, weather).collect()] == [5.0]


def test_the_mark_reaches_the_scan(spark, tmp_path):
    from envspark.streaming import top_up

    new = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 86400).alias("t"))
    new.write.parquet(str(tmp_path / "new"))
    read = spark.read.parquet(str(tmp_path / "new"))
    out = top_up(read.filter("id < 50"), read, "t", ["id"])
    assert out.count() == 100
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [IsNotNull(t), GreaterThan(t,ScalarSubquery" in plan
    assert top_up(read.filter("id < 0"), read, "t", ["id"]).count() == 100


def test_depth_beyond_the_limit_is_refused():
    from envspark.models import rf_classifier

    with pytest.raises(ValueError):
        rf_classifier(["a"], depth=31)
