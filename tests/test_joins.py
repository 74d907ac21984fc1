import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from envspark.operators import (
    asof_backward,
    asof_forward,
    asof_with_fallback,
    fill_from_default,
    left_join_with_default,
    nearest,
    nearest_value,
    next_value,
    phase_features,
)
from envspark.operators import spatial
from envspark.plans.tides import tide_positions

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_asof_is_strict_and_breaks_ties(spark):
    left = spark.createDataFrame([("a", at(5)), ("a", at(0)), ("b", at(5)), (None, at(5)), ("a", None)], "k string, t timestamp")
    right = spark.createDataFrame([("a", at(0), 1, False), ("a", at(3), 2, False), ("a", at(3), 3, True), ("a", at(5), 4, True)], "k string, rt timestamp, v int, good boolean")
    got = {(r["k"], r["t"]): r["v"] for r in asof_backward(left, right, "k", "t", "rt", tie_break=[F.col("good")]).collect()}
    assert got == {("a", at(5)): 3, ("a", at(0)): None, ("b", at(5)): None, (None, at(5)): None, ("a", None): None}
    got = {(r["k"], r["t"]): r["v"] for r in asof_backward(left, right, "k", "t", "rt", strict=False).collect()}
    assert got[("a", at(5))] == 4 and got[("a", at(0))] == 1


def test_horizon_and_fallback(spark):
    left = spark.createDataFrame([("a", at(8)), ("a", at(8.1)), ("b", at(9))], "k string, t timestamp")
    right = spark.createDataFrame([("a", at(0), 1, True), ("z", at(-20), 9, True)], "k string, rt timestamp, v int, good boolean")
    got = {(r["k"], r["t"]): (r["v"], r["good"], round(r["hours_since"], 3)) for r in asof_with_fallback(left, right, "k", "t", "rt", 8.0, "z", "good").collect()}
    assert got == {("a", at(8)): (1, True, 8.0), ("a", at(8.1)): (9, False, 28.1), ("b", at(9)): (9, False, 29.0)}


def test_forward_looks_from_the_offset(spark):
    left = spark.createDataFrame([("a", at(10))], "k string, t timestamp")
    right = spark.createDataFrame([("a", at(4), 1), ("a", at(5), 2), ("a", at(12), 3)], "k string, rt timestamp, v int")
    assert asof_forward(left, right, "k", "t", "rt", offset_hours=-6).first()["v"] == 2
    assert asof_forward(left, right, "k", "t", "rt").first()["v"] == 3


@pytest.mark.parametrize("bits", [None, 1, 3])
def test_asof_against_brute_force_with_a_hot_key(spark, bits):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b"])
    lefts = [(i, key(), rng.randrange(60)) for i in range(150)]
    rights = [(i, key(), rng.randrange(60)) for i in range(150)]
    left = spark.createDataFrame(lefts, "i int, k string, t int")
    right = spark.createDataFrame(rights, "j int, k string, rt int")
    got = {r["i"]: r["j"] for r in asof_backward(left, right, "k", "t", "rt", tie_break=[F.col("j")], bits=bits).collect()}
    want = {}
    for i, k, t in lefts:
        before = [(rt, j) for j, rk, rt in rights if rk == k and rt < t]
        want[i] = max(before)[1] if before else None
    assert got == want


@pytest.mark.parametrize("bits", [None, 0, 2])
def test_nearest_and_next_value(spark, bits):
    values = spark.createDataFrame([(float(v),) for v in range(0, 100, 10)], "v double")
    rows = [(-3.0,), (15.0,), (16.0,), (90.0,), (200.0,), (None,)]
    wanted = spark.createDataFrame(rows, "x double")
    got = {r["x"]: r["n"] for r in nearest_value(wanted, values, "x", "v", "n", bits).collect()}
    assert got == {-3.0: 0.0, 15.0: 10.0, 16.0: 20.0, 90.0: 90.0, 200.0: 90.0, None: None}
    got = {r["x"]: r["n"] for r in next_value(wanted, values, "x", "v", "n", bits).collect()}
    assert got == {-3.0: 0.0, 15.0: 20.0, 16.0: 20.0, 90.0: 90.0, 200.0: None, None: None}


def _km(a, b):
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * asin(min(1, sqrt(h)))


def test_nearest_hand_check(spark):
    stations = spark.createDataFrame(
        [("8536110", 40.5, -73.5), ("8536120", 40.6, -73.6), ("8536130", 40.7, -73.7), ("8536150", 40.8, -73.8), ("0", None, -73.6)],
        "id string, latitude double, longitude double",
    )
    sites = spark.createDataFrame([(1, 40.6, -73.6), (2, None, None)], "site int, latitude double, longitude double")
    got = {r["site"]: (r["tide_id"], r["tide_dist_km"]) for r in nearest(sites, stations, "tide").collect()}
    assert got == {1: ("8536120", 0.0), 2: (None, None)}


@pytest.mark.parametrize("start,leaf", [(64, 64), (2, 2)])
def test_nearest_against_brute_force(spark, monkeypatch, start, leaf):
    monkeypatch.setattr(spatial, "START_CELLS", start)
    monkeypatch.setattr(spatial, "LEAF_STATIONS", leaf)
    rng = random.Random(3)
    cluster = [(40.7 + rng.random() / 100, -74 + rng.random() / 100) for _ in range(60)]
    world = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(40)]
    edges = [(10.0, 179.9), (10.0, -179.9), (89.9, 10.0), (-89.9, -100.0), (40.7, -74.0), (40.7, -74.0)]
    stations = [(f"s{i:03d}", *p) for i, p in enumerate(cluster + world + edges)]
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(40.7, -74.0), (41.0, -74.0), (10.0, 180.0), (90.0, 0.0), (40.705, -73.995)]
    sites = [(i, *p) for i, p in enumerate(spots)]
    got = nearest(
        spark.createDataFrame(sites, "site int, latitude double, longitude double"), spark.createDataFrame(stations, "id string, latitude double, longitude double"), "st"
    ).collect()
    assert len(got) == len(sites)
    for r in got:
        here = spots[r["site"]]
        best = min((round(_km(here, s[1:]), 6), s[0]) for s in stations)
        assert r["st_id"] == best[1], (here, best, r)
        assert r["st_dist_km"] == pytest.approx(best[0], abs=1e-5)


def test_default_station(spark):
    facts = spark.createDataFrame([("d1", "a", 1.0, 9.0), ("d1", "z", 5.0, 6.0), ("d2", "a", None, 3.0)], "date string, st string, p double, q double")
    left = spark.createDataFrame([(1, "d1", "a"), (2, "d1", "b"), (3, "d2", "a")], "i int, date string, st string")
    got = {r["i"]: (r["st"], r["p"], r["q"]) for r in left_join_with_default(left, facts, ["date", "st"], "st", "z", ["p", "q"]).collect()}
    assert got == {1: ("a", 1.0, 9.0), 2: ("z", 5.0, 6.0), 3: ("z", None, None)}
    joined = left.join(facts, ["date", "st"], "left")
    assert fill_from_default(joined, facts, ["date"], "st", "z", ["p", "q"]).count() == 3


def test_tide_position_prefers_the_real_station(spark):
    key = spark.createDataFrame([("s", "1", "T")], "site string, site_id string, tide_noaa_id string")
    samples = spark.createDataFrame([("s", "1", at(3))], "site string, site_id string, sample_time timestamp")
    tides = spark.createDataFrame(
        [("T", at(0), 1.0, False, 4.0, 6.0), ("T", at(0), 2.0, True, 4.0, 6.0)],
        "tide_noaa_id string, datetime timestamp, tide_level double, good_tide_station boolean, tide_range_ft double, tide_duration_hrs double",
    )
    row = tide_positions(key, samples, tides).first()
    assert (row["tide_level"], row["good_tide_station"], row["hours_since_last"], row["current"]) == (2.0, True, 3.0, 4.0)


DAY = dt.date(2024, 3, 11)


def test_a_date_meets_a_timestamp_as_its_midnight(spark):
    left = spark.createDataFrame([(1, "a", DAY)], "i int, k string, d date")
    for kind in ("timestamp_ntz", "timestamp"):
        right = spark.createDataFrame([("a", dt.datetime(2024, 3, 10, 23, 0), 7), ("a", dt.datetime(2024, 3, 11, 1, 0), 8)], f"k string, t {kind}, x int")
        assert [r["x"] for r in asof_backward(left, right, "k", "d", "t").collect()] == [7]
        assert [r["x"] for r in asof_forward(left, right, "k", "d", "t").collect()] == [8]
    back = right.join(left.select("k", "d"), "k")
    assert sorted(r["i"] or 0 for r in asof_backward(right, left, "k", "t", "d").collect()) == [0, 1]
    assert back.count() == 2


def test_times_of_different_kinds_are_refused(spark):
    left = spark.createDataFrame([(1, "a", dt.datetime(2024, 3, 11))], "i int, k string, t timestamp")
    with pytest.raises(TypeError):
        asof_backward(left, left.select("k", F.col("t").cast("timestamp_ntz").alias("u")), "k", "t", "u")
    with pytest.raises(TypeError):
        asof_backward(left, left.select("k", F.lit(1).alias("u")), "k", "t", "u")


def test_offsets_follow_the_kind_of_time(spark):
    days = spark.createDataFrame([("a", DAY - dt.timedelta(days=n), n) for n in range(11)], "k string, e date, n int")
    left = spark.createDataFrame([("a", DAY)], "k string, d date")
    assert [r["n"] for r in asof_forward(left, days, "k", "d", "e", offset_hours=-48).collect()] == [1]
    with pytest.raises(ValueError):
        asof_forward(left, days, "k", "d", "e", offset_hours=-6)
    numbers = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(TypeError):
        asof_forward(numbers, numbers.withColumnRenamed("v", "w"), "k", "v", "w", offset_hours=1)


def test_phases_are_elapsed_time_across_a_clock_change(spark):
    from envspark.operators import phase_features

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        turns = spark.createDataFrame([("a", dt.datetime(2024, 3, 9, 23, 0), 1.0), ("a", dt.datetime(2024, 3, 10, 7, 30), 4.0)], "s string, t timestamp_ntz, level double")
        got = phase_features(turns, "s", "t", "level").orderBy("t").collect()
        assert [(r["tide_range_ft"], r["tide_duration_hrs"]) for r in got] == [(3.0, 7.5), (None, None)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_repeated_turns_do_not_depend_on_input_order(spark):
    from envspark.operators import phase_features

    rows = [("a", dt.datetime(2024, 1, 1, 0, 0), 1.0), ("a", dt.datetime(2024, 1, 1, 0, 0), 2.0), ("a", dt.datetime(2024, 1, 1, 6, 0), 5.0)]
    for some in (rows, rows[::-1]):
        got = phase_features(spark.createDataFrame(some, "s string, t timestamp, level double").coalesce(1), "s", "t", "level").collect()
        assert sorted((r["level"], r["tide_range_ft"] or -1) for r in got) == [(2.0, 3.0), (5.0, -1)]


def test_nearest_value_never_sums_up_a_frame_anew_for_every_row(spark):
    """A frame that ends at a partition's last row costs the square of the partition's rows."""
    left = spark.range(3000).select((F.col("id") / 1000 + 5000).alias("x"))
    right = spark.range(0, 3000, 7).select((F.col("id") / 1000 + 5000.0005).alias("p"))
    found = nearest_value(left, right, "x", "p", "closest")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan
    values = [r.p for r in right.collect()]
    for r in found.filter("x < 5000.3").collect():
        assert r.closest == min(values, key=lambda v: (abs(v - r.x), v))
