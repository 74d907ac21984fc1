"""Q1–Q27: the composed queries on the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, shown, table
from envspark.functions.measures import QUALITY_LEVELS
from envspark.functions.times import position
from envspark.operators.aggregate import box_stats
from envspark.plans import opendata, reports, samples, stations, tides, weather



def e_id():
    return F.col("event_id")


# --- sheets --------------------------------------------------------------------------------------------------


def _sample_sheet(spark, sf):
    e = table(spark, sf, "events")
    form = e_id() % 6
    amount = F.round("value", 2).cast("string")
    level = (
        F.when(form == 0, F.lit("<10"))
        .when(form == 1, F.lit("Trace"))
        .when(form == 2, F.concat(F.lit(">"), amount))
        .when(form == 3, F.lit("N/A"))
        .otherwise(amount)
    )
    rain = [F.when((e_id() + i) % 4 != 0, F.concat(((e_id() + i) % 9 / 10).cast("string"), F.lit(" (3 in)" if i == 0 else ""))) for i in range(7)]
    site = F.when(e_id() % 97 != 0, F.concat(F.when(e_id() % 40 == 1, F.lit("Govenors Island ")).otherwise(F.lit("Pier (mouth) ")), F.col("user_id").cast("string")))
    return e.select(
        site.alias("Site"),
        e_id().cast("string").alias("Site ID"),
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.year("ts").cast("string").alias("Year"),
        F.month("ts").cast("string").alias("Month"),
        F.date_format("ts", "H:mm").alias("High Tide"),
        F.when(e_id() % 5 != 0, F.date_format("ts", "HH:mm:ss")).alias("Sample Time"),
        level.alias("MPN"),
        *[c.alias(f"Rain {i}") for i, c in enumerate(rain)],
        F.when(e_id() % 3 == 0, F.lit("N/A")).when(e_id() % 3 == 1, F.lit("windy")).alias("Notes"),
    )


def _amount(i: int) -> str:
    return f"CASE WHEN (event_id + {i}) % 4 <> 0 THEN (event_id + {i}) % 9 / 10.0 END"


Q1 = f"""WITH e AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 3 THEN NULL ELSE round(value, 2) END AS b,
    CASE WHEN event_id % 5 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS s FROM events WHERE event_id % 97 <> 0),
  t AS (SELECT *, coalesce(s, (SELECT round(avg(s)) FROM e))::BIGINT AS clock FROM e)
  SELECT CASE WHEN event_id % 40 = 1 THEN 'Governors Island ' ELSE 'Pier (mouth) ' END || user_id AS site, CAST(event_id AS VARCHAR) AS site_id, strftime(ts, '%Y-%m-%d') AS date,
    year(ts)::BIGINT AS year, month(ts)::BIGINT AS month, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS high_tide, strftime(date_trunc('day', ts) + to_seconds(clock), '%Y-%m-%d %H:%M:%S') AS sample_time,
    ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][dayofweek(ts) + 1] AS sample_day, round(b, 6) AS bacteria, round(coalesce({_amount(1)}, 0) + coalesce({_amount(2)}, 0), 6)::DOUBLE AS precip_48,
    {", ".join(f"round({_amount(i)}, 6)::DOUBLE AS precip_t{i}" for i in range(7))}, CASE WHEN event_id % 3 = 1 THEN 'windy' ELSE '' END AS notes, {d.CLASS.format("b")} AS quality FROM t"""


@query("q1_clean_samples", Q1)
def _(spark, sf):
    out = samples.clean_samples(_sample_sheet(spark, sf))
    texts = {"high_tide": F.date_format("high_tide", "yyyy-MM-dd HH:mm"), "sample_time": F.date_format("sample_time", "yyyy-MM-dd HH:mm:ss")}
    return shown(out.withColumns(texts))


def _site_sheet(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(k % 3 != 0, F.lit("x")).alias("Currently Testing"),
        F.when(k % 31 != 4, F.col("c_name")).alias("Site"),
        k.cast("string").alias("Site ID"),
        F.when(k % 4 == 0, F.lit("N/A")).otherwise(F.col("c_mktsegment")).alias("Water Body"),
        F.when(k % 50 != 7, (F.lit(40.4) + (k % 97) / F.lit(100.0)).cast("string")).alias("Latitude"),
        F.when(k % 50 != 7, ((F.lit(-74.3) + (k % 89) / F.lit(100.0)) * F.when(k % 5 == 1, F.lit(-1)).otherwise(F.lit(1))).cast("string")).alias("Longitude"),
        F.when(k % 6 != 0, F.col("c_nationkey").cast("string")).otherwise(F.lit("N/A")).alias("District Council Number"),
        F.when(k % 7 != 0, F.concat(F.lit("shed "), (k % 9).cast("string"))).alias("Associated WRRF or Sewershed"),
        F.element_at(F.array(*[F.lit(c) for c in ("SB", "I", "SA", "N/A")]), (k % 4 + 1).cast("int")).alias("NYS DEC Water Body Classification"),
        F.when(k % 2 == 0, F.lit("River Lab")).alias("2021 Lab Analysis By"),
        F.lit("").alias("...12"),
    )


Q2 = """SELECT CAST(c_custkey % 3 <> 0 AS VARCHAR) AS currently_testing, c_name AS site, CAST(c_custkey AS VARCHAR) AS site_id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS water_body,
  CASE WHEN c_custkey % 50 <> 7 THEN round(40.4 + (c_custkey % 97) / 100.0, 6) END AS latitude, CASE WHEN c_custkey % 50 <> 7 THEN round(-74.3 + (c_custkey % 89) / 100.0, 6) END AS longitude,
  CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'NJ' END AS district_council_number, CASE WHEN c_custkey % 7 <> 0 THEN 'shed ' || (c_custkey % 9) ELSE 'NJ' END AS nyc_dep_wrrf_or_sewershed,
  ['SB', 'I', 'SA', 'NJ'][c_custkey % 4 + 1] AS nys_dec_water_body_classification, CASE WHEN c_custkey % 2 = 0 THEN 'River Lab' END AS x2021_lab_analysis_by FROM customer WHERE c_custkey % 31 <> 4"""


@query("q2_clean_sites", Q2)
def _(spark, sf):
    return shown(samples.clean_sites(_site_sheet(spark, sf), "site"))


@query("q2_site_class_levels", f"SELECT site_id, nys_dec_water_body_classification AS class, CASE nys_dec_water_body_classification WHEN 'SA' THEN 8 WHEN 'SB' THEN 9 WHEN 'I' THEN 11 ELSE 14 END::BIGINT AS class_pos FROM ({Q2})")
def _(spark, sf):
    c = "nys_dec_water_body_classification"
    out = samples.site_levels(samples.clean_sites(_site_sheet(spark, sf), "site"))
    return shown(out.select("site_id", F.col(c).alias("class"), F.col(f"{c}_pos").alias("class_pos")))


# --- stations ------------------------------------------------------------------------------------------------


@query(
    "q3_station_list",
    """WITH l AS (SELECT *, s_suppkey % 8 = 0 AS head FROM supplier), f AS (SELECT *, last_value(CASE WHEN head THEN s_name END IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS area FROM l)
    SELECT area, s_name AS name, CAST(8500000 + s_suppkey AS VARCHAR) AS id, round(40.4 + ((s_suppkey * 7) % 101) / 100.0, 6) AS latitude, round(-74.3 + ((s_suppkey * 13) % 83) / 100.0, 6) AS longitude,
      CASE WHEN s_suppkey % 2 = 0 THEN 'Harmonic' ELSE 'Subordinate' END AS "Predictions" FROM f WHERE NOT head""",
)
def _(spark, sf):
    k = F.col("s_suppkey")
    listing = table(spark, sf, "supplier").select(
        k.alias("row_id"),
        F.col("s_name").alias("Name"),
        F.when(k % 8 == 0, F.lit("")).otherwise((k + 8500000).cast("string")).alias("Id"),
        (F.lit(40.4) + (k * 7 % 101) / F.lit(100.0)).alias("Lat"),
        (F.lit(-74.3) + (k * 13 % 83) / F.lit(100.0)).alias("Lon"),
        F.when(k % 2 == 0, F.lit("Harmonic")).otherwise(F.lit("Subordinate")).alias("Predictions"),
    )
    return shown(stations.station_list(listing))


KEYED = f"""{d.SITES}, {d.STATIONS}, warm AS (SELECT * FROM stations WHERE element = 'TMAX' AND last_year = 2022), wet AS (SELECT * FROM stations WHERE element = 'PRCP' AND last_year = 2022),
  {d.nearest_sql("sites", "stations", "n1")}, {d.nearest_sql("sites", "warm", "n2")}, {d.nearest_sql("sites", "wet", "n3")},
  keyed AS (SELECT site, site_id, n1.near_id AS tide_noaa_id, n1.km AS k1, n2.near_id AS temperature_ghcn_id, n2.km AS k2, n3.near_id AS precip_ghcn_id, n3.km AS k3
    FROM sites LEFT JOIN n1 USING (site_id) LEFT JOIN n2 USING (site_id) LEFT JOIN n3 USING (site_id))"""


def _keyed(spark, sf):
    s = d.stations(spark, sf)
    return stations.station_key(d.sites(spark, sf), s.select("id", "name", "latitude", "longitude"), s, 2022)


@query(
    "q4_station_key",
    f"WITH {KEYED} SELECT site, site_id, tide_noaa_id, round(k1, 6) AS tide_noaa_dist_km, temperature_ghcn_id, round(k2, 6) AS temperature_ghcn_dist_km, precip_ghcn_id, round(k3, 6) AS precip_ghcn_dist_km FROM keyed",
)
def _(spark, sf):
    return shown(_keyed(spark, sf))


@query("q5_stations_in_use", f"WITH {KEYED} SELECT id AS tide_noaa_id, name FROM stations WHERE id IN (SELECT tide_noaa_id FROM keyed)")
def _(spark, sf):
    from envspark.operators import nearest

    s = d.stations(spark, sf)
    key = nearest(d.sites(spark, sf), s, "tide_noaa")
    return stations.stations_in_use(s, key, "tide_noaa_id").select("tide_noaa_id", "name")


@query(
    "q14_assignment_conflicts",
    f"""WITH {KEYED} SELECT site, site_id, tide_noaa_id, precip_ghcn_id, water_body, CAST(tide_noaa_id = noted_tide AS VARCHAR) AS tides_agree, CAST(precip_ghcn_id = noted_rain AS VARCHAR) AS precip_agree FROM keyed
    LEFT JOIN (SELECT site_id, water_body, CASE WHEN CAST(site_id AS BIGINT) % 3 = 0 THEN NULL ELSE 'S000012' END AS noted_tide, 'S' || lpad(CAST(CAST(site_id AS BIGINT) % 5 AS VARCHAR), 6, '0') AS noted_rain FROM sites) USING (site_id)""",
)
def _(spark, sf):
    k = F.col("site_id").cast("long")
    noted = d.sites(spark, sf).withColumns(
        {
            "borough_state": F.lit("NY"),
            "harmonic_noaa_tide_stations": F.when(k % 3 != 0, F.lit("S000012")),
            "noaa_rainfall_stations_id": F.format_string("S%06d", k % 5),
        }
    )
    out = stations.assignment_conflicts(_keyed(spark, sf), noted)
    return shown(out.select("site", "site_id", "tide_noaa_id", "precip_ghcn_id", "water_body", "tides_agree", "precip_agree"))


DEP = """dep AS (SELECT 'D' || s_suppkey AS sampling_location, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS station_name, 40.4 + ((s_suppkey * 7) % 101) / 100.0 AS latitude,
  -74.3 + ((s_suppkey * 13) % 83) / 100.0 + CASE WHEN s_suppkey % 20 = 3 THEN 30 ELSE 0 END AS longitude, 2018 + s_suppkey % 8 AS y FROM supplier)"""


def _dep(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("D"), k.cast("string")).alias("sampling_location"),
        F.when(k % 9 != 0, F.col("s_name")).alias("station_name"),
        (F.lit(40.4) + (k * 7 % 101) / F.lit(100.0)).alias("lat"),
        (F.lit(-74.3) + (k * 13 % 83) / F.lit(100.0) + F.when(k % 20 == 3, F.lit(30.0)).otherwise(F.lit(0.0))).alias("long"),
        F.make_date(F.lit(2018) + (k % 8).cast("int"), F.lit(6), F.lit(1)).alias("last_sample_date"),
    )


@query(
    "q17_network_pairs",
    f"""WITH {d.SITES}, {DEP}, act AS (SELECT * FROM sites WHERE currently_testing), rec AS (SELECT * FROM dep WHERE y > 2022), {d.nearest_sql("act", "rec", "near", id="sampling_location")}
    SELECT site_id, near_id AS sampling_location, round(km, 6) AS dist, station_name, site FROM act LEFT JOIN near USING (site_id) LEFT JOIN dep ON near_id = sampling_location""",
)
def _(spark, sf):
    pairs = stations.network_pairs(d.sites(spark, sf), _dep(spark, sf), 2022)
    return shown(pairs.select("site_id", "sampling_location", "dist", "station_name", "site"))


@query(
    "q17_both_networks",
    f"""WITH {d.SITES}, {DEP} SELECT site_id, site, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, 'citizen' AS source FROM sites WHERE currently_testing AND longitude < -69
    UNION ALL SELECT sampling_location, station_name, round(latitude, 6), round(longitude, 6), 'city' FROM dep WHERE y > 2022 AND station_name IS NOT NULL AND longitude < -69""",
)
def _(spark, sf):
    return shown(stations.network_sites(d.sites(spark, sf), _dep(spark, sf), 2022, ("citizen", "city")))


# --- tides ---------------------------------------------------------------------------------------------------


@query(
    "q6_missing_tides",
    f"""WITH {d.KEY}, {d.SAMPLES}, {d.TURNS}, needed AS (SELECT DISTINCT tide_noaa_id, s.date FROM key LEFT JOIN samples s USING (site_id))
    SELECT tide_noaa_id, strftime(date, '%Y-%m-%d') AS date FROM needed n WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.tide_noaa_id = n.tide_noaa_id AND t.date = n.date)""",
)
def _(spark, sf):
    return shown(tides.missing_tides(d.station_key(spark, sf), d.samples(spark, sf), d.turns(spark, sf)))


@query(
    "q7_append_tides",
    f"""WITH {d.TURNS}, old AS (SELECT *, 0.0::DOUBLE AS tide_range_ft, 1.0::DOUBLE AS tide_duration_hrs FROM turns WHERE date < DATE '2024-01-15'),
    fresh AS (SELECT * FROM turns WHERE date >= DATE '2024-01-14'), {d.PHASES.replace("FROM turns", "FROM fresh")}
    SELECT turn_id, round(tide_range_ft, 6) AS tide_range_ft, round(tide_duration_hrs, 6) AS tide_duration_hrs FROM phases
    UNION ALL SELECT turn_id, tide_range_ft, tide_duration_hrs FROM old WHERE turn_id NOT IN (SELECT turn_id FROM fresh)""",
)
def _(spark, sf):
    turns = d.turns(spark, sf)
    store = turns.filter("date < DATE '2024-01-15'").withColumns({"tide_range_ft": F.lit(0.0), "tide_duration_hrs": F.lit(1.0)})
    fresh = turns.filter("date >= DATE '2024-01-14'")
    out = tides.append_tides(store, fresh.unionByName(fresh.filter("turn_id % 3 = 0")))
    return shown(out.select("turn_id", "tide_range_ft", "tide_duration_hrs"))


POSITIONS = f"""{d.KEY}, {d.SAMPLES}, {d.TURNS}, {d.PHASES}, linked AS (SELECT s.*, k.tide_noaa_id FROM samples s JOIN key k USING (site_id) WHERE k.tide_noaa_id IS NOT NULL),
  own AS (SELECT l.*, p.datetime, p.tide_level, p.good_tide_station, p.tide_range_ft, p.tide_duration_hrs FROM linked l ASOF LEFT JOIN phases p ON l.tide_noaa_id = p.tide_noaa_id AND l.sample_time > p.datetime),
  spare AS (SELECT * FROM phases WHERE tide_noaa_id = '0'),
  late AS (SELECT event_id, site_id, sample_time FROM own WHERE datetime IS NULL OR epoch_us(sample_time) - epoch_us(datetime) > 8 * 3600000000),
  pos AS (SELECT event_id, site_id, sample_time, datetime, tide_level, good_tide_station, tide_range_ft, tide_duration_hrs FROM own WHERE epoch_us(sample_time) - epoch_us(datetime) <= 8 * 3600000000
    UNION ALL SELECT l.event_id, l.site_id, l.sample_time, p.datetime, p.tide_level, CASE WHEN p.datetime IS NOT NULL THEN false END, p.tide_range_ft, p.tide_duration_hrs FROM late l ASOF LEFT JOIN spare p ON l.sample_time > p.datetime),
  tide_data AS (SELECT event_id, site_id, sample_time, datetime AS tide_time, tide_level, good_tide_station, (epoch_us(sample_time) - epoch_us(datetime)) / 3.6e9 AS hours_since_last,
    tide_range_ft * sin(pi() * (epoch_us(sample_time) - epoch_us(datetime)) / 3.6e9 / nullif(tide_duration_hrs, 0)) AS current FROM pos)"""


def _tide_data(spark, sf):
    from envspark.operators import phase_features

    phases = phase_features(d.turns(spark, sf), "tide_noaa_id", "datetime", "tide_level")
    return tides.tide_positions(d.station_key(spark, sf), d.samples(spark, sf), phases, default_station="0")


@query(
    "q10_tide_positions",
    f"""WITH {POSITIONS} SELECT site_id, epoch_us(sample_time) AS sample_us, epoch_us(tide_time) AS tide_us, round(tide_level, 6) AS tide_level, CAST(good_tide_station AS VARCHAR) AS good_tide_station,
    round(hours_since_last, 6) AS hours_since_last, round(current, 5) AS current FROM tide_data""",
)
def _(spark, sf):
    out = _tide_data(spark, sf)
    out = out.select("site_id", position(out, "sample_time").alias("sample_us"), position(out, "tide_time").alias("tide_us"), "tide_level", "good_tide_station", "hours_since_last", F.round("current", 5).alias("current"))
    return shown(out)


# --- weather -------------------------------------------------------------------------------------------------


@query(
    "q8_widen_weather",
    """WITH l AS (SELECT CAST(ts AS DATE) AS date, 'G' || (user_id % 40) AS g, event_type AS k, round(max(value)) AS v FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3),
    w AS (SELECT date, g, any_value(v) FILTER (k = 'click') AS tmin, any_value(v) FILTER (k = 'view') AS tmax, any_value(v) FILTER (k = 'purchase') AS prcp FROM l GROUP BY 1, 2)
    SELECT strftime(date, '%Y-%m-%d') AS date, g AS ghcn_station_id, CASE WHEN g <> 'G3' THEN 'gauge ' || g[2:] END AS ghcn_station_name, round((tmin + tmax) / 20 * 9 / 5 + 32, 6) AS temperature_f, round(prcp / 10 * 0.039::DOUBLE, 6) AS precip_in FROM w""",
)
def _(spark, sf):
    e = table(spark, sf, "events").filter("event_type IN ('click', 'view', 'purchase')")
    code = F.when(F.col("event_type") == "click", F.lit("TMIN")).when(F.col("event_type") == "view", F.lit("TMAX")).otherwise(F.lit("PRCP"))
    gauge = (F.col("user_id") % 40).cast("string")
    long = e.groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").substr(1, 10).alias("date"), code.alias("datatype"), F.concat(F.lit("GHCND:G"), gauge).alias("station")).agg(F.round(F.max("value")).alias("value"))
    names = e.select(F.concat(F.lit("G"), gauge).alias("id"), F.concat(F.lit("gauge "), gauge).alias("name")).distinct().filter("id <> 'G3'")
    return shown(weather.widen_weather(long.unionByName(long), names))


GAUGES = "gauges AS (SELECT DISTINCT 'G' || (user_id % 45) AS id, 2020 + user_id % 45 % 6 AS first_year, 2026 AS last_year FROM events)"
NEEDED = f"""{d.KEY}, {d.SAMPLES}, {GAUGES}, days AS (SELECT DISTINCT site_id, date FROM samples),
  warm AS (SELECT DISTINCT temperature_ghcn_id AS g, date FROM key JOIN days USING (site_id) JOIN gauges ON id = temperature_ghcn_id WHERE year(date) BETWEEN first_year AND last_year),
  wet AS (SELECT DISTINCT precip_ghcn_id AS g, date - k AS date FROM key JOIN days USING (site_id) JOIN gauges ON id = precip_ghcn_id, (VALUES (0), (1), (2)) v(k) WHERE year(date) BETWEEN first_year AND last_year),
  needed AS (SELECT g, date FROM warm UNION SELECT g, date FROM wet)"""


def _needed(spark, sf):
    g = F.col("user_id") % 45
    gauges = table(spark, sf, "events").select(F.concat(F.lit("G"), g.cast("string")).alias("id"), (F.lit(2020) + g % 6).alias("first_year"), F.lit(2026).alias("last_year")).distinct()
    both = gauges.withColumn("element", F.explode(F.array(F.lit("TMAX"), F.lit("PRCP"))))
    return weather.needed_weather(d.station_key(spark, sf), d.samples(spark, sf), both)


@query("q9_needed_weather", f"WITH {NEEDED} SELECT g AS ghcn_station_id, strftime(date, '%Y-%m-%d') AS date FROM needed")
def _(spark, sf):
    return shown(_needed(spark, sf))


@query(
    "q9_missing_weather",
    f"""WITH {NEEDED}, {d.WEATHER.replace("weather AS", "have AS")} SELECT strftime(date, '%Y-%m-%d') AS date, string_agg(g, ',' ORDER BY g) AS stations FROM needed n
    WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.date = n.date AND h.ghcn_station_id = n.g) GROUP BY date""",
)
def _(spark, sf):
    nested = weather.missing_weather(_needed(spark, sf), d.weather(spark, sf))
    names = F.concat_ws(",", F.sort_array(F.transform("station_ids", lambda s: s["ghcn_station_id"])))
    return shown(nested.select("date", names.alias("stations")))


LINKED = """linked AS (SELECT s.event_id, s.site, s.site_id, s.date, k.precip_ghcn_id, k.temperature_ghcn_id FROM samples s JOIN key k USING (site_id) WHERE k.precip_ghcn_id IS NOT NULL)"""
RAIN = f"""{d.KEY}, {d.SAMPLES}, {d.WEATHER}, {LINKED},
  grid AS (SELECT i.ghcn_station_id, t.date, w.precip_in FROM (SELECT DISTINCT ghcn_station_id FROM weather) i CROSS JOIN (SELECT DISTINCT date FROM weather) t LEFT JOIN weather w ON w.ghcn_station_id = i.ghcn_station_id AND w.date = t.date),
  wet AS (SELECT *, lag(precip_in, 1) OVER w + lag(precip_in, 2) OVER w AS precip_in_48 FROM grid WINDOW w AS (PARTITION BY ghcn_station_id ORDER BY date)),
  own AS (SELECT l.*, w.precip_in, w.precip_in_48 FROM linked l LEFT JOIN wet w ON w.date = l.date AND w.ghcn_station_id = l.precip_ghcn_id),
  adj AS (SELECT event_id, site, site_id, date, precip_ghcn_id, coalesce(precip_in, avg(precip_in) OVER (PARTITION BY date)) AS p, coalesce(precip_in_48, avg(precip_in_48) OVER (PARTITION BY date)) AS p48 FROM own),
  rain AS (SELECT event_id, site, site_id, adj.date, CASE WHEN p IS NULL THEN 'G0' ELSE precip_ghcn_id END AS precip_ghcn_id, CASE WHEN p IS NULL THEN d.precip_in ELSE p END AS precip_in, CASE WHEN p IS NULL THEN d.precip_in_48 ELSE p48 END AS precip_in_48
    FROM adj LEFT JOIN (SELECT * FROM wet WHERE ghcn_station_id = 'G0') d ON d.date = adj.date)"""
WARM = """temps AS (SELECT l.event_id, l.site, l.site_id, l.date, CASE WHEN w.temperature_f IS NULL THEN 'G0' ELSE l.temperature_ghcn_id END AS temperature_ghcn_id, coalesce(w.temperature_f, d.temperature_f) AS temperature_f
    FROM linked l LEFT JOIN weather w ON w.date = l.date AND w.ghcn_station_id = l.temperature_ghcn_id LEFT JOIN (SELECT * FROM weather WHERE ghcn_station_id = 'G0') d ON d.date = l.date)"""


def _rain(spark, sf):
    return weather.rain_for_samples(d.samples(spark, sf), d.station_key(spark, sf), d.weather(spark, sf), "G0")


def _temperature(spark, sf):
    return weather.temperature_for_samples(d.samples(spark, sf), d.station_key(spark, sf), d.weather(spark, sf), "G0")


@query("q11_rain_for_samples", f"WITH {RAIN} SELECT site, site_id, strftime(date, '%Y-%m-%d') AS date, precip_ghcn_id, round(precip_in, 6) AS precip_in, round(precip_in_48, 6) AS precip_in_48 FROM rain")
def _(spark, sf):
    return shown(_rain(spark, sf))


@query("q12_temperature_for_samples", f"WITH {d.KEY}, {d.SAMPLES}, {d.WEATHER}, {LINKED}, {WARM} SELECT site, site_id, strftime(date, '%Y-%m-%d') AS date, temperature_ghcn_id, round(temperature_f, 6) AS temperature_f FROM temps")
def _(spark, sf):
    return shown(_temperature(spark, sf))


MODEL = f"""WITH {RAIN}, {WARM}, {d.TURNS}, {d.PHASES},
  tl AS (SELECT s.*, k.tide_noaa_id FROM samples s JOIN key k USING (site_id) WHERE k.tide_noaa_id IS NOT NULL), {POSITIONS[POSITIONS.index("own AS"):].replace("own AS", "town AS").replace("FROM own", "FROM town").replace("FROM linked l ASOF", "FROM tl l ASOF")},
  model AS (SELECT s.event_id, s.bacteria, {d.CLASS.format("s.bacteria")} AS quality, s.site_id, k.site, s.date, k.precip_ghcn_id AS water_body, t.tide_level, t.hours_since_last, t.current, w.temperature_f, r.precip_in, r.precip_in_48
    FROM samples s LEFT JOIN key k USING (site_id) LEFT JOIN tide_data t ON t.event_id = s.event_id LEFT JOIN temps w ON w.event_id = s.event_id LEFT JOIN rain r ON r.event_id = s.event_id)"""


def _model(spark, sf):
    from envspark.functions.measures import ENTEROCOCCI_BREAKS, cut

    s = d.samples(spark, sf).withColumns(
        {
            "quality": cut("bacteria", ENTEROCOCCI_BREAKS, QUALITY_LEVELS),
            "precip_t0": F.col("event_id") % 7 / 10,
            "precip_t1": F.col("event_id") % 5 / 10,
            "precip_48": F.col("event_id").cast("double"),
        }
    )
    places = d.station_key(spark, sf).select("site_id", "site", F.col("precip_ghcn_id").alias("water_body"))
    return samples.model_table(s, places, _tide_data(spark, sf), _temperature(spark, sf), _rain(spark, sf))


@query(
    "q13_model_table",
    MODEL
    + """ SELECT round(bacteria, 6) AS bacteria, quality, site_id, site, strftime(date, '%Y-%m-%d') AS date, round((event_id % 7 / 10.0)::DOUBLE, 6) AS sheet_precip_t0, round((event_id % 5 / 10.0)::DOUBLE, 6) AS sheet_precip_t1, event_id::DOUBLE AS sheet_precip_48, water_body,
      round(tide_level, 6) AS tide_level, round(hours_since_last, 6) AS hours_since_last, round(current, 5) AS current, round(temperature_f, 6) AS temperature_f, round(precip_in, 6) AS ghcn_precip_in, round(precip_in_48, 6) AS ghcn_precip_in_48 FROM model""",
)
def _(spark, sf):
    return shown(_model(spark, sf).withColumn("current", F.round("current", 5)))


@query(
    "q22_station_annual_rain",
    f"WITH {d.WEATHER} SELECT 2024::BIGINT AS year, ghcn_station_name, count(*) AS n, round(avg(precip_in) * 365, 7) AS precip FROM weather WHERE year(date) = 2024 GROUP BY 2 HAVING count(*) > 20 AND avg(precip_in) IS NOT NULL",
)
def _(spark, sf):
    return shown(weather.station_annual_rain(d.weather(spark, sf), 2024, min_n=20), 7)


# --- open data -----------------------------------------------------------------------------------------------


def _open_data(spark, sf):
    e = table(spark, sf, "events")
    text = lambda c: c.cast("string")
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (e_id() % 8 + 1).cast("int"))
    lat = F.lit(40.0) + F.col("user_id") % 60 / F.lit(100.0)
    lon = F.lit(-74.0) + F.col("user_id") % 60 / F.lit(50.0)
    odd = e_id() % 9 == 2
    hidden = e_id() % 4 == 3
    clock = F.when(e_id() % 3 == 0, F.date_format("ts", "h:mm a")).when(e_id() % 3 == 1, F.date_format("ts", "HH:mm")).when(e_id() % 2 == 0, F.lit("early"))
    return e.select(
        F.concat(F.lit("L"), text(F.col("user_id") % 60)).alias("sampling_location"),
        F.date_format("ts", "yyyy-MM-dd'T00:00:00.000'").alias("sample_date"),
        clock.alias("sample_time"),
        F.when(~hidden, text(F.when(odd, lon).otherwise(lat))).alias("lat"),
        F.when(~hidden, text(F.when(odd, lat).otherwise(lon))).alias("long"),
        pick(["NE", "0.7", "NE-0.5", "100", "slack", "ese", None, "348.75"]).alias("current_direction_current_direction"),
        pick(["0.5", "SW", None, "1.2", "slack", ">", None, "2"]).alias("current_speed_knot"),
        F.when(e_id() % 5 != 0, text(F.col("value"))).alias("winkler_method_top_dissolved_oxygen_mg_l"),
        F.when(e_id() % 7 != 0, text(F.round(F.col("value") / 2, 3))).otherwise(F.lit("NS")).alias("winkler_method_bottom_dissolved_oxygen_mg_l"),
        F.when(e_id() % 11 != 0, text(F.col("user_id"))).alias("top_sample_temperature_c"),
        text(e_id() % 30).alias("top_salinity_psu"),
        F.lit("7.5").alias("top_ph"),
        F.when(e_id() % 10 != 1, text(F.col("value"))).alias("top_nitrate_nitrite_mg_l"),
        text(e_id() % 100).alias("total_phosphorus_mg_l"),
        F.when(e_id() % 13 != 5, text(e_id() % 17)).otherwise(F.lit("ND")).alias("top_ammonium_mg_l"),
        F.when(e_id() % 8 != 1, text(F.col("value"))).alias("top_enterococci_bacteria_cells_100ml"),
        F.when(e_id() % 6 != 0, text(e_id() % 500)).alias("top_fecal_coliform_bacteria_cells_100ml"),
    )


OPEN = """o AS (SELECT *, 'L' || (user_id % 60) AS loc, CASE WHEN event_id % 3 <= 1 THEN date_trunc('minute', ts) ELSE date_trunc('day', ts) + INTERVAL 12 HOUR END AS t,
  CASE WHEN event_id % 5 <> 0 THEN value END AS top, CASE WHEN event_id % 7 <> 0 THEN round(value / 2, 3) END AS bottom FROM events)"""
SUBSET = f"""{OPEN}, k AS (SELECT *, max(greatest(top, bottom)) OVER (PARTITION BY loc, t) AS oxygen_mg_l FROM o WHERE event_id % 6 <> 0),
  sub AS (SELECT loc AS sampling_location, t, ['NE','SW','NE','E','UNKN','ESE','UNKN','N'][event_id % 8 + 1] AS current_direction, [0.5,0.7,0.5,1.2,0.0,0.0,0.0,2.0][event_id % 8 + 1]::DOUBLE AS current_speed_knot, oxygen_mg_l,
    CASE WHEN event_id % 11 <> 0 THEN user_id END::DOUBLE AS sample_temperature_c, (event_id % 30)::DOUBLE AS salinity_psu, 7.5::DOUBLE AS ph, CASE WHEN event_id % 10 <> 1 THEN value END AS nutrient_nitrate_mg_l, (event_id % 100)::DOUBLE AS nutrient_phosphorus_mg_l,
    CASE WHEN event_id % 13 <> 5 THEN event_id % 17 END::DOUBLE AS nutrient_ammonium_mg_l, CASE WHEN event_id % 8 <> 1 THEN value END AS bacteria_enterococci_100ml, (event_id % 500)::DOUBLE AS bacteria_fecal_coliform_100ml FROM k)"""
NUMBERS = ["current_speed_knot", "oxygen_mg_l", "sample_temperature_c", "salinity_psu", "ph", "nutrient_nitrate_mg_l", "nutrient_phosphorus_mg_l", "nutrient_ammonium_mg_l", "bacteria_enterococci_100ml", "bacteria_fecal_coliform_100ml"]


def _rows(spark, sf):
    return opendata.with_sample_datetime(_open_data(spark, sf))


def _subset(spark, sf):
    return opendata.typed_subset(_rows(spark, sf))


def _minute():
    return F.date_format("sample_datetime", "yyyy-MM-dd HH:mm").alias("sample_datetime")


@query("q15_sample_times", f"WITH {OPEN} SELECT loc AS sampling_location, strftime(t, '%Y-%m-%d %H:%M') AS sample_datetime, count(*) AS n FROM o GROUP BY 1, 2")
def _(spark, sf):
    return _rows(spark, sf).select("sampling_location", _minute()).groupBy("sampling_location", "sample_datetime").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q15_station_metadata",
    f"""WITH {OPEN} SELECT loc AS sampling_location, strftime(min(t), '%Y-%m-%d %H:%M') AS first_sample_date, strftime(max(t), '%Y-%m-%d %H:%M') AS last_sample_date,
      CASE WHEN count(*) FILTER (event_id % 4 <> 3) > 0 THEN round(any_value(40.0 + user_id % 60 / 100.0), 6) END AS lat, CASE WHEN count(*) FILTER (event_id % 4 <> 3) > 0 THEN round(any_value(-74.0 + user_id % 60 / 50.0), 6) END AS long, any_value(loc || ' Buoy') AS station_name FROM o GROUP BY 1""",
)
def _(spark, sf):
    rows = _rows(spark, sf)
    listing = rows.select(F.concat("sampling_location", F.lit(" "), "sampling_location", F.lit(" Buoy")).alias("Station")).distinct()
    meta = opendata.station_metadata(rows, opendata.station_names(listing))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return shown(meta.select("sampling_location", day("first_sample_date"), day("last_sample_date"), "lat", "long", "station_name"))


@query("q15_typed_subset", f"WITH {SUBSET} SELECT sampling_location, strftime(t, '%Y-%m-%d %H:%M') AS sample_datetime, current_direction, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM sub")
def _(spark, sf):
    return shown(_subset(spark, sf).select("sampling_location", _minute(), "current_direction", *NUMBERS))


@query(
    "q16_impute_by_date",
    f"""WITH {SUBSET} SELECT sampling_location, strftime(t, '%Y-%m-%d %H:%M') AS sample_datetime, current_direction, {', '.join(f'round(coalesce({c}, avg({c}) OVER (PARTITION BY CAST(t AS DATE))), 9) AS {c}' for c in NUMBERS)} FROM sub""",
)
def _(spark, sf):
    out = opendata.impute_by_date(_subset(spark, sf))
    return shown(out.select("sampling_location", _minute(), "current_direction", *NUMBERS), 9)


@query(
    "q18_nutrient_trend",
    f"""WITH {SUBSET} SELECT year(t)::BIGINT AS year, 'nitrate' AS nutrient, round(avg(nutrient_nitrate_mg_l), 6) AS value FROM sub GROUP BY 1 UNION ALL SELECT year(t), 'phosphorus', round(avg(nutrient_phosphorus_mg_l), 6) FROM sub GROUP BY 1
    UNION ALL SELECT year(t), 'ammonium', round(avg(nutrient_ammonium_mg_l), 6) FROM sub GROUP BY 1 UNION ALL SELECT year(t), 'oxygen', round(avg(oxygen_mg_l / 100), 6) FROM sub GROUP BY 1""",
)
def _(spark, sf):
    return shown(opendata.nutrient_trend(_subset(spark, sf)))


@query(
    "q18_bacteria_trend",
    f"""WITH {SUBSET}, n AS (SELECT year(t) AS y, count(DISTINCT sampling_location) AS station_count FROM sub GROUP BY 1)
    SELECT y::BIGINT AS year, 'enterococci_100ml' AS bacteria, round(avg(bacteria_enterococci_100ml), 6) AS bacteria_count, any_value(station_count) AS station_count FROM sub JOIN n ON y = year(t) GROUP BY 1
    UNION ALL SELECT y, 'fecal_coliform_100ml', round(avg(bacteria_fecal_coliform_100ml), 6), any_value(station_count) FROM sub JOIN n ON y = year(t) GROUP BY 1""",
)
def _(spark, sf):
    return shown(opendata.bacteria_trend(_subset(spark, sf)))


# --- reports -------------------------------------------------------------------------------------------------

RANKED = """WITH s AS (SELECT user_id, count(*) AS n_obs, median(value) AS m FROM events GROUP BY 1 HAVING count(*) > {min_n}),
  c AS (SELECT * FROM s WHERE {keep}),
  q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events WHERE user_id IN (SELECT user_id FROM c) GROUP BY 1),
  i AS (SELECT e.user_id, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (user_id))
  SELECT user_id, any_value(n_obs) AS n_obs, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3, round(min(value) FILTER (inside), 6) AS whisker_low, round(max(value) FILTER (inside), 6) AS whisker_high,
    count(*) FILTER (NOT inside) AS n_outliers FROM i JOIN q USING (user_id) JOIN c USING (user_id) GROUP BY 1"""


@query("q19_dirtiest_sites", RANKED.format(min_n=60, keep="m >= (SELECT min(m) FROM (SELECT m FROM s ORDER BY m DESC LIMIT 10))"))
def _(spark, sf):
    return shown(reports.ranked_sites(table(spark, sf, "events"), "user_id", "value", 60, 10, cleanest=False))


@query("q19_cleanest_sites", RANKED.format(min_n=60, keep="m <= (SELECT max(m) FROM (SELECT m FROM s ORDER BY m LIMIT 10))"))
def _(spark, sf):
    return shown(reports.ranked_sites(table(spark, sf, "events"), "user_id", "value", 60, 10, cleanest=True))


@query("q19_all_site_boxes", RANKED.format(min_n=0, keep="true"))
def _(spark, sf):
    e = table(spark, sf, "events")
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_obs"))
    return shown(box_stats(e, ["user_id"], "value").drop("n").join(counts, "user_id"))


@query(
    "q20_cohort_trend",
    """WITH y AS (SELECT *, year(o_orderdate) AS year FROM orders), l AS (SELECT o_custkey FROM y GROUP BY 1 HAVING count(DISTINCT year) >= 5), r AS (SELECT year, avg(o_totalprice / 100000) * 52 AS rain FROM y GROUP BY 1)
    SELECT year::BIGINT AS year, count(*) AS n, round(median(o_totalprice), 6) AS median_o_totalprice, round(any_value(rain), 6) AS annual_rainfall FROM y JOIN r USING (year) WHERE o_custkey IN (SELECT o_custkey FROM l) AND year > 1995 GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("rain", F.col("o_totalprice") / 100000)
    return shown(reports.cohort_trend(o, "o_custkey", "o_orderdate", "o_totalprice", "rain", 5, 1995))


@query("q21_stations_per_year", "SELECT year(o_orderdate)::BIGINT AS year, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return shown(reports.stations_per_year(table(spark, sf, "orders"), "o_custkey", "o_orderdate"))


CITY = """city AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS temp, min(value) AS rain FROM events GROUP BY 1),
  g AS (SELECT *, CASE WHEN count(rain) OVER w = 7 THEN sum(rain) OVER w END AS rain_7d FROM city WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  r AS (SELECT min(temp) AS t0, max(temp) AS t1, min(rain_7d) AS r0, max(rain_7d) AS r1 FROM g WHERE date IN (SELECT date FROM samples)),
  gauges AS (SELECT date, temp, rain, rain_7d, least(greatest(ceil((temp - t0) / (t1 - t0) * 5), 1), 5)::BIGINT AS temp_bin, CASE WHEN rain_7d IS NOT NULL THEN least(greatest(ceil((rain_7d - r0) / (r1 - r0) * 5), 1), 5)::BIGINT END AS rain_7d_bin FROM g, r WHERE date IN (SELECT date FROM samples))"""


def _city(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("temp"), F.min("value").alias("rain"))


def _dashboard_samples(spark, sf):
    return d.samples(spark, sf).withColumn("high_tide", F.date_trunc("day", "sample_time").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS"))


@query(
    "q23_day_view",
    f"""WITH {d.SITES}, {d.SAMPLES}, {CITY}, pick AS (SELECT min(date) AS day FROM samples WHERE date >= DATE '2024-01-10'),
    v AS (SELECT *, abs(epoch_us(sample_time) - epoch_us(date_trunc('day', sample_time) + INTERVAL 6 HOUR)) // 1000000 AS gap FROM samples WHERE date = (SELECT day FROM pick))
    SELECT event_id, strftime(v.date, '%Y-%m-%d') AS date, round(ln(bacteria) * 100, 6) AS radius, '<b> ' || v.site || ' </b><br/>Sample Time ' || strftime(sample_time, '%Y-%m-%d %H:%M:%S') || '<br/>' ||
      concat_ws(' ', CASE WHEN gap >= 3600 THEN (gap // 3600) || 'H' END, CASE WHEN gap >= 60 THEN (gap % 3600 // 60) || 'M' END, CASE WHEN gap % 60 > 0 OR gap < 60 THEN (gap % 60) || 'S' END) || ' From High Tide<br/>' || format('{{:,}}', round(bacteria)::BIGINT) || ' Enterococci Colonies' AS popup,
      round(temp, 6) AS temp, round(rain_7d, 6) AS rain_7d, temp_bin, rain_7d_bin
    FROM v JOIN sites s USING (site_id) LEFT JOIN gauges g ON g.date = v.date WHERE latitude IS NOT NULL""",
)
def _(spark, sf):
    located = d.sites(spark, sf).select("site_id", "latitude", "longitude")
    out = reports.day_view(_dashboard_samples(spark, sf), located, _city(spark, sf), "2024-01-10")
    return shown(out.select("event_id", "date", "radius", "popup", "temp", "rain_7d", "temp_bin", "rain_7d_bin"))


@query(
    "q24_site_map",
    f"""WITH {d.SITES}, {d.SAMPLES}, m AS (SELECT site_id, median(bacteria) AS m FROM samples GROUP BY 1)
    SELECT site_id, round(m, 6) AS median_bacteria, CASE WHEN m > -1 AND m <= 0 THEN 'NotDetected' WHEN m <= 35 THEN 'Good' WHEN m <= 104 THEN 'Fair' ELSE 'Unacceptable' END AS median_quality, round(ln(m) * 100, 6) AS radius FROM sites JOIN m USING (site_id) WHERE currently_testing AND m > -1 AND m <= 49999""",
)
def _(spark, sf):
    out = reports.site_map(d.samples(spark, sf), d.sites(spark, sf))
    return shown(out.select("site_id", "median_bacteria", "median_quality", "radius"))


def _feature_inputs(spark, sf):
    s = d.samples(spark, sf).withColumns(
        {
            "year": F.year("date"),
            "high_tide": F.when(e_id() % 17 != 2, F.col("sample_time") - F.expr("INTERVAL 90 MINUTES")),
            **{f"precip_t{i}": F.when((e_id() + i) % 4 != 0, (e_id() + i) % 9 / 10) for i in range(7)},
        }
    ).withColumn("precip_t0", F.coalesce("precip_t0", F.lit(0.0)))
    k = F.col("site_id").cast("long")
    sites = d.sites(spark, sf).select(
        "site_id",
        "water_body",
        F.when(k % 4 != 0, F.lit("SB")).alias("nys_dec_water_body_classification"),
        F.concat(F.lit("shed "), (k % 9).cast("string")).alias("nyc_dep_wrrf_or_sewershed"),
        F.when(k % 3 == 0, F.lit("River Lab")).alias("x2024_lab_analysis_by"),
        F.lit("Old Lab").alias("x2021_lab_analysis_by"),
    )
    return s, sites


def _sum(parts) -> str:
    return " + ".join(f"coalesce({_amount(i)}, 0)" for i in parts)


@query("q25_lab_by_year", "SELECT CAST(c_custkey AS VARCHAR) AS site_id, 2024::BIGINT AS year, 'River Lab' AS lab FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2021, 'Old Lab' FROM customer")
def _(spark, sf):
    return shown(samples.lab_by_year(_feature_inputs(spark, sf)[1]))


@query(
    "q25_model_features",
    f"""SELECT event_id, CAST(user_id AS VARCHAR) AS site_id, round(({_sum(range(7))})::DOUBLE, 6) AS precip_week, round(({_sum((1, 2))})::DOUBLE, 6) AS precip_48, round(({_sum((3, 4, 5, 6))})::DOUBLE, 6) AS precip_earlier, 1.5::DOUBLE AS time_since_high_tide,
      (7 - abs(month(ts) - 7))::BIGINT AS season, {d.CLASS.format("value")} AS quality, c_mktsegment AS water_body, CASE WHEN user_id % 4 <> 0 THEN 'SB' ELSE 'missing' END AS water_class, 'shed ' || (user_id % 9) AS sewershed, CASE WHEN user_id % 3 = 0 THEN 'River Lab' ELSE 'missing' END AS lab
    FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 17 <> 2""",
)
def _(spark, sf):
    s, sites = _feature_inputs(spark, sf)
    out = samples.sample_features(s, sites, samples.lab_by_year(sites))
    return shown(out.select("event_id", "site_id", "precip_week", "precip_48", "precip_earlier", "time_since_high_tide", "season", "quality", "water_body", "water_class", "sewershed", "lab"))


@query("q26_train_and_evaluate")
def _(spark, sf):
    from envspark.plans.modelling import evaluate, train_classifier

    rows = _model(spark, sf).drop("sheet_precip_t0", "sheet_precip_t1").withColumnRenamed("sheet_precip_48", "row_key").dropna()
    numeric = ["tide_level", "hours_since_last", "current", "temperature_f", "ghcn_precip_in", "ghcn_precip_in_48"]
    model, train, test = train_classifier(rows, "quality", QUALITY_LEVELS, numeric, ["water_body"], "row_key", trees=10, depth=5)
    return evaluate(model, {"train": train, "test": test}, "quality", QUALITY_LEVELS)


AGREE = f"""{d.SAMPLES}, {CITY[:CITY.index("r AS")].rstrip().rstrip(",")}, a AS (SELECT s.date, avg(bacteria) AS precip_week, avg(bacteria / 7) AS precip_t0, any_value(rain) AS rain, any_value(rain_7d) AS rain_7d FROM samples s LEFT JOIN g ON g.date = s.date GROUP BY 1)"""


def _agreement(spark, sf):
    from envspark.operators import roll_sum

    s = d.samples(spark, sf).select("date", F.col("bacteria").alias("precip_week"), (F.col("bacteria") / 7).alias("precip_t0"))
    reference = roll_sum(_city(spark, sf).withColumn("series", F.lit("all")), ["series"], "date", "rain", 7, "rain_7d")
    return reports.rain_agreement(s, reference)


@query("q27_rain_agreement", f"WITH {AGREE} SELECT strftime(date, '%Y-%m-%d') AS date, round(precip_week, 6) AS precip_week, round(precip_t0, 6) AS precip_t0, round(rain, 6) AS rain, round(rain_7d, 6) AS rain_7d FROM a")
def _(spark, sf):
    return shown(_agreement(spark, sf))


@query("q27_rain_trend", f"WITH {AGREE} SELECT count(rain) AS n, round(regr_slope(precip_t0, rain), 5) AS slope, round(regr_intercept(precip_t0, rain), 5) AS intercept, round(regr_r2(precip_t0, rain), 6) AS r2 FROM a")
def _(spark, sf):
    out = reports.rain_trend(_agreement(spark, sf))
    return out.select("n", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("q26_unsafe_share_by_site", f"WITH {d.SAMPLES} SELECT site_id, round(count(*) FILTER (bacteria > 104) / count(*), 6) AS unsafe FROM samples GROUP BY 1")
def _(spark, sf):
    return shown(reports.level_shares(d.samples(spark, sf), ["site_id"], F.col("bacteria") > 104, "unsafe"))
