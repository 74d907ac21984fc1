"""The domain's tables as they are derived from the given ones, in Spark and as SQL fragments.

===========  ==============================================================
sites        customers, on a regular scatter around the harbour
stations     suppliers, likewise
samples      events: site = user, level = value
turns        purchase events: station = user, level = value
weather      events of a user group and day: mean value as temperature,
             a tenth of the smallest value as rain, some of both missing
===========  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.catalog.base import table

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    located = k % 50 != 7
    return table(spark, sf, "customer").select(
        k.cast("string").alias("site_id"),
        F.col("c_name").alias("site"),
        F.when(located, F.lit(40.4) + (k % 97) / F.lit(100.0)).alias("latitude"),
        F.when(located, F.lit(-74.3) + (k % 89) / F.lit(100.0)).alias("longitude"),
        F.col("c_mktsegment").alias("water_body"),
        (k % 3 != 0).alias("currently_testing"),
    )


SITES = """sites AS (SELECT CAST(c_custkey AS VARCHAR) AS site_id, c_name AS site,
  CASE WHEN c_custkey % 50 <> 7 THEN 40.4 + (c_custkey % 97) / 100.0 END AS latitude,
  CASE WHEN c_custkey % 50 <> 7 THEN -74.3 + (c_custkey % 89) / 100.0 END AS longitude,
  c_mktsegment AS water_body, c_custkey % 3 <> 0 AS currently_testing FROM customer)"""


def stations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.format_string("S%06d", k).alias("id"),
        F.col("s_name").alias("name"),
        (F.lit(40.4) + (k * 7 % 101) / F.lit(100.0)).alias("latitude"),
        (F.lit(-74.3) + (k * 13 % 83) / F.lit(100.0)).alias("longitude"),
        F.element_at(F.array(F.lit("TMAX"), F.lit("TMIN"), F.lit("PRCP")), (k % 3 + 1).cast("int")).alias("element"),
        (F.lit(2005) + k % 10).cast("int").alias("first_year"),
        (F.lit(2020) + k % 5).cast("int").alias("last_year"),
    )


STATIONS = """stations AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, s_name AS name,
  40.4 + ((s_suppkey * 7) % 101) / 100.0 AS latitude, -74.3 + ((s_suppkey * 13) % 83) / 100.0 AS longitude,
  CASE s_suppkey % 3 WHEN 0 THEN 'TMAX' WHEN 1 THEN 'TMIN' ELSE 'PRCP' END AS element,
  2005 + s_suppkey % 10 AS first_year, 2020 + s_suppkey % 5 AS last_year FROM supplier)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("site_id"),
        F.concat(F.lit("site "), F.col("user_id").cast("string")).alias("site"),
        F.col("ts").alias("sample_time"),
        F.to_date("ts").alias("date"),
        F.col("value").alias("bacteria"),
        "event_type",
    )


SAMPLES = """samples AS (SELECT event_id, CAST(user_id AS VARCHAR) AS site_id, 'site ' || user_id AS site, ts AS sample_time,
  CAST(ts AS DATE) AS date, value AS bacteria, event_type FROM events)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("turn_id"),
        F.to_date("ts").alias("date"),
        F.col("ts").alias("datetime"),
        F.col("user_id").cast("string").alias("tide_noaa_id"),
        F.col("value").alias("tide_level"),
        F.when(F.col("event_id") % 2 == 0, F.lit("H")).otherwise(F.lit("L")).alias("hi_lo"),
        (F.col("event_id") % 7 != 0).alias("good_tide_station"),
    )


TURNS = """turns AS (SELECT event_id AS turn_id, CAST(ts AS DATE) AS date, ts AS datetime, CAST(user_id AS VARCHAR) AS tide_noaa_id,
  value AS tide_level, CASE WHEN event_id % 2 = 0 THEN 'H' ELSE 'L' END AS hi_lo, event_id % 7 <> 0 AS good_tide_station
  FROM events WHERE event_type = 'purchase')"""

PHASES = """phases AS (SELECT *, lead(tide_level) OVER w - tide_level AS tide_range_ft,
  CASE WHEN epoch_us(lead(datetime) OVER w) - epoch_us(datetime) <= 8 * 3600000000
       THEN (epoch_us(lead(datetime) OVER w) - epoch_us(datetime)) / 3.6e9 END AS tide_duration_hrs
  FROM turns WINDOW w AS (PARTITION BY tide_noaa_id ORDER BY datetime))"""


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """One row per gauge (a tenth of the users share one) and day on which any of the gauge's events fell."""
    gauge = (F.col("user_id") % 40).cast("string")
    daily = table(spark, sf, "events").groupBy(
        F.to_date("ts").alias("date"), F.concat(F.lit("G"), gauge).alias("ghcn_station_id"), F.concat(F.lit("gauge "), gauge).alias("ghcn_station_name")
    )
    out = daily.agg(F.avg("value").alias("_mean"), F.min("value").alias("_least"), F.min("event_id").alias("_e"))
    return out.select(
        "date",
        "ghcn_station_id",
        "ghcn_station_name",
        F.when(F.col("_e") % 6 != 0, F.col("_mean") * 0.91374891).alias("temperature_f"),
        F.when(F.col("_e") % 5 != 0, F.col("_least") / 10).alias("precip_in"),
    )


WEATHER = """weather AS (SELECT date, 'G' || g AS ghcn_station_id, 'gauge ' || g AS ghcn_station_name,
  CASE WHEN e % 6 <> 0 THEN m * 0.91374891::DOUBLE END AS temperature_f, CASE WHEN e % 5 <> 0 THEN l / 10 END AS precip_in
  FROM (SELECT CAST(ts AS DATE) AS date, CAST(user_id % 40 AS VARCHAR) AS g, avg(value) AS m, min(value) AS l, min(event_id) AS e
        FROM events GROUP BY 1, 2))"""


def station_key(spark: SparkSession, sf: str) -> DataFrame:
    """Every sampling site's tide station and gauges; some links are missing."""
    users = table(spark, sf, "events").select("user_id").distinct()
    u = F.col("user_id")
    return users.select(
        F.concat(F.lit("site "), u.cast("string")).alias("site"),
        u.cast("string").alias("site_id"),
        F.when(u % 11 != 5, (u % 70).cast("string")).alias("tide_noaa_id"),
        F.when(u % 13 != 6, F.concat(F.lit("G"), (u % 45).cast("string"))).alias("precip_ghcn_id"),
        F.concat(F.lit("G"), (u * 3 % 45).cast("string")).alias("temperature_ghcn_id"),
    )


KEY = """key AS (SELECT 'site ' || user_id AS site, CAST(user_id AS VARCHAR) AS site_id,
  CASE WHEN user_id % 11 <> 5 THEN CAST(user_id % 70 AS VARCHAR) END AS tide_noaa_id,
  CASE WHEN user_id % 13 <> 6 THEN 'G' || (user_id % 45) END AS precip_ghcn_id,
  'G' || (user_id * 3 % 45) AS temperature_ghcn_id FROM (SELECT DISTINCT user_id FROM events))"""

KM = """2 * 6371.0 * atan2(sqrt(least(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 1.0)),
  sqrt(1.0 - least(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 1.0)))"""


def nearest_sql(left: str, right: str, out: str, id: str = "id", lat: str = "latitude", lon: str = "longitude", key: str = "site_id") -> str:
    """CTE ``out``: key, id and km of the nearest right row of every left row that has coordinates."""
    km = KM.format(lat1="a.latitude", lon1="a.longitude", lat2=f"b.{lat}", lon2=f"b.{lon}")
    return f"""{out} AS (SELECT {key}, {id} AS near_id, km FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(km, 6), {id}) AS rn
  FROM (SELECT a.{key}, b.{id}, {km} AS km FROM {left} a, {right} b WHERE a.latitude IS NOT NULL)) WHERE rn = 1)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Truth from an event's value, prediction from the user's previous one, scores that sum to 1."""
    from envspark.functions.measures import ENTEROCOCCI_BREAKS, QUALITY_LEVELS, cut
    from envspark.functions.times import position
    from envspark.operators.slices import POS, TIME_BITS, over_order

    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    ev = ev.withColumn(POS, position(ev, "ts"))
    ev = over_order(ev, ["user_id"], [F.col(POS), F.col("event_id")], lambda w: {"prev": F.lag("value").over(w)}, before=1, bits=TIME_BITS)
    v = F.col("prev")
    return ev.filter(v.isNotNull()).select(
        "event_id",
        cut("value", ENTEROCOCCI_BREAKS, QUALITY_LEVELS).alias("quality"),
        cut("prev", ENTEROCOCCI_BREAKS, QUALITY_LEVELS).alias(".pred_class"),
        (F.lit(34.0) / (v + 138)).alias(".pred_Safe"),
        (F.lit(104.0) / (v + 138)).alias(".pred_Caution"),
        (v / (v + 138)).alias(".pred_Unsafe"),
    )


CLASS = "CASE WHEN {0} > -1 AND {0} <= 34 THEN 'Safe' WHEN {0} > 34 AND {0} <= 104 THEN 'Caution' WHEN {0} > 104 THEN 'Unsafe' END"
SCORED = f"""scored AS (SELECT event_id, {CLASS.format("value")} AS quality, {CLASS.format("prev")} AS pred,
  34.0::DOUBLE / (prev + 138) AS p_safe, 104.0::DOUBLE / (prev + 138) AS p_caution, prev / (prev + 138) AS p_unsafe
  FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL)"""
