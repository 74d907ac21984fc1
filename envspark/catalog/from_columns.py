"""F1–F29: column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, shown, table
from envspark.functions import (
    annualised,
    at_time,
    bin_index,
    c_to_f,
    censor_flag,
    compass16,
    current_index,
    cut,
    day_name,
    direction,
    extract,
    great_circle_km,
    hms_text,
    hours_between,
    is_in,
    label_text,
    log_capped,
    mid_tenths,
    mm_to_in,
    parse_censored,
    parse_ts,
    remove_first,
    replace_first,
    row_max,
    row_sum,
    season_index,
    seconds_of_day,
    thousands,
)
from envspark.functions.measures import DASHBOARD_BREAKS, DASHBOARD_LEVELS, ENTEROCOCCI_BREAKS, FECAL_BREAKS, QUALITY_LEVELS
from envspark.operators.bins import bin_equal, label_bins


@query(
    "f1_great_circle",
    f"""WITH {d.SITES} SELECT site_id, round({d.KM.format(lat1="latitude", lon1="longitude", lat2="40.7", lon2="-74.0")}, 6) AS km FROM sites WHERE latitude IS NOT NULL""",
)
def _(spark, sf):
    s = d.sites(spark, sf).filter("latitude IS NOT NULL")
    return shown(s.select("site_id", great_circle_km("latitude", "longitude", F.lit(40.7), F.lit(-74.0)).alias("km")))


@query(
    "f2_current_index",
    f"""WITH {d.TURNS}, {d.PHASES} SELECT turn_id, round(tide_range_ft * sin(pi() * 1.5 / nullif(tide_duration_hrs, 0)), 6) AS current FROM phases WHERE tide_duration_hrs > 0""",
)
def _(spark, sf):
    from envspark.operators.windows import phase_features

    t = phase_features(d.turns(spark, sf), "tide_noaa_id", "datetime", "tide_level").filter("tide_duration_hrs > 0")
    return shown(t.select("turn_id", current_index(F.lit(1.5), "tide_range_ft", "tide_duration_hrs").alias("current")))


@query("f3_fahrenheit", "SELECT event_id, round(value * 9 / 5 + 32, 6) AS f, round((value * 10 + user_id) / 20, 6) AS mid FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return shown(e.select("event_id", c_to_f("value").alias("f"), mid_tenths(F.col("value") * 10, "user_id").alias("mid")))


@query("f4_inches", "SELECT event_id, round(value * 0.039::DOUBLE, 6) AS inches, round(value / 10 * 0.039::DOUBLE, 6) AS tenths, round(value / 100 / 25.4, 6) AS exact FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return shown(
        e.select(
            "event_id",
            mm_to_in("value").alias("inches"),
            mm_to_in("value", scale=10).alias("tenths"),
            (F.col("value") / 100 / 25.4).alias("exact"),
        )
    )


POINTS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"


@query("f5_compass", f"SELECT event_id, {POINTS}[CAST(floor((event_id % 1440 / 4.0 + 11.25) / 22.5) AS BIGINT) % 16 + 1] AS point FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", compass16(F.col("event_id") % 1440 / F.lit(4.0)).alias("point"))


@query(
    "f6_direction",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN {POINTS}[CAST(floor((event_id % 360 + 11.25) / 22.5) AS BIGINT) % 16 + 1] WHEN 1 THEN 'slack' WHEN 2 THEN 'NE' END AS direction FROM events""",
)
def _(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, (e % 360).cast("string")).when(e % 4 == 1, F.lit("slack")).when(e % 4 == 2, F.lit("NE"))
    return table(spark, sf, "events").select("event_id", direction(text).alias("direction"))


@query(
    "f7_classes",
    f"""SELECT event_id, {d.CLASS.format("value")} AS quality,
      CASE WHEN value > -1 AND value <= 200 THEN 'Safe' WHEN value > 200 AND value <= 1000 THEN 'Caution' WHEN value > 1000 THEN 'Unsafe' END AS fecal,
      CASE WHEN v > -1 AND v <= 0 THEN 'NotDetected' WHEN v > 0 AND v <= 35 THEN 'Good' WHEN v > 35 AND v <= 104 THEN 'Fair' WHEN v > 104 AND v <= 49999 THEN 'Unacceptable' END AS dashboard
    FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN -2 WHEN event_id % 9 = 1 THEN 0 WHEN event_id % 9 = 2 THEN 50000 WHEN event_id % 9 = 3 THEN 35 ELSE value END AS v FROM events)""",
)
def _(spark, sf):
    e = F.col("event_id") % 9
    v = F.when(e == 0, F.lit(-2.0)).when(e == 1, F.lit(0.0)).when(e == 2, F.lit(50000.0)).when(e == 3, F.lit(35.0)).otherwise(F.col("value"))
    return table(spark, sf, "events").select(
        "event_id",
        cut("value", ENTEROCOCCI_BREAKS, QUALITY_LEVELS).alias("quality"),
        cut("value", FECAL_BREAKS, QUALITY_LEVELS).alias("fecal"),
        cut(v, DASHBOARD_BREAKS, DASHBOARD_LEVELS).alias("dashboard"),
    )


@query(
    "f8_equal_width_bins",
    """WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, CAST(least(greatest(ceil((value - lo) / (hi - lo) * 5), 1), 5) AS BIGINT) AS value_bin FROM events, m""",
)
def _(spark, sf):
    return shown(bin_equal(table(spark, sf, "events").select("event_id", "value"), "value", 5).select("event_id", "value_bin"))


@query("f8_fixed_range_bins", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(greatest(ceil((l_quantity - 1) / 49 * 10), 1), 10) AS BIGINT) AS bin FROM lineitem")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    return shown(l.select("l_orderkey", "l_linenumber", "l_partkey", bin_index("l_quantity", F.lit(1), F.lit(50), 10).alias("bin")))


@query("f9_season", "SELECT o_orderkey, CAST(7 - abs(month(o_orderdate) - 7) AS BIGINT) AS season FROM orders")
def _(spark, sf):
    return shown(table(spark, sf, "orders").select("o_orderkey", season_index("o_orderdate").alias("season")))


@query("f10_day_name", "SELECT o_orderkey, ['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][dayofweek(o_orderdate) + 1] AS day FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", day_name("o_orderdate").alias("day"))


@query("f11_year_month", "SELECT year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf):
    return shown(
        table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "f12_date_shift",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 2, '%Y-%m-%d') AS two_before, strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d') AS next FROM orders",
)
def _(spark, sf):
    day = F.to_date("o_orderdate")
    return shown(table(spark, sf, "orders").select("o_orderkey", F.date_sub(day, 2).alias("two_before"), F.date_add(day, 1).alias("next")))


@query("f13_hours_between", "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 3.6e9, 4) AS hours FROM events")
def _(spark, sf):
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return shown(table(spark, sf, "events").select("event_id", hours_between(F.col("ts"), noon).alias("hours")), 4)


@query(
    "f14_duration_text",
    """
    WITH s AS (SELECT event_id, CAST(floor(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 1000000) AS BIGINT) AS s FROM events)
    SELECT event_id, concat_ws(' ', CASE WHEN s >= 3600 THEN (s // 3600) || 'H' END, CASE WHEN s >= 60 THEN (s % 3600 // 60) || 'M' END,
      CASE WHEN s % 60 > 0 OR s < 60 THEN (s % 60) || 'S' END) AS gap FROM s
    """,
)
def _(spark, sf):
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", hms_text(noon, F.col("ts")).alias("gap"))


@query(
    "f15_date_and_time",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)), '%Y-%m-%d %H:%M') END AS at,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1440 * 60 END AS seconds FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 1440
    clock = F.when(F.col("o_orderkey") % 5 != 0, F.format_string("%d:%02d", F.floor(k / 60), k % 60)).otherwise(F.lit("unknown"))
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), clock.alias("clock"))
    return o.select(
        "o_orderkey", F.date_format(at_time("d", "clock"), "yyyy-MM-dd HH:mm").alias("at"), seconds_of_day("clock").cast("long").alias("seconds")
    )


@query(
    "f16_many_formats",
    """SELECT o_orderkey, strftime(o_orderdate + to_minutes(CAST(CASE o_orderkey % 4 WHEN 0 THEN 720 WHEN 1 THEN 720 ELSE o_orderkey % 1440 END AS BIGINT)), '%Y-%m-%d %H:%M') AS at FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 1440
    h = F.floor(k / 60)
    half = F.format_string("%d:%02d %s", F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12), k % 60, F.when(h < 12, F.lit("AM")).otherwise(F.lit("pm")))
    clock = (
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderkey") % 4 == 1, F.lit("morning"))
        .when(F.col("o_orderkey") % 4 == 2, half)
        .otherwise(F.format_string("%d:%02d", h, k % 60))
    )
    stamp = parse_ts(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), clock)
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(stamp, "yyyy-MM-dd HH:mm").alias("at"))


@query("f17_zone_change", "SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS local FROM events")
def _(spark, sf):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return shown(table(spark, sf, "events").select("event_id", local.alias("local")))


@query("f18_replace_first", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS masked FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", replace_first("p_name", "[aeiou]", "*").alias("masked"))


@query("f19_remove_first", "SELECT c_custkey, regexp_replace(c_name, 'Customer#0*', '') AS short, regexp_replace(c_mktsegment, 'A', '') AS segment FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", remove_first("c_name", "Customer#0*").alias("short"), remove_first("c_mktsegment", "A").alias("segment")
    )


@query(
    "f20_extract",
    """SELECT conv_id, turn, nullif(regexp_extract(text, '[0-9]+'), '') AS number, CAST(regexp_matches(text, '[.]$') AS VARCHAR) AS full_stop FROM conversations""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", extract("text", "[0-9]+").alias("number"), F.col("text").rlike(r"[.]\z").cast("string").alias("full_stop"))


@query(
    "f21_text_shapes",
    "SELECT c_custkey, lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS month, concat_ws('-', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS pasted, upper(c_name) AS loud, c_mktsegment[1] || lower(c_mktsegment[2:]) AS title FROM customer",
)
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0").alias("month"),
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("pasted"),
        F.upper("c_name").alias("loud"),
        F.initcap("c_mktsegment").alias("title"),
    )


@query(
    "f22_censored_values",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE l_linenumber % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 3 THEN NULL WHEN 6 THEN NULL ELSE l_quantity END AS value,
      CASE l_linenumber % 7 WHEN 0 THEN '<' WHEN 1 THEN 'trace' WHEN 2 THEN '>' WHEN 6 THEN '<' END AS censor FROM lineitem""",
)
def _(spark, sf):
    q = F.col("l_quantity").cast("string")
    forms = [F.lit("<10"), F.lit("Trace"), F.concat(F.lit(">"), q), F.lit("N/A"), F.concat(q, F.lit(" (3 in)")), q, F.lit("<100")]
    text = F.element_at(F.array(*forms), (F.col("l_linenumber") % 7 + 1).cast("int"))
    l = table(spark, sf, "lineitem").withColumn("text", text)
    return shown(l.select("l_orderkey", "l_linenumber", "l_partkey", parse_censored("text").alias("value"), censor_flag("text").alias("censor")))


@query(
    "f23_row_sum",
    "SELECT event_id, round(coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0) + coalesce(CASE WHEN event_id % 2 <> 0 THEN value * 2 END, 0), 6) AS total FROM events",
)
def _(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    return shown(table(spark, sf, "events").select("event_id", row_sum(F.when(e % 3 != 0, v), F.when(e % 2 != 0, v * 2)).alias("total")))


@query(
    "f24_row_max",
    "SELECT event_id, round(greatest(CASE WHEN event_id % 3 <> 0 THEN value END, CASE WHEN event_id % 2 <> 0 THEN 35.0::DOUBLE END), 6) AS top FROM events",
)
def _(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    return shown(table(spark, sf, "events").select("event_id", row_max(F.when(e % 3 != 0, v), F.when(e % 2 != 0, F.lit(35.0))).alias("top")))


@query(
    "f25_logs",
    "SELECT event_id, round(least(ln(value + 1), 4.0), 6) AS capped, CASE WHEN event_id % 4 <> 0 THEN round(ln(nullif(value, 0)) * 100, 6) END AS radius FROM events",
)
def _(spark, sf):
    zero = F.when(F.col("event_id") % 4 != 0, F.col("value")).otherwise(F.lit(0.0))
    return shown(
        table(spark, sf, "events").select("event_id", log_capped("value", cap=4.0).alias("capped"), log_capped(zero, scale=100.0, plus_one=False).alias("radius"))
    )


@query("f26_thousands", "SELECT o_orderkey, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS text, round(o_totalprice) AS whole FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", thousands("o_totalprice").alias("text"), F.round("o_totalprice").alias("whole"))


@query(
    "f27_bin_labels",
    """WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, ['darkblue','blue','lightblue','yellow','tomato'][CAST(least(greatest(ceil((value - lo) / (hi - lo) * 5), 1), 5) AS BIGINT)] AS colour FROM events, m""",
)
def _(spark, sf):
    binned = bin_equal(table(spark, sf, "events").select("event_id", "value"), "value", 5)
    return label_bins(binned, "value_bin", ["darkblue", "blue", "lightblue", "yellow", "tomato"], "colour").select("event_id", "colour")


@query("f28_labels", "SELECT c_custkey, printf('%s in nation %d (%s)', c_name, c_nationkey, c_mktsegment) AS label FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", label_text("%s in nation %d (%s)", "c_name", "c_nationkey", "c_mktsegment").alias("label"))


@query(
    "f29_null_safe_membership",
    "SELECT event_id, CAST(coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END IN ('click', 'view'), false) AS VARCHAR) AS hit FROM events",
)
def _(spark, sf):
    sometimes = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return shown(table(spark, sf, "events").select("event_id", is_in(sometimes, ["click", "view"]).alias("hit")))


@query("ag6_annualised", "SELECT user_id, round(avg(value) * 365, 6) AS yearly, round(avg(value) * 52, 6) AS weekly FROM events GROUP BY 1")
def _(spark, sf):
    return shown(table(spark, sf, "events").groupBy("user_id").agg(annualised("value", 365).alias("yearly"), annualised("value", 52).alias("weekly")))
