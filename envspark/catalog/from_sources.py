"""IO1–IO9: scans, sinks and landing shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog.base import query, r, scratch, shown, table
from envspark.operators.project import drop_na
from envspark.sources import (
    calendar_to_events,
    explode_predictions,
    export_csv,
    normalise_sheet,
    read_csv,
    read_json,
    read_table,
    request_grid,
    write_table,
)


@query("io1_parquet_scan", "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value > 100 AND event_type = 'click'")
def _(spark, sf):
    events = read_table(
        spark, f"{sf}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    )
    return shown(events.filter("value > 100 AND event_type = 'click'").select("event_id", "user_id", "value"))


@query(
    "io2_parquet_write",
    "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, round(max(value), 6) AS top FROM events WHERE event_type IN ('click', 'view') GROUP BY 1",
)
def _(spark, sf):
    path = scratch(spark, "events")
    write_table(table(spark, sf, "events"), path, partition_by=["event_type"])
    back = read_table(spark, path).filter("event_type IN ('click', 'view')")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), r(F.max("value")).alias("top"))


@query(
    "io3_csv_scan",
    "SELECT o_orderkey, trim(o_orderpriority) AS o_orderpriority, 'Buoy \"' || (o_orderkey % 40) || '\"' AS buoy, round(o_totalprice, 6) AS o_totalprice FROM orders",
)
def _(spark, sf):
    path = scratch(spark, "orders-csv")
    padded = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("Order, Priority"),
        F.concat(F.lit(' Buoy "'), (F.col("o_orderkey") % 40).cast("string"), F.lit('"')).alias("buoy"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
    )
    # blanks and bare quotes are landed as they are
    padded.write.csv(path, header=True, escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return shown(read_csv(spark, path, "o_orderkey long, o_orderpriority string, buoy string, o_totalprice double"))


@query(
    "io4_csv_export",
    "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
def _(spark, sf):
    paths = export_csv({n: table(spark, sf, n) for n in ("customer", "nation")}, scratch(spark, "export"))
    customer = read_csv(spark, paths["customer"], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    nation = read_csv(spark, paths["nation"], "n_nationkey int, n_name string, n_regionkey int")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "io5_json_rows",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, round(value, 6) AS value FROM events",
)
def _(spark, sf):
    path = scratch(spark, "rows-json")
    texts = table(spark, sf, "events").select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "event_type", "value")])
    texts.write.json(path)
    rows = read_json(spark, path, "event_id string, event_type string, value string")
    return shown(rows.withColumn("value", F.col("value").try_cast("double")))


@query(
    "io6_predictions",
    """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS s, date_trunc('minute', ts) AS t, value, event_type <> 'error' AS good FROM events)
    SELECT strftime(t, '%Y-%m-%d') AS date, epoch_us(t) AS at_us, s AS tide_noaa_id, round(value, 6) AS tide_level, 'H' AS hi_lo, CAST(good AS VARCHAR) AS good_tide_station FROM e
    UNION ALL
    SELECT strftime(t + INTERVAL 6 HOUR, '%Y-%m-%d'), epoch_us(t + INTERVAL 6 HOUR), s, CASE WHEN good THEN round(value / 2, 6) END, 'L', CAST(good AS VARCHAR) FROM e
    """,
)
def _(spark, sf):
    good = F.col("event_type") != "error"
    clock = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    answer = F.struct(
        F.array(
            F.struct(clock(F.col("ts")).alias("t"), F.col("value").cast("string").alias("v"), F.lit("H").alias("type")),
            F.struct(
                clock(F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("t"),
                F.when(good, (F.col("value") / 2).cast("string")).otherwise(F.lit("n/a")).alias("v"),
                F.lit("L").alias("type"),
            ),
        ).alias("predictions"),
        F.when(~good, F.struct(F.lit("no data").alias("message"))).alias("error"),
    )
    landed = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("station"), F.to_json(answer).alias("body"))
    rows = explode_predictions(landed, "body", "station")
    at = F.to_timestamp_ntz(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    out = rows.withColumn("at", at)
    from envspark.functions.times import position

    return shown(out.withColumn("at_us", position(out, "at")).drop("at", "datetime"))


@query(
    "io7_sheet_landing",
    """
    SELECT c_name AS site_name, CAST(c_nationkey AS VARCHAR) AS x2021_lab_analysis_by, CAST(c_acctbal AS DECIMAL(18, 2))::VARCHAR AS depth_ft
    FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 17 <> 5
    """,
)
def _(spark, sf):
    k = F.col("c_custkey")
    sheet = table(spark, sf, "customer").select(
        F.when(k % 10 != 3, F.col("c_name")).alias("Site Name"),
        F.lit("x").alias("...2"),
        F.col("c_nationkey").cast("string").alias("2021 Lab Analysis By"),
        F.when(k % 17 == 5, F.lit("(feet)")).otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("Depth (ft.)"),
        F.lit(None).cast("string").alias("_c7"),
    )
    return normalise_sheet(sheet, unit_row=F.col("depth_ft") == "(feet)")


@query(
    "io8_request_grid",
    """
    WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM orders GROUP BY 1)
    SELECT o_custkey, CAST(y AS BIGINT) AS year FROM f, generate_series(1995, 2001) g(y) WHERE y BETWEEN greatest(first_year, 1997) AND last_year
    """,
)
def _(spark, sf):
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year")
    )
    return shown(request_grid(spans, "first_year", "last_year", floor_year=1997).select("o_custkey", "year"))


@query(
    "io9_hi_lo_calendar",
    """
    WITH c AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, o_orderkey % 31 + 1 AS d, o_custkey % 12 + 1 AS h, o_orderkey % 60 AS mi,
                      o_totalprice / 1000 AS ft FROM orders),
    v AS (SELECT *, CAST(try_cast(ym || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS TIMESTAMP) AS t FROM c),
    e AS (SELECT o_orderkey, t, h % 12 AS hh, mi, ft, 'H' AS hi_lo FROM v UNION ALL
          SELECT o_orderkey, t, h % 12 + 12, mi, ft + 1, 'H' FROM v WHERE o_orderkey % 4 <> 0 UNION ALL
          SELECT o_orderkey, t, h % 12, 59 - mi, ft + 2, 'L' FROM v UNION ALL
          SELECT o_orderkey, t, h % 12 + 12, 59 - mi, NULL, 'L' FROM v)
    SELECT o_orderkey, strftime(t, '%Y-%m-%d') AS date, strftime(t + to_minutes(CAST(hh * 60 + mi AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at, round(ft, 6) AS tide_level, hi_lo
    FROM e WHERE t IS NOT NULL
    """,
)
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    clock = lambda m: F.concat((c % 12 + 1).cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))
    ft = F.col("o_totalprice") / 1000
    page = table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM").alias("ym"),
        (k % 31 + 1).cast("string").alias("daynum"),
        F.lit("Mon").alias("day_of_week"),
        clock(k % 60).alias("high_tide_am_time"),
        ft.cast("string").alias("high_tide_am_ft"),
        F.when(k % 4 != 0, clock(k % 60)).alias("high_tide_pm_time"),
        (ft + 1).cast("string").alias("high_tide_pm_ft"),
        clock(59 - k % 60).alias("low_tide_am_time"),
        (ft + 2).cast("string").alias("low_tide_am_ft"),
        clock(59 - k % 60).alias("low_tide_pm_time"),
        F.lit("-").alias("low_tide_pm_ft"),
    )
    events = calendar_to_events(page, "ym")
    return shown(events.withColumn("at", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")).drop("datetime"))


@query("io3_trimmed_station_names", "SELECT s_suppkey, 'B' || s_suppkey AS code, s_name || ' \"' || s_nationkey || '\"' AS station_name FROM supplier")
def _(spark, sf):
    from envspark.operators.reshape import separate

    path = scratch(spark, "names-csv")
    station = F.concat(F.lit(" B"), F.col("s_suppkey").cast("string"), F.lit(" "), "s_name", F.lit(' "'), F.col("s_nationkey").cast("string"), F.lit('"'))
    landed = table(spark, sf, "supplier").select("s_suppkey", station.alias(" Station"))
    landed.write.csv(path, header=True, escapeQuotes=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = read_csv(spark, path, "s_suppkey long, Station string")
    return drop_na(separate(rows, "Station", ["code", "station_name"], " "))
