"""AG1–AG19: aggregation, profiles and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, shown, table
from envspark.functions import annualised, share
from envspark.operators import (
    box_stats,
    corr_matrix,
    first_last,
    group_median,
    with_place,
    histogram,
    null_profile,
    profile,
    profile_text,
    reference_agreement,
    roll_sum,
    site_summary,
    top_k,
    trend,
    with_totals,
    yearly_trend,
)


@query(
    "ag1_group_statistics",
    """SELECT user_id, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(sum(v), 4) AS total, round(min(v), 6) AS low, round(max(v), 6) AS high
    FROM (SELECT user_id, CASE WHEN event_id % 9 <> 0 THEN value END AS v FROM events) GROUP BY 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))
    stats = e.groupBy("user_id").agg(F.avg("v").alias("mean"), F.round(F.sum("v"), 4).alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    return shown(stats.join(group_median(e, ["user_id"], "v", "median"), "user_id"))


@query("ag2_tally", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("ag3_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))


@query("ag4_distinct_then_count", "SELECT year(o_orderdate) AS year, count(*) AS n FROM (SELECT DISTINCT o_orderdate, o_custkey FROM orders) GROUP BY 1")
def _(spark, sf):
    pairs = table(spark, sf, "orders").select("o_orderdate", "o_custkey").distinct()
    return shown(pairs.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n")))


@query("ag5_conditional_share", "SELECT user_id, round(sum(CASE WHEN value > 104 THEN 1 ELSE 0 END) / count(*), 6) AS unsafe FROM events GROUP BY 1")
def _(spark, sf):
    return shown(table(spark, sf, "events").groupBy("user_id").agg(share(F.col("value") > 104).alias("unsafe")))


@query("ag7_filter_after", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) > 60")
def _(spark, sf):
    return shown(table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).filter("n > 60"))


@query(
    "ag8_null_profile",
    """SELECT 'kind' AS variable, count(*) FILTER (event_id % 3 = 0) AS num_missing FROM events UNION ALL SELECT 'value', count(*) FILTER (event_id % 4 = 1) FROM events UNION ALL SELECT 'user_id', 0 FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = F.col("event_id")
    holes = table(spark, sf, "events").select(F.when(e % 3 != 0, F.col("event_type")).alias("kind"), F.when(e % 4 != 1, F.col("value")).alias("value"), "user_id")
    return null_profile(holes)


def _profile_sql(name: str, v: str) -> str:
    return f"""SELECT '{name}' AS variable, count(*) FILTER ({v} IS NULL) AS n_missing, round(count({v}) / count(*), 6) AS complete_rate, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS sd,
      round(min({v}), 6) AS p0, round(quantile_cont({v}, 0.25), 6) AS p25, round(median({v}), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75, round(max({v}), 6) AS p100 FROM v"""


@query(
    "ag9_profile_numbers",
    "WITH v AS (SELECT l_quantity, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS price, l_discount FROM lineitem) "
    + " UNION ALL ".join(_profile_sql(n, n) for n in ("l_quantity", "price", "l_discount")),
)
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_quantity", F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("price"), "l_discount")
    out = profile(l, ["l_quantity", "price", "l_discount"])
    return shown(out.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)}))


@query(
    "ag9_profile_texts",
    """WITH l AS (SELECT 'event_type' AS variable, event_type AS value FROM events UNION ALL SELECT 'kind', CASE WHEN event_id % 3 <> 0 THEN event_type || (user_id % 3) END FROM events),
    c AS (SELECT variable, value, count(*) AS n FROM l GROUP BY 1, 2),
    t AS (SELECT variable, string_agg(value || ': ' || n, ', ' ORDER BY rn) AS top_counts FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS rn FROM c WHERE value IS NOT NULL) WHERE rn <= 4 GROUP BY 1)
    SELECT variable, count(*) FILTER (value IS NULL) AS n_missing, round(count(value) / count(*), 6) AS complete_rate, count(DISTINCT value) AS n_unique, any_value(top_counts) AS top_counts FROM l JOIN t USING (variable) GROUP BY 1""",
)
def _(spark, sf):
    kind = F.when(F.col("event_id") % 3 != 0, F.concat("event_type", (F.col("user_id") % 3).cast("string")))
    return shown(profile_text(table(spark, sf, "events").select("event_type", kind.alias("kind")), ["event_type", "kind"]))


@query(
    "ag10_first_last",
    """WITH e AS (SELECT user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS lat, CASE WHEN event_id % 5 <> 0 THEN event_id END AS id FROM events)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, round(arg_max(lat, ts) FILTER (lat IS NOT NULL AND id IS NOT NULL), 6) AS lat,
      arg_max(id, ts) FILTER (lat IS NOT NULL AND id IS NOT NULL) AS id FROM e GROUP BY 1""",
)
def _(spark, sf):
    from envspark.functions.times import position

    k = F.col("event_id")
    e = table(spark, sf, "events").select("user_id", "ts", F.when(k % 3 != 0, F.col("value")).alias("lat"), F.when(k % 5 != 0, k).alias("id"))
    out = first_last(e, "user_id", "ts", ["lat", "id"])
    return shown(out.select("user_id", position(out, "first_ts").alias("first_us"), position(out, "last_ts").alias("last_us"), "lat", "id"))


@query(
    "ag11_histogram",
    """WITH l AS (SELECT 'l_quantity' AS variable, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
    m AS (SELECT variable, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1)
    SELECT variable, CAST(least(floor((v - lo) / ((hi - lo) / 20)) + 1, 20) AS BIGINT) AS bin, count(*) AS n, round(any_value(lo + (least(floor((v - lo) / ((hi - lo) / 20)) + 1, 20) - 1) * ((hi - lo) / 20)), 4) AS bin_start
    FROM l JOIN m USING (variable) GROUP BY 1, 2""",
)
def _(spark, sf):
    return shown(histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 20), 4)


BOX = """WITH q AS (SELECT {by} AS g, count({v}) AS n, quantile_cont({v}, 0.25) AS q1, median({v}) AS med, quantile_cont({v}, 0.75) AS q3 FROM {t} GROUP BY 1)
    SELECT g AS {by}, n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(min({v}) FILTER (inside), 6) AS whisker_low, round(max({v}) FILTER (inside), 6) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers
    FROM (SELECT *, {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM {t} JOIN q ON g = {by}) GROUP BY ALL"""


@query("ag12_box_statistics", BOX.format(by="event_type", v="value", t="events"))
def _(spark, sf):
    return shown(box_stats(table(spark, sf, "events"), ["event_type"], "value"))


@query("ag13_site_summary", "SELECT user_id, count(*) AS n_obs, round(median(value), 6) AS median_value FROM events GROUP BY 1 HAVING count(*) > 60")
def _(spark, sf):
    return shown(site_summary(table(spark, sf, "events"), ["user_id"], "value", 60))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "ag14_correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS variable, '{b}' AS other, {'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 6)'} AS corr FROM lineitem{' GROUP BY 1' if a == b else ''}" for a in CORR for b in CORR
    ),
)
def _(spark, sf):
    return shown(corr_matrix(table(spark, sf, "lineitem"), CORR))


@query(
    "ag15_linear_trend",
    "SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    out = trend(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return shown(out.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4)}))


@query(
    "ag16_totals",
    """SELECT coalesce(user, 'Total') AS user, click, view, click + view AS "Total" FROM
    (SELECT CAST(user_id AS VARCHAR) AS user, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY ROLLUP (CAST(user_id AS VARCHAR)))""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("user", F.col("user_id").cast("string"))
    wide = e.groupBy("user").agg(*[F.sum((F.col("event_type") == k).cast("long")).alias(k) for k in ("click", "view")])
    return with_totals(wide, "user", ["click", "view"])


@query(
    "ag17_weekly_against_reference",
    """WITH days AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS precip_week, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS precip_t0 FROM events GROUP BY 1),
    g AS (SELECT CAST(ts AS DATE) AS date, min(value) AS rain FROM events GROUP BY 1),
    w AS (SELECT date, rain, CASE WHEN count(rain) OVER f = 7 THEN sum(rain) OVER f END AS rain_7d FROM g WINDOW f AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT strftime(date, '%Y-%m-%d') AS date, round(precip_week, 6) AS precip_week, round(precip_t0, 6) AS precip_t0, round(rain, 6) AS rain, round(rain_7d, 6) AS rain_7d FROM days LEFT JOIN w USING (date)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    daily = e.select("date", F.col("value").alias("precip_week"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("precip_t0"))
    gauge = e.groupBy("date").agg(F.min("value").alias("rain")).withColumn("series", F.lit("all"))
    weekly = roll_sum(gauge, ["series"], "date", "rain", 7, "rain_7d").drop("series")
    return shown(reference_agreement(daily, "date", ["precip_week", "precip_t0"], weekly))


@query(
    "ag18_yearly_trend",
    """SELECT year(o_orderdate)::BIGINT AS year, count(DISTINCT o_custkey) AS n_sites, round(avg(o_totalprice / 1000) * 52, 4) AS rain, round(median(o_totalprice), 6) AS median_o_totalprice, round(median(o_custkey), 6) AS median_o_custkey FROM orders GROUP BY 1""",
)
def _(spark, sf):
    rain = {"rain": F.round(annualised(F.col("o_totalprice") / 1000, 52), 4)}
    return shown(yearly_trend(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"], rain, "o_custkey"))


@query("ag19_global_extreme", "SELECT epoch_us(max(ts)) AS last_us, round(max(value), 6) AS top, min(user_id) AS first_user FROM events")
def _(spark, sf):
    from envspark.functions.times import position

    out = table(spark, sf, "events").agg(F.max("ts").alias("last"), F.max("value").alias("top"), F.min("user_id").alias("first_user"))
    return shown(out.select(position(out, "last").alias("last_us"), "top", "first_user"))


@query("so1_sorted", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def _(spark, sf):
    placed = with_place(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], "place", descending=True)
    return placed.select("o_orderkey", "o_totalprice", "place").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("so2_first_after_sort", "SELECT user_id, arg_max(event_id, ts) AS newest, arg_min(event_id, ts) AS oldest FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("newest"), F.min_by("event_id", "ts").alias("oldest"))


@query(
    "so4_ordered_categories",
    "SELECT p_type, round(m, 6) AS median_price, row_number() OVER (ORDER BY m, p_type) AS place FROM (SELECT p_type, median(p_retailprice) AS m FROM part GROUP BY 1)",
)
def _(spark, sf):
    medians = group_median(table(spark, sf, "part"), ["p_type"], "p_retailprice", "median_price").drop("n")
    return shown(with_place(medians, "median_price", ["p_type"], "place"))


@query(
    "w6_top_k_with_ties",
    "WITH s AS (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l_suppkey, round(m, 6) AS median_l_quantity FROM s WHERE m >= (SELECT min(m) FROM (SELECT m FROM s ORDER BY m DESC LIMIT 10))",
)
def _(spark, sf):
    s = group_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity").drop("n")
    return shown(top_k(s, "median_l_quantity", 10, once=True))


@query(
    "w6_bottom_k_without_ties",
    "SELECT l_suppkey, round(m, 6) AS median_l_quantity FROM (SELECT l_suppkey, median(l_quantity) AS m FROM lineitem GROUP BY 1) ORDER BY m, l_suppkey LIMIT 10",
)
def _(spark, sf):
    s = group_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity").drop("n")
    return shown(top_k(s, "median_l_quantity", 10, ties=False, largest=False))


@query("ag1_hourly_levels", f"WITH {d.SAMPLES} SELECT site_id, hour(sample_time)::BIGINT AS hour, count(*) AS n, round(max(bacteria), 6) AS top FROM samples GROUP BY 1, 2")
def _(spark, sf):
    s = d.samples(spark, sf)
    return shown(s.groupBy("site_id", F.hour("sample_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("bacteria").alias("top")))
