"""J1–J18: joins in key, space and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, shown, table
from envspark.functions.times import hours_between, position
from envspark.operators import (
    asof_backward,
    asof_forward,
    asof_with_fallback,
    cohort,
    compare_assignments,
    join_renamed,
    left_join_with_default,
    natural_join,
    nearest,
    nearest_value,
    next_value,
)

CLICKS_BUYS = """clicks AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
  buys AS (SELECT event_id AS buy_id, user_id, ts AS buy_ts, value AS buy_value FROM events WHERE event_type = 'purchase')"""


def _clicks(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'click'").select("event_id", "user_id", "ts")


def _buys(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("buy_ts"), F.col("value").alias("buy_value")
    )


@query("j1_left_join", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS k, c_name FROM customer) ON o_custkey = k")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.expr("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END").alias("o_custkey"), "c_name")
    return table(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", "o_custkey", "c_name")


@query("j2_renamed_keys", "SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(spark, sf):
    out = join_renamed(table(spark, sf, "supplier"), table(spark, sf, "nation"), {"s_nationkey": "n_nationkey"})
    return shown(out.select("s_suppkey", "s_nationkey", "n_name"))


@query(
    "j3_natural_join",
    """SELECT a.user_id, a.event_type, a.n, round(b.total, 4) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) a
    JOIN (SELECT user_id, event_type, sum(value) AS total FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    n = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("total"))
    return shown(natural_join(n, total), 4)


@query("j4_inner_join", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(spark, sf):
    c, n, g = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("j5_right_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS k FROM orders) RIGHT JOIN customer ON k = c_custkey GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN o_custkey END").alias("c_custkey"))
    return o.join(table(spark, sf, "customer"), "c_custkey", "right").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("j6_semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def _(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf, "supplier").join(used, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("j7_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query(
    "j8_all_pairs_closest",
    f"WITH {d.SITES}, {d.STATIONS}, active AS (SELECT * FROM sites WHERE currently_testing), {d.nearest_sql('active', 'stations', 'near')} SELECT site_id, near_id AS dep_id, round(km, 6) AS dep_dist_km FROM near",
)
def _(spark, sf):
    active = d.sites(spark, sf).filter("currently_testing AND latitude IS NOT NULL")
    return shown(nearest(active, d.stations(spark, sf), "dep").select("site_id", "dep_id", "dep_dist_km"))


@query(
    "j9_nearest_station",
    f"""WITH {d.SITES}, {d.STATIONS}, prcp AS (SELECT * FROM stations WHERE element = 'PRCP'), {d.nearest_sql('sites', 'prcp', 'near')}
    SELECT site_id, near_id AS precip_ghcn_id, round(km, 6) AS precip_ghcn_dist_km FROM sites LEFT JOIN near USING (site_id)""",
)
def _(spark, sf):
    prcp = d.stations(spark, sf).filter("element = 'PRCP'")
    return shown(nearest(d.sites(spark, sf), prcp, "precip_ghcn").select("site_id", "precip_ghcn_id", "precip_ghcn_dist_km"))


@query(
    "j10_asof_backward",
    f"""WITH {CLICKS_BUYS} SELECT event_id, buy_id, round(buy_value, 6) AS buy_value, round((epoch_us(ts) - epoch_us(buy_ts)) / 3.6e9, 6) AS hours
    FROM clicks a ASOF LEFT JOIN buys b ON a.user_id = b.user_id AND a.ts > b.buy_ts""",
)
def _(spark, sf):
    out = asof_backward(_clicks(spark, sf), _buys(spark, sf), "user_id", "ts", "buy_ts")
    return shown(out.select("event_id", "buy_id", "buy_value", hours_between("ts", "buy_ts").alias("hours")))


@query(
    "j10_asof_at_or_before",
    """WITH t AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, event_type FROM events), r AS (SELECT user_id, day, max(event_id) AS last_id FROM t WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT event_id, last_id FROM (SELECT * FROM t WHERE event_type = 'click') a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.day >= r.day""",
)
def _(spark, sf):
    t = table(spark, sf, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    views = t.filter("event_type = 'view'").select("user_id", F.col("day").alias("view_day"), F.col("event_id").alias("last_id"))
    clicks = t.filter("event_type = 'click'")
    out = asof_backward(clicks, views, "user_id", "day", "view_day", strict=False, tie_break=[F.col("last_id")])
    return out.select("event_id", "last_id")


@query(
    "j11_asof_with_fallback",
    f"""WITH {CLICKS_BUYS}, flagged AS (SELECT *, buy_id % 7 <> 0 AS good FROM buys),
    own AS (SELECT a.event_id, a.user_id, a.ts, b.buy_id, b.buy_ts, b.good FROM clicks a ASOF LEFT JOIN flagged b ON a.user_id = b.user_id AND a.ts > b.buy_ts),
    late AS (SELECT event_id, ts FROM own WHERE buy_ts IS NULL OR epoch_us(ts) - epoch_us(buy_ts) > 8 * 3600000000),
    spare AS (SELECT * FROM flagged WHERE user_id = 0)
    SELECT event_id, buy_id, CAST(good AS VARCHAR) AS good, round((epoch_us(ts) - epoch_us(buy_ts)) / 3.6e9, 6) AS hours_since FROM own
      WHERE buy_ts IS NOT NULL AND epoch_us(ts) - epoch_us(buy_ts) <= 8 * 3600000000
    UNION ALL SELECT event_id, buy_id, CASE WHEN buy_id IS NOT NULL THEN 'false' END, round((epoch_us(ts) - epoch_us(buy_ts)) / 3.6e9, 6) FROM late a ASOF LEFT JOIN spare b ON a.ts > b.buy_ts""",
)
def _(spark, sf):
    events = _buys(spark, sf).withColumn("good", F.col("buy_id") % 7 != 0)
    out = asof_with_fallback(_clicks(spark, sf), events, "user_id", "ts", "buy_ts", 8.0, 0, "good")
    return shown(out.select("event_id", "buy_id", "good", "hours_since"))


@query(
    "j12_asof_forward",
    f"WITH {CLICKS_BUYS}, early AS (SELECT event_id, user_id, ts - INTERVAL 6 HOUR AS t FROM clicks) SELECT event_id, buy_id FROM early a ASOF LEFT JOIN buys b ON a.user_id = b.user_id AND a.t < b.buy_ts",
)
def _(spark, sf):
    return asof_forward(_clicks(spark, sf), _buys(spark, sf), "user_id", "ts", "buy_ts", offset_hours=-6).select("event_id", "buy_id")


@query(
    "j13_nearest_value",
    """WITH v AS (SELECT DISTINCT o_totalprice AS p FROM orders),
    w AS (SELECT c_custkey, c_acctbal * 50 AS x FROM customer),
    lo AS (SELECT c_custkey, x, p AS below FROM w ASOF LEFT JOIN v ON x >= p),
    hi AS (SELECT c_custkey, p AS above FROM w ASOF LEFT JOIN v ON x <= p)
    SELECT c_custkey, round(CASE WHEN above IS NULL OR x - below <= above - x THEN below ELSE above END, 6) AS closest FROM lo JOIN hi USING (c_custkey)""",
)
def _(spark, sf):
    prices = table(spark, sf, "orders").select(F.col("o_totalprice").alias("p"))
    wanted = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 50).alias("x"))
    return shown(nearest_value(wanted, prices, "x", "p", "closest").select("c_custkey", "closest"))


@query(
    "j14_next_value",
    """WITH v AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE CASE WHEN o_totalprice > 490000 THEN o_orderdate END IS NOT NULL), w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders)
    SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS next_date FROM w ASOF LEFT JOIN v ON x <= d""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("x"))
    big = o.select(F.expr("CASE WHEN o_totalprice > 490000 THEN x END").alias("d"))
    return shown(next_value(o, big, "x", "d", "next_date").select("o_orderkey", "next_date"))


@query(
    "j15_default_station",
    f"""WITH {d.WEATHER}, s AS (SELECT event_id, CAST(ts AS DATE) AS date, 'G' || (user_id % 60) AS g FROM events),
    spare AS (SELECT * FROM weather WHERE ghcn_station_id = 'G0')
    SELECT event_id, strftime(s.date, '%Y-%m-%d') AS date, CASE WHEN w.temperature_f IS NULL THEN 'G0' ELSE s.g END AS ghcn_station_id,
      round(coalesce(w.temperature_f, spare.temperature_f), 6) AS temperature_f, round(CASE WHEN w.temperature_f IS NULL THEN spare.precip_in ELSE w.precip_in END, 6) AS precip_in
    FROM s LEFT JOIN weather w ON w.date = s.date AND w.ghcn_station_id = s.g LEFT JOIN spare ON spare.date = s.date""",
)
def _(spark, sf):
    s = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"), F.concat(F.lit("G"), (F.col("user_id") % 60).cast("string")).alias("ghcn_station_id"))
    out = left_join_with_default(s, d.weather(spark, sf), ["date", "ghcn_station_id"], "ghcn_station_id", "G0", ["temperature_f", "precip_in"])
    return shown(out)


@query(
    "j16_cohort",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) > 4)",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    years = F.countDistinct(F.year("o_orderdate")).alias("n_years")
    return cohort(o, "o_custkey", F.col("n_years") > 4, years).select("o_orderkey", "o_custkey")


@query(
    "j17_disagreements",
    """SELECT o_orderkey, o_custkey, CAST(CASE WHEN c_custkey % 5 <> 0 THEN o_custkey % 25 = c_nationkey END AS VARCHAR) AS nation_agrees, CAST(o_orderstatus = c_mktsegment[1] AS VARCHAR) AS code_agrees
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 25).alias("guess"), "o_orderstatus")
    b = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("noted"), F.substring("c_mktsegment", 1, 1).alias("code")
    )
    out = compare_assignments(a, b, ["o_custkey"], {"nation_agrees": ("guess", "noted"), "code_agrees": ("o_orderstatus", "code")})
    return shown(out.select("o_orderkey", "o_custkey", "nation_agrees", "code_agrees"))


@query(
    "j18_fitted_next_to_inputs",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(a + b * l_quantity, 3) AS fitted FROM lineitem, m""",
)
def _(spark, sf):
    from envspark.models import ols

    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    _, _, model = ols(l, "l_extendedprice", ["l_quantity"])
    return shown(model.transform(l).select("l_orderkey", "l_linenumber", "l_partkey", "fitted"), 3)


@query(
    "j10_station_turning_points",
    f"""WITH {d.SAMPLES}, {d.TURNS} SELECT event_id, turn_id, round(tide_level, 6) AS tide_level FROM samples s ASOF LEFT JOIN turns t ON s.site_id = t.tide_noaa_id AND s.sample_time > t.datetime""",
)
def _(spark, sf):
    out = asof_backward(d.samples(spark, sf), d.turns(spark, sf), [("site_id", "tide_noaa_id")], "sample_time", "datetime", carry=["turn_id", "tide_level"])
    return shown(out.select("event_id", "turn_id", "tide_level"))


@query("f13_position", "SELECT event_id, epoch_us(ts) AS us FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", position(e, "ts").alias("us"))
