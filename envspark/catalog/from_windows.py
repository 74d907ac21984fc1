"""W1–W10, SE1–SE4, RS1–RS6, IN1–IN2: series, unions, shapes and top-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, scratch, shown, table
from envspark.functions.times import position
from envspark.operators import (
    append_distinct,
    densify,
    expand_days_back,
    group_extreme,
    impute_group_mean,
    lag_sum,
    nest,
    phase_features,
    pivot,
    roll_sum,
    section_fill,
    separate,
    share_within,
    tagged_union,
    top_n_by,
    union_distinct,
    unnest,
    unpivot_year,
)
from envspark.streaming import commit_top_up, missing_keys, top_up

DAILY = "daily AS (SELECT user_id, CAST(ts AS DATE) AS date, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)"


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.round(F.sum("value"), 4).alias("total"))


@query(
    "w1_phase_features",
    f"WITH {d.TURNS}, {d.PHASES} SELECT turn_id, round(tide_range_ft, 6) AS tide_range_ft, round(tide_duration_hrs, 6) AS tide_duration_hrs FROM phases",
)
def _(spark, sf):
    out = phase_features(d.turns(spark, sf), "tide_noaa_id", "datetime", "tide_level")
    return shown(out.select("turn_id", "tide_range_ft", "tide_duration_hrs"))


@query("w2_lag_sum", f"WITH {DAILY} SELECT user_id, strftime(date, '%Y-%m-%d') AS date, round(lag(total, 1) OVER w + lag(total, 2) OVER w, 4) AS before_48 FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY date)")
def _(spark, sf):
    return shown(lag_sum(_daily(spark, sf), ["user_id"], "date", "total", [1, 2], "before_48").drop("total"), 4)


@query(
    "w3_rolling_sum",
    f"""WITH {DAILY}, h AS (SELECT user_id, date, CASE WHEN day(date) <> 10 THEN total END AS total FROM daily)
    SELECT user_id, strftime(date, '%Y-%m-%d') AS date, CASE WHEN count(total) OVER w = 7 THEN round(sum(total) OVER w, 4) END AS week FROM h
    WINDOW w AS (PARTITION BY user_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    h = _daily(spark, sf).withColumn("total", F.when(F.dayofmonth("date") != 10, F.col("total")))
    return shown(roll_sum(h, ["user_id"], "date", "total", 7, "week").drop("total"), 4)


@query(
    "w4_impute_group_mean",
    """WITH h AS (SELECT event_id, CAST(ts AS DATE) AS date, CASE WHEN event_id % 4 <> 0 THEN value END AS v, CASE WHEN event_id % 3 <> 0 THEN user_id END AS u FROM events)
    SELECT event_id, round(coalesce(v, avg(v) OVER (PARTITION BY date)), 6) AS v, round(coalesce(u, avg(u) OVER (PARTITION BY date)), 6) AS u FROM h""",
)
def _(spark, sf):
    k = F.col("event_id")
    h = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"), F.when(k % 4 != 0, F.col("value")).alias("v"), F.when(k % 3 != 0, F.col("user_id")).cast("double").alias("u"))
    return shown(impute_group_mean(h, ["date"], ["v", "u"]).drop("date"))


@query("w5_share_within", "SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS prop FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def _(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return shown(share_within(n, ["user_id"], "n", "prop"))


@query(
    "w7_top_per_group",
    """SELECT user_id, event_id, 'one' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1
    UNION ALL SELECT user_id, event_id, 'ties' FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS k FROM events) WHERE k = 1""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    one = top_n_by(e, ["user_id"], [F.desc("value"), F.col("event_id")])
    ties = top_n_by(e.withColumn("date", F.to_date("ts")), ["user_id"], [F.desc("date")], ties=True)
    return tagged_union({"one": one.select("user_id", "event_id"), "ties": ties.select("user_id", "event_id")}, "kind")


@query(
    "w8_section_fill",
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '1-URGENT' THEN 'section ' || o_orderkey END AS h FROM orders)
    SELECT o_custkey, o_orderkey, area FROM (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS area FROM s) WHERE h IS NULL""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    name = F.concat(F.lit("section "), F.col("o_orderkey").cast("string"))
    return section_fill(o, "o_orderkey", F.col("o_orderpriority") == "1-URGENT", name, "area", by=["o_custkey"]).drop("o_orderpriority")


@query(
    "w8_section_fill_one_list",
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN s_name END AS h FROM supplier)
    SELECT s_suppkey, area FROM (SELECT *, last_value(h IGNORE NULLS) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS area FROM s) WHERE h IS NULL""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return section_fill(s, "s_suppkey", F.col("s_nationkey") % 4 == 0, F.col("s_name"), "area").select("s_suppkey", "area")


@query(
    "w9_group_maximum",
    "SELECT event_id, round(max(greatest(CASE WHEN event_id % 3 <> 0 THEN value END, CASE WHEN event_id % 2 <> 0 THEN value / 2 END)) OVER (PARTITION BY user_id, CAST(ts AS DATE)), 6) AS top FROM events",
)
def _(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    e = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    both = F.greatest(F.when(k % 3 != 0, v), F.when(k % 2 != 0, v / 2))
    return shown(group_extreme(e, ["user_id", "date"], "top", both).select("event_id", "top"))


@query(
    "w10_cumulative_counts",
    """WITH s AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, round(value, 6) AS value, sum(n) OVER (PARTITION BY event_type ORDER BY value DESC)::BIGINT AS at_least FROM s""",
)
def _(spark, sf):
    from envspark.operators.slices import POS, running_sum

    s = table(spark, sf, "events").groupBy("event_type", F.col("value").alias(POS)).agg(F.count(F.lit(1)).alias("n"))
    return shown(running_sum(s, ["event_type"], {"at_least": "n"}, descending=True).select("event_type", F.col(POS).alias("value"), "at_least"))


@query(
    "se1_union_by_name",
    "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return s.unionByName(c, allowMissingColumns=True)


@query(
    "se2_append_distinct",
    "SELECT event_id, event_type, CASE WHEN event_id % 3 <> 2 THEN 'new' ELSE 'old' END AS version FROM events",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    old = e.filter("event_id % 3 <> 1").withColumn("version", F.lit("old"))
    new = e.filter("event_id % 3 <> 2").withColumn("version", F.lit("new"))
    return append_distinct(old, new.unionByName(new), ["event_id"])


@query("se2_union_distinct", "SELECT user_id, event_type FROM events WHERE value > 20 UNION SELECT user_id, event_type FROM events WHERE value < 50")
def _(spark, sf):
    e = table(spark, sf, "events")
    return union_distinct(e.filter("value > 20").select("user_id", "event_type"), e.filter("value < 50").select("event_type", "user_id"))


@query(
    "se3_days_back",
    """SELECT DISTINCT user_id, strftime(CAST(ts AS DATE) - k, '%Y-%m-%d') AS date FROM events, (VALUES (0), (1), (2)) v(k) WHERE event_type = 'error'""",
)
def _(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").select("user_id", F.to_date("ts").alias("date"))
    return shown(expand_days_back(e, "date", 2))


@query("se4_tagged_union", "SELECT c_name AS site, 'ours' AS source FROM customer UNION ALL SELECT s_name, 'theirs' FROM supplier")
def _(spark, sf):
    ours = table(spark, sf, "customer").select(F.col("c_name").alias("site"))
    return tagged_union({"ours": ours, "theirs": table(spark, sf, "supplier").select(F.col("s_name").alias("site"))})


@query(
    "rs1_wide_to_long",
    "SELECT s_suppkey, 'acctbal' AS measure, round(s_acctbal, 6) AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return shown(s.unpivot(["s_suppkey"], ["acctbal", "nation"], "measure", "value"))


@query(
    "rs2_long_to_wide",
    """SELECT user_id, strftime(date, '%Y-%m-%d') AS date, round(max(value) FILTER (event_type = 'click'), 6) AS click, round(max(value) FILTER (event_type = 'view'), 6) AS view, NULL::DOUBLE AS refund
    FROM (SELECT user_id, CAST(ts AS DATE) AS date, event_type, value FROM events) GROUP BY 1, date""",
)
def _(spark, sf):
    long = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("date"), "event_type").agg(F.max("value").alias("value"))
    return shown(pivot(long, ["user_id", "date"], "event_type", "value", ["click", "view", "refund"]))


@query(
    "rs3_year_columns",
    """SELECT c_custkey, 2020::BIGINT AS year, c_mktsegment AS lab FROM customer UNION ALL SELECT c_custkey, 2021, c_name FROM customer WHERE c_custkey % 3 <> 0""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("x2020_lab_analysis_by"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("x2021_lab_analysis_by"), F.lit("n").alias("notes")
    )
    return shown(unpivot_year(c, ["c_custkey"], r"\d{4}_lab", "lab"))


@query("rs4_nest_unnest", "SELECT user_id, event_id, round(value, 6) AS value FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return shown(unnest(nest(e, ["user_id"])))


@query("rs4_nested_lists", "SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark, sf):
    nested = nest(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"])
    per_list = nested.select("user_id", F.size("data").alias("n"), F.aggregate("data", F.lit(0).cast("long"), lambda s, x: s + x["event_id"]).alias("ids"))
    return per_list.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


@query("rs5_separate", "SELECT c_custkey, split_part(c_name, '#', 1) AS what, split_part(c_name, '#', 2) AS number FROM customer")
def _(spark, sf):
    return separate(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", ["what", "number"], "#")


@query(
    "rs6_densify",
    f"""WITH {DAILY}, w AS (SELECT user_id, user_id % 7 AS grp, CASE WHEN day(date) % 9 <> 0 THEN date END AS date, total FROM daily),
    g AS (SELECT * FROM (SELECT DISTINCT user_id, grp FROM w), (SELECT DISTINCT date FROM w WHERE date IS NOT NULL))
    SELECT g.user_id, g.grp, strftime(g.date, '%Y-%m-%d') AS date, total FROM g LEFT JOIN w ON g.user_id = w.user_id AND g.date = w.date""",
)
def _(spark, sf):
    w = _daily(spark, sf).withColumn("date", F.when(F.dayofmonth("date") % 9 != 0, F.col("date"))).withColumn("grp", F.col("user_id") % 7)
    return shown(densify(w.select("user_id", "grp", "date", "total"), ["user_id", "grp"], "date"), 4)


@query(
    "rs6_densify_calendar",
    f"""WITH {DAILY}, w AS (SELECT user_id, CASE WHEN day(date) % 9 <> 0 THEN date END AS date, total FROM daily),
    g AS (SELECT u.user_id, CAST(t AS DATE) AS date FROM (SELECT DISTINCT user_id FROM w) u, (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS t FROM w))
    SELECT g.user_id, strftime(g.date, '%Y-%m-%d') AS date, total FROM g LEFT JOIN w ON g.user_id = w.user_id AND g.date = w.date""",
)
def _(spark, sf):
    w = _daily(spark, sf).withColumn("date", F.when(F.dayofmonth("date") % 9 != 0, F.col("date")))
    return shown(densify(w, ["user_id"], "date", calendar=True), 4)


@query("in1_high_water_top_up", "SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts < TIMESTAMP '2024-01-11' OR ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-11')")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    store = e.filter(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    once = top_up(store, e, "ts", ["event_id"])
    out = top_up(once, e, "ts", ["event_id"])
    return out.select("event_id", position(out, "ts").alias("us"))


@query("in1_committed_top_up", "SELECT event_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, epoch_us(ts) AS us FROM events")
def _(spark, sf):
    """A store filled in three runs, the second of which finds nothing new."""
    e = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("date"))
    path = scratch(spark, "topped-up")
    early = e.filter(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    for rows in (early, early, e):
        commit_top_up(rows, path, "ts", ["event_id"], "date")
    store = spark.read.schema(e.schema).parquet(path)
    return shown(store.select("event_id", "date", position(store, "ts").alias("us")))


@query(
    "in2_missing_keys",
    "SELECT DISTINCT user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'view' AND b.user_id = a.user_id AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE))",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"), "event_type")
    return shown(missing_keys(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id", "date"]))


@query("in2_nothing_missing_after_top_up", "SELECT 0::BIGINT AS missing, count(*) AS held FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events)")
def _(spark, sf):
    from envspark.sources import read_table, write_table

    keys = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"), "event_type")
    path = scratch(spark, "store")
    held = keys.filter("event_type = 'view'").select("user_id", "date").distinct()
    write_table(held.unionByName(missing_keys(keys, held, ["user_id", "date"])), path)
    store = read_table(spark, path)
    missing = missing_keys(keys, store, ["user_id", "date"]).agg(F.count(F.lit(1))).scalar()
    return store.agg(F.count(F.lit(1)).alias("held")).select(missing.alias("missing"), "held")
