"""PF1–PF23: projection, filters and NULL handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from envspark.catalog import domain as d
from envspark.catalog.base import query, shown, table
from envspark.functions import if_else, finite
from envspark.operators import (
    across,
    clean_names,
    cols_like,
    cols_of_type,
    distinct_values,
    drop_na,
    fill_with_agg,
    fix_sign,
    in_bbox,
    level_counts,
    mutate,
    place,
    rename_at,
    rename_like,
    reorder,
    sample_one,
    unswap,
    with_levels,
)


@query("pf1_reorder", "SELECT p_brand, p_partkey, p_name, p_type, p_size, p_retailprice FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    return shown(place(reorder(p, first=["p_brand"]), "p_size", after="p_type"))


@query("pf2_select_like", "SELECT strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_orderkey, l_partkey, l_suppkey FROM lineitem")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    out = l.select(*cols_like(l, contains="date"), *cols_like(l, prefix="l_", regex="key$"))
    assert "l_tax" in cols_like(l, regex="key|date", negate=True)
    return out.withColumn("l_shipdate", F.to_date("l_shipdate").cast("string"))


@query("pf3_select_by_type", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return shown(o.select(*cols_of_type(o, "numeric")))


@query("pf4_rename", "SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nationkey, round(s_acctbal, 6) AS acctbal FROM supplier")
def _(spark, sf):
    return shown(rename_at(rename_like(table(spark, sf, "supplier"), "^s_", ""), {0: "id"}))


@query(
    "pf5_clean_names",
    "SELECT c_custkey AS customer_key, c_name AS x2021_name, c_mktsegment AS market_segment, c_name AS x2021_name_2 FROM customer",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    return clean_names(c.select(F.col("c_custkey").alias("customerKey"), F.col("c_name").alias("2021 Name"), F.col("c_mktsegment").alias(" Market-Segment."), F.col("c_name").alias("2021_name")))


@query(
    "pf6_mutate",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem",
)
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    out = mutate(l, net=F.col("l_extendedprice") * (1 - F.col("l_discount")), gross=F.col("net") * (1 + F.col("l_tax")))
    return shown(out.select("l_orderkey", "l_linenumber", "l_partkey", "net", "gross"))


@query(
    "pf7_across",
    "SELECT l_orderkey, l_partkey, round(l_quantity * 100, 4) AS l_quantity, round(l_discount * 100, 4) AS l_discount, round(l_tax * 100, 4) AS l_tax FROM lineitem",
)
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return shown(across(l, ["l_quantity", "l_discount", "l_tax"], lambda c: c * 100), 4)


@query(
    "pf8_filter",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate >= DATE '1997-01-01') OR (o_orderstatus = 'F' AND o_custkey IS NOT NULL AND o_totalprice < 5000)",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    recent = F.col("o_totalprice").between(100000, 200000) & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    small = (F.col("o_orderstatus") == "F") & F.col("o_custkey").isNotNull() & (F.col("o_totalprice") < 5000)
    return o.filter(recent | small).select("o_orderkey", "o_orderstatus")


@query("pf9_in_bbox", f"WITH {d.SITES} SELECT site_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM sites WHERE latitude > 40.505 AND latitude < 40.995 AND longitude > -74.245 AND longitude < -73.505")
def _(spark, sf):
    return shown(in_bbox(d.sites(spark, sf), "latitude", "longitude", (40.505, -74.245, 40.995, -73.505)).select("site_id", "latitude", "longitude"))


@query(
    "pf10_membership",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _(spark, sf):
    builders = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return urgent.join(builders, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "pf11_if_else",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 50 THEN 'high' ELSE 'low' END AS side FROM events",
)
def _(spark, sf):
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, sf, "events").select("event_id", if_else(v > 50, "high", "low").alias("side"))


@query("pf12_replace_null", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type ELSE '' END AS kind FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind"))
    return e.fillna({"kind": ""})


@query("pf13_na_if", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))


@query(
    "pf14_fill_with_mean",
    """WITH g AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS s FROM events)
    SELECT event_id, round(coalesce(s, (SELECT avg(s) FROM g)), 4) AS seconds FROM g""",
)
def _(spark, sf):
    s = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    g = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, s).alias("seconds"))
    return shown(fill_with_agg(g, "seconds", F.avg("seconds")), 4)


@query("pf15_drop_na", "SELECT event_id, event_type FROM events WHERE event_id % 4 <> 0 AND event_id % 6 <> 1")
def _(spark, sf):
    e = F.col("event_id")
    holes = table(spark, sf, "events").select(
        "event_id", F.when(e % 4 != 0, F.col("event_type")).alias("event_type"), F.when(e % 6 != 1, F.col("value")).otherwise(F.lit(float("nan"))).alias("value")
    )
    return drop_na(drop_na(holes, ["value"])).select("event_id", "event_type")


@query("pf16_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type").distinct()


@query("pf17_sign_repair", f"WITH {d.SITES} SELECT site_id, round(longitude, 6) AS longitude FROM sites")
def _(spark, sf):
    s = d.sites(spark, sf).select("site_id", F.when(F.col("site_id").endswith("3"), -F.col("longitude")).otherwise(F.col("longitude")).alias("longitude"))
    return shown(fix_sign(s, "longitude"))


@query("pf18_unswap", f"WITH {d.SITES} SELECT site_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM sites")
def _(spark, sf):
    odd = F.col("site_id").endswith("3")
    s = d.sites(spark, sf).select(
        "site_id",
        F.when(odd, F.col("longitude")).otherwise(F.col("latitude")).alias("latitude"),
        F.when(odd, F.col("latitude")).otherwise(F.col("longitude")).alias("longitude"),
    )
    return shown(unswap(s, "latitude", "longitude", F.col("latitude") < F.col("longitude")))


@query(
    "pf19_levels",
    """SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_type END, 'missing') AS kind,
      CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END::BIGINT AS kind_pos FROM events""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return shown(with_levels(e, "kind", ["view", "click", "purchase"]))


@query(
    "pf19_level_counts",
    """SELECT l.kind, l.pos, count(e.event_id) AS n FROM (VALUES ('view', 1::BIGINT), ('click', 2), ('refund', 3), ('missing', 4)) l(kind, pos)
    LEFT JOIN (SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing' ELSE event_type END AS kind FROM events) e ON e.kind = l.kind GROUP BY 1, 2""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return shown(level_counts(e, "kind", ["view", "click", "refund"]))


@query("pf20_sample_one", "SELECT event_id, user_id FROM events ORDER BY md5(event_id || '|42'), event_id LIMIT 1")
def _(spark, sf):
    return sample_one(table(spark, sf, "events"), "event_id", 42).select("event_id", "user_id")


@query("pf22_distinct_values", "SELECT DISTINCT CAST(ts AS DATE)::VARCHAR AS date FROM events")
def _(spark, sf):
    return shown(distinct_values(d.samples(spark, sf), "date"))


@query("pf23_finite", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN round(value, 6) END AS value FROM events")
def _(spark, sf):
    m = F.col("event_id") % 3
    wild = F.when(m == 0, F.lit(float("-inf"))).when(m == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return shown(table(spark, sf, "events").select("event_id", finite(wild).alias("value")))
