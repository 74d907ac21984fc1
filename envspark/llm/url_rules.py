"""Operator 7, URL filters: rules indexed by their rarest literal token; only candidate rules run their patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.llm.common import lower_ascii, sheltered, table

#: (rule, verdict): a host, then a path that starts with "/".
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: Verdict of a url that no rule fits.
DEFAULT = "allow"

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """The literals between dots of the host, and between slashes of the path; a host's are marked by a leading dot."""
    hosts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    return F.array_distinct(F.concat(hosts, F.split(path, "/")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rows (rule, action, _pattern, _literals): every literal that a url must hold for the rule to fit.

    Of the rule's path only what a slash closes is a whole token of the url;
    the rest is a prefix of one and is left to the pattern.
    """
    rows = spark.createDataFrame([tuple(x) for x in rules], "rule string, action string")
    host, path = F.regexp_extract("rule", "^([^/]*)", 1), F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    quoted = F.regexp_replace("rule", r"([^A-Za-z0-9_/])", r"\\$1")
    literals = F.filter(_tokens(host, F.regexp_extract(path, "^(.*)/", 1)), lambda x: ~x.isin("", "."))
    return rows.select("rule", "action", F.concat(F.lit(r"^(?:[^/]*\.)?"), quoted).alias("_pattern"), literals.alias("_literals"))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """All rows and columns of ``pages`` with struct ``_url``: host, path, rule, verdict.

    Distinct (host, path) pairs are split into tokens once. Token frequencies
    over all of them choose each rule's rarest literal, under which the rule is
    filed; a url fetches the rules filed under its own tokens by a join, and
    only these run their patterns. Of those that fit, the longest wins (ties:
    the smaller text). A rule without literals is filed under every url.

    Null urls and urls without ``://`` have empty host and path, and take the
    default verdict unless a rule fits the empty url. Repeated rows are judged
    alike; other columns are carried and may have any name but ``_url``.
    """
    rows, held_at, back = sheltered(pages)
    parts = rows.withColumns({"_host": host_of(F.col(held_at[url_col])), "_path": path_of(F.col(held_at[url_col]))})
    urls = parts.select("_host", "_path").distinct()
    held = urls.withColumn("_token", F.explode(F.concat(_tokens(F.col("_host"), F.col("_path")), F.array(F.lit("\0")))))
    wanted = rules.select("rule", F.explode(F.when(F.size("_literals") > 0, F.col("_literals")).otherwise(F.array(F.lit("\0")))).alias("_token"))
    seen = held.join(wanted.select("_token").distinct(), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rarest = wanted.join(seen, "_token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_token")).alias("_at"))
    index = rules.join(rarest, "rule").select(F.col("_at._token").alias("_token"), "rule", "action", "_pattern")
    fits = held.join(index, "_token").filter(F.regexp_like(F.concat("_host", "_path"), F.col("_pattern")))
    best = fits.groupBy("_host", "_path").agg(F.min(F.struct((-F.length("rule")).alias("l"), "rule", "action")).alias("_best"))
    found = parts.join(best, ["_host", "_path"], "left")
    url = F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
    return found.select(*back, url.alias("_url"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict")


SQL = r"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, host, path, action) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT DISTINCT p.host, p.path, r.rule, r.action FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
b AS (SELECT host, path, first(rule ORDER BY length(rule) DESC, rule) AS rule, first(action ORDER BY length(rule) DESC, rule) AS action FROM m GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.action, 'allow') AS verdict FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
