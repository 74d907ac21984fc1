import re

from envspark.llm.url_rules import RULES, judge_urls, rule_table


def judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for r, v in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_matches_rules_tried_one_by_one(spark, clashing):
    hosts = ["example.org", "a.example.org", "xexample.org", "org", "x.com", "COM", "net", "example.org:80", "", "org.x.net", "fr\n.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/", "/de/a\nb", "//fr/", "/fr/../de/", "/a.org/b", "/x.com/fr/"]
    urls = [f"http://{h}{p}{end}" for h in hosts for p in paths for end in ("", "?org/", "#/de/")] + [None, "", "x", "a://b://c.com/fr/"]
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string"))
    got = judge_urls(pages, rule_table(spark)).select("page_id", "url", "_url.*").collect()
    assert len(got) == 2 * len(urls)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judge(r.url) for r in got]


def test_rules_without_literals_and_of_one_length(spark):
    rules = rule_table(spark, [("b.c/x", "block"), ("a.c/x", "allow"), ("a.c/", "block")])
    pages = spark.createDataFrame([(1, "z://a.c/xy"), (2, "z://b.a.c/"), (3, "z://b.c/q")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(pages, rules).select("page_id", "_url.*").collect()}
    assert got == {1: ("a.c/x", "allow"), 2: ("a.c/", "block"), 3: (None, "allow")}
