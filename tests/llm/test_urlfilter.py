import random
import re

import pytest
from pyspark.sql import functions as F

from rootscope.llm.urlfilter import RULES, filter_pages, judge_urls, rule_table

PAGES = "page_id bigint, url string, html string"


def brute(pages, rules=RULES, default="allow"):
    out = []
    for page_id, url in pages:
        rest = (url or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [
            (len(h) + len(p), len(h), a == "block", h.lower() + p, a)
            for h, p, a in rules
            if h is not None and p is not None and a in ("allow", "block")
            and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
        ]
        best = max(fits) if fits else None
        out.append((page_id, host, path, best and best[3], best[4] if best else default))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


URLS = [
    None, "", "://", "no scheme/net/", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://xnet/", "http://.net/",
    "http://net./", "http://a.example.net/en/", "http://example.net/en", "http://example.net/EN/a", "http://EXAMPLE.com/de/1?q",
    "http://example.com/de?/de/", "http://a.b.org/fr/x/y", "http://org/fr/", "a://b://example.net/en/", "http://net:80/",
    "http://u@net/", "http://münchen.NET/ü/é", "http://net//", "http://net\n/x", "http://a.net\t.net/\n?x",
    "http://" + "a." * 3000 + "net" + "/b" * 3000, "x" * 50_000,
]


def test_odd_urls_and_repeated_rows(spark):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://net/"), (None, None), (5, URLS[5]), (5, URLS[5])]
    df = spark.createDataFrame([(*p, "h") for p in pages], PAGES).repartition(4)
    assert got(filter_pages(df)) == brute(pages)


def test_extra_columns_and_empty_tables(spark):
    clash = "page_id bigint, url string, host string, path string, rule string, verdict string, row bigint, prefix string, rank int"
    df = spark.createDataFrame([(1, "http://net/", "h", "p", "r", "v", 2, "x", 3)], clash)
    assert got(filter_pages(df)) == [(1, "net", "/", "net/", "block")]
    assert filter_pages(df.limit(0)).count() == 0
    none = rule_table(spark).where("false")
    assert got(judge_urls(df, none, "block")) == [(1, "net", "/", None, "block")]


RULESET = [
    ("net", "/", "block"), ("a.net", "/", "allow"), ("net", "/a/", "allow"), ("net", "", "allow"), ("Net", "/a/x", "block"),
    ("net", "/a/x", "allow"), ("b.a.net", "/a/x", "block"), ("c.com", "/a/b/c/", "block"), ("c.com", "/a/b", "allow"),
    ("", "/", "block"), ("com", "a/", "block"), ("com", "/?", "block"), (None, "/", "block"), ("com", None, "block"),
    ("com", "/", None), ("com", "/", "other"), ("net", "/", "allow"),
]


def _random_urls(n):
    pick = random.Random(3)
    return [
        (i, "http://" + ".".join(pick.choices(["a", "b", "c", "net", "com", ""], k=pick.randint(1, 4)))
         + "".join("/" + pick.choice(["a", "b", "x", "xy", ""]) for _ in range(pick.randint(0, 4))))
        for i in range(n)
    ]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_rules_of_all_shapes_against_brute_force(spark, broadcast):
    pages = _random_urls(1500)
    df = spark.createDataFrame([(*p, "h") for p in pages], PAGES)
    rules = spark.createDataFrame(RULESET, "host string, path string, action string").withColumn("rank", F.lit(9))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert got(judge_urls(df, rules)) == brute(pages, RULESET)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_plan_has_no_python(spark, capsys):
    df = spark.createDataFrame([(1, "u", "h")], PAGES)
    filter_pages(df).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out.replace("ExistingRDD", ""))
