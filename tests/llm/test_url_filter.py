import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.llm.oracle import ORACLE
from webgauge.llm.queries import URL_RULES, op3_url_filter
from webgauge.llm.url_filter import bloom_filter, judge_urls, possible, rule_table

PAGES = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("rule", T.StringType()), ("key", T.StringType()), ("_row", T.StringType()))])
SF_DIR = "/root/testdata/sf0.01"


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def canonical(url):
    host, path = split(url)
    return re.sub(r"^(?:www|m)\.", "", host) + re.sub(r"(?:/index)?(?:\.html?)?/*$", "", path, count=1)


def brute(pages, rules, listed):
    blocked = {canonical(u) for u in listed if u} - {""}
    out = []
    for page, url in pages:
        host, path = split(url)
        fits = [(t, v) for v, t in rules for h, p in [(t[: t.index("/")], t[t.index("/") :])] if host and ("." + host).endswith("." + h) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if host and canonical(url) in blocked else "allow")
        out.append((page, host, path, rule, verdict))
    return Counter(out)


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://a.org", "http://xorg/", "http://Example.ORG/es/1", "https://www.example.org/es", "http://example.org/en/1", "http://m.example.org/en/19?x=/es/",
    "http://example.org/en/2#/en/1", "http://x.com/fr/", "http://x.com/de/?q", "http://x.com/FR/", "ftp://com/de/a://b", "http://bad.net/a.html", "http://www.bad.net/a/", "http://m.bad.net/a?utm=1", "http://bad.net/b", "http://é.net/ü",
    "http://www.bad.net/", "http://..org/x", "http://deep.er.and.deep.er.example.org/en/1/" + "x" * 100_000, "http://a.org?/es/", "http://bad.net/a/index.html", "HTTP://BAD.net/a",
]


def test_equals_brute_force_on_odd_urls(spark):
    pages = [(k, u) for k, u in enumerate(URLS)] + [(None, "http://bad.net/a"), (3, URLS[9]), (3, URLS[9])]
    listed = ["http://bad.net/a", "http://bad.net/a", None, "", "http://x.com/de/", "http://é.net/ü"]
    df = spark.createDataFrame([(*p, "clash", "clash", "clash") for p in pages], PAGES)
    out = judge_urls(df, rule_table(spark, URL_RULES), spark.createDataFrame([(u,) for u in listed], "url string"))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()) == brute(pages, URL_RULES, listed)


def test_without_rules_or_list(spark):
    df = spark.createDataFrame([(1, "http://a.org/x", "", "", "")], PAGES)
    none = spark.createDataFrame([], "url string")
    assert judge_urls(df, spark.createDataFrame([], "host string, path string, verdict string"), none).first().verdict == "allow"
    assert judge_urls(df, rule_table(spark, URL_RULES), none).first().rule == "org/"
    assert judge_urls(spark.createDataFrame([], PAGES), rule_table(spark, URL_RULES), none).count() == 0


def test_filter_misses_nothing_and_is_seldom_wrong(spark):
    inside, outside = spark.range(20_000).select(F.concat(F.lit("in "), "id").alias("key")), spark.range(50_000).select(F.concat(F.lit("out "), "id").alias("key"))
    blocks = 20_000 * 24 // 256
    filter_ = bloom_filter(inside, blocks)
    assert possible(inside, filter_, blocks).count() == 20_000
    assert possible(outside, filter_, blocks).count() < 50


def test_query_equals_brute_force_and_sql(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()]
    names = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
    listed = [u for _, u in pages if len(x := split(u)[0].split(".")) > 2 and x[-3] in names]
    rows = op3_url_filter(spark, SF_DIR).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows) == brute(pages, URL_RULES, listed)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    result = con.execute(ORACLE["op3_url_filter"])
    columns = [d[0] for d in result.description]
    assert sorted(result.fetchall(), key=repr) == sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
