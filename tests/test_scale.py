"""Skew-safe building blocks against brute force, plan shape, sinks and streaming."""

import pytest
from pyspark.sql import functions as F

from webgauge.operators.links import redirect_chains, with_broken_links
from webgauge.operators.score import grade_of, weighted
from webgauge.operators.skew import hot_keys, lookup_join, ranked, top_per_group
from webgauge.operators.sitemaps import expand
from webgauge.plans.audit import page_audit, site_audit
from webgauge.plans.report import sort_pages
from webgauge.sources import fixtures
from webgauge.sources.crawl import REDIRECT_HOPS, SITEMAP_DOCS
from webgauge.sources.sinks import write_report, write_results
from webgauge.streaming.pages import stream_page_audit

SF_DIR = "/root/testdata/sf0.001"


def test_lookup_join_keeps_all_rows_of_a_hot_key(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))
    right = spark.range(0, 500, 2).select(F.concat(F.lit("k"), "id").alias("key"), "id").withColumnRenamed("id", "value")
    right = right.unionByName(spark.createDataFrame([("hot", -1)], "key string, value long"))
    assert "hot" in hot_keys(left, "key") and len(hot_keys(left, "key")) <= 100
    for how in ("inner", "left"):
        expected = sorted(map(tuple, left.join(right, "key", how).select("id", "key", "value").collect()), key=repr)
        assert sorted(map(tuple, lookup_join(left, right, "key", how).collect()), key=repr) == expected


def test_ranked_equals_a_plain_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    rows = [tuple(r) for r in ranked(df, [F.desc("v")]).select("v", "rank").collect()]
    assert sorted(rows) == [(v, 1000 - v) for v in range(1000)]
    by_group = {}
    for r in ranked(df, [F.asc("v")], "g").collect():
        by_group.setdefault(r.g, []).append((r["rank"], r.v))
    for rows in by_group.values():
        rows.sort()
        assert [rank for rank, _ in rows] == list(range(1, len(rows) + 1))
        assert [v for _, v in rows] == sorted(v for _, v in rows)


@pytest.mark.parametrize("n", [2, 1001])
def test_top_per_group_both_ways(spark, n):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise("cold").alias("g"))
    got = {g: [r.id for r in top_per_group(df, "g", [F.asc("id")], n).where(F.col("g") == g).orderBy("rank").collect()] for g in ("hot", "cold")}
    assert got == {"hot": list(range(min(n, 2000))), "cold": list(range(2000, 2000 + min(n, 1000)))}


def test_redirect_chain_bound_and_loop(spark):
    hops = [(f"http://h/{i}", 301, f"/{i + 1}") for i in range(8)] + [("http://h/loop", 302, "/loop"), ("http://h/x", 301, None), ("http://h/y", 301, "http://gone/")]
    hops += [("http://h/0", 404, None), ("http://h/6", 500, None)]  # repeated answers: the lowest status counts
    df = spark.createDataFrame(hops, REDIRECT_HOPS)
    chains = {r.url: [e.url[9:] for e in r.chain] for r in redirect_chains(df.select("url"), df).collect()}
    assert chains["http://h/0"] == ["0", "1", "2", "3", "4"]
    assert chains["http://h/6"] == ["6", "7"]
    assert chains["http://h/loop"] == ["loop"] * 5
    assert chains["http://h/x"] == ["x"] and chains["http://h/y"] == ["y"]


def test_broken_links_count_with_multiplicity(spark):
    pages = spark.createDataFrame(
        [("s", "http://s/a", True, ["/x", "/x", "/ok", "#t"], ["i.png"]), ("s", "http://s/b", False, None, None), ("s", "http://s/c", True, [], [])],
        "site string, url string, usable boolean, hrefs array<string>, image_sources array<string>",
    )
    status = spark.createDataFrame([("http://s/x", 404, None), ("http://s/ok", 200, None), ("http://s/i.png", 0, "timeout")], "url string, status int, error string")
    rows = {r.url: r for r in with_broken_links(pages, status).collect()}
    assert [rows[f"http://s/{p}"].broken_links_count for p in "abc"] == [3, None, 0]
    assert [e.url for e in rows["http://s/a"].broken_links] == ["http://s/x"] * 2
    assert rows["http://s/a"].broken_images[0].error == "timeout"
    assert {r.broken_links_count for r in with_broken_links(pages, None).collect()} == {0}


def test_sitemap_cycle_ends(spark):
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    docs = spark.createDataFrame([("s", "a", 200, "xml", index("b", "gone")), ("s", "b", 200, "xml", index("a", "c")), ("s", "c", 200, "xml", index("b"))], SITEMAP_DOCS)
    roots = spark.createDataFrame([("s", "a")], "site string, sitemap_url string")
    assert {(r.sitemap_url, r.depth) for r in expand(roots, docs).collect()} == {("a", 0), ("b", 1), ("gone", 1), ("c", 2)}


def test_long_chain_of_sitemaps_keeps_its_plan(spark):
    def index(url):
        return f"<sitemapindex><sitemap><loc>{url}</loc></sitemap></sitemapindex>"

    lengths = []
    for n in (3, 12):
        docs = spark.createDataFrame([("s", f"m{i}", 200, "xml", index(f"m{i + 1}")) for i in range(n)], SITEMAP_DOCS)
        found = expand(spark.createDataFrame([("s", "m0")], "site string, sitemap_url string"), docs)
        assert sorted((r.depth, r.sitemap_url) for r in found.collect()) == [(i, f"m{i}") for i in range(n + 1)]
        lengths.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert lengths[0] == lengths[1]


def test_unreachable_grades(spark):
    df = spark.createDataFrame([(90,), (89,), (75,), (74,), (60,), (59,), (40,), (39,)], "s int")
    assert [r[0] for r in df.select(grade_of(F.col("s"))).collect()] == list("ABBCCDDF")
    names = {b: F.lit(v) for b, v in (("basic", 62), ("content", 67), ("technical", 82), ("performance", 93))}
    assert df.select(weighted(names)).first()[0] == 71


def test_title_sort_is_by_locale(spark):
    rows = [("s", f"u{i}", t, "warning", 1, []) for i, t in enumerate(["b", "B", "a", "Ä", "z", None])]
    pages = spark.createDataFrame(rows, "site string, url string, title string, status string, score int, issues array<string>")
    got = [r.title for r in sort_pages(pages, "title").orderBy("rank").collect()]
    assert got == [None, "a", "Ä", "b", "B", "z"]


def test_page_audit_is_row_local_and_has_no_python(spark):
    plan = page_audit(fixtures.crawl(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_audit_does_not_depend_on_partitions(spark):
    from webgauge.sources.crawl import LINK_STATUS

    crawl = fixtures.crawl(spark, SF_DIR)
    audit = site_audit(crawl, spark.createDataFrame([], LINK_STATUS))
    columns = ["url", "status", "score", "broken_links_count"]
    again = site_audit(crawl.repartition(3), spark.createDataFrame([], LINK_STATUS))
    assert sorted(map(tuple, audit.select(columns).collect()), key=repr) == sorted(map(tuple, again.select(columns).collect()), key=repr)


def test_sinks_round_trip(spark, tmp_path):
    audit = site_audit(fixtures.crawl(spark, SF_DIR))
    write_report(audit, f"{tmp_path}/report")
    write_results(audit, f"{tmp_path}/json")
    assert spark.read.parquet(f"{tmp_path}/report/details").count() == 50
    assert len(spark.read.parquet(f"{tmp_path}/report/details").columns) == 33
    assert spark.read.parquet(f"{tmp_path}/report/summary").count() == 33
    assert spark.read.json(f"{tmp_path}/json").count() == 50


def test_pages_as_a_stream_equal_the_batch(spark, tmp_path):
    crawl = fixtures.crawl(spark, SF_DIR)
    crawl.write.parquet(f"{tmp_path}/crawl")
    stream = stream_page_audit(spark, f"{tmp_path}/crawl").select("url", "score")
    run = stream.writeStream.format("memory").queryName("audited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = page_audit(crawl).select("url", "score")
    assert sorted(map(tuple, spark.table("audited").collect())) == sorted(map(tuple, batch.collect()))
