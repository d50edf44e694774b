"""Sitemaps read as files in ranges of bytes, against whole documents."""

import pytest
from pyspark.sql import functions as F

from webgauge.operators.sitemaps import listed_locations, site_urls, sitemap_urls
from webgauge.sources import fixtures
from webgauge.sources.crawl import SITEMAP_DOCS
from webgauge.sources.sitemap_files import listed_in_files, read_sitemap_files

SF_DIR = "/root/testdata/sf0.001"
PROLOG = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- made -->\n'
SET = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
DOCS = {
    "plain": PROLOG + SET + "<url><loc> http://a/1 </loc><lastmod>2024</lastmod></url>\n<url><loc>http://a/2</loc></url></urlset>\n",
    "index": "<sitemapindex><sitemap><loc>http://a/s1</loc></sitemap><sitemap><lastmod>x</lastmod><loc>http://a/s2</loc></sitemap></sitemapindex>",
    "several": "<urlset><url><loc>1</loc><loc>2</loc><x/><loc>3</loc></url><url><loc/><loc>4</loc></url><url><loc>5</loc ></url><url><loc>6</loc></url><url/></urlset>",
    "marked": "<urlset><url><loc><![CDATA[http://a/?a&b]]></loc></url><!-- <url> --><url><loc>a&amp;b</loc><image:loc>no</image:loc></url></urlset><!-- end -->",
    "empty": "<urlset></urlset>",
    "closed": "<urlset/>",
    "nothing": "",
    "other": "<rss><url><loc>1</loc></url></rss>",
    "cut": "<urlset><url><loc>1</loc></url><url><loc>2</loc></url>",
    "unclosed": "<urlset><url><loc>1</loc><url><loc>2</loc></url></urlset>",
    "crossed": "<urlset><url><loc>1</loc><a><b></a></b></url><url><loc>2</loc></url></urlset>",
    "loose": "<urlset><url><loc>1</loc></url><url><loc>2 & 3</loc></url></urlset>",
    "no_root": "<url><loc>1</loc></url></urlset>",
}


def write(folder, docs):
    for name, body in docs.items():
        (folder / f"{name}.xml").write_bytes(body.encode())
    return str(folder)


@pytest.fixture
def small_splits(spark):
    """Ranges of a few bytes, so that every document is cut into many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "64")
    yield
    for name in names:
        spark.conf.unset(name)


def by_name(rows):
    return sorted((r.name, r.root, r["loc"]) for r in rows.collect())


def test_files_list_what_whole_documents_list(spark, tmp_path, small_splits):
    rows = [("s", name, 200, "xml", body) for name, body in DOCS.items()]
    whole = listed_locations(spark.createDataFrame(rows, SITEMAP_DOCS)).select(F.col("sitemap_url").alias("name"), "root", F.explode("locs").alias("loc"))
    path = write(tmp_path, DOCS)
    assert spark.read.option("lineSep", "</loc>").text(path).rdd.getNumPartitions() > 8
    files = read_sitemap_files(spark, path).select(F.regexp_extract("file", r"([^/]+)\.xml$", 1).alias("name"), "root", F.explode("locs").alias("loc"))
    assert by_name(files) == by_name(whole)
    assert {name for name, _, _ in by_name(files)} == {"plain", "index", "several", "marked"}


def test_parts_that_do_not_fit_reject_the_file(spark, tmp_path, small_splits):
    odd = {
        "behind": "<urlset><url><loc>1</loc></url></urlset><url><loc>2</loc></url>",
        "twice": "<urlset><url><loc>1</loc></url></urlset><urlset><url><loc>2</loc></url></urlset>",
        "both": "<urlset><url><loc>1</loc></url><sitemap><loc>2</loc></sitemap></urlset>",
    }
    assert read_sitemap_files(spark, write(tmp_path, odd)).count() == 0


def test_operators_take_files(spark, tmp_path):
    docs = fixtures.sitemap_docs(spark, SF_DIR).where("http_status = 200").dropDuplicates(["site", "sitemap_url"])
    docs = docs.orderBy("site", "sitemap_url").limit(60)
    rows = docs.collect()
    path = write(tmp_path, {str(k): r.body or "" for k, r in enumerate(rows)})
    files = spark.createDataFrame([(f"file:{path}/{k}.xml", r.site, r.sitemap_url) for k, r in enumerate(rows)], "file string, site string, sitemap_url string")
    listed = listed_in_files(spark, path, files)
    none = docs.limit(0)
    assert sorted(sitemap_urls(docs).collect()) == sorted(sitemap_urls(none, listed).collect()) != []
    roots = docs.select("site", "sitemap_url")
    assert sorted(site_urls(roots, docs).collect()) == sorted(site_urls(roots, none, listed).collect())


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    n = 20_000
    entries = "".join(f"<url><loc>http://a/{k}</loc><lastmod>2024</lastmod></url>\n" for k in range(n))
    path = write(tmp_path, {"large": f"{PROLOG}{SET}{entries}</urlset>"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        listed = read_sitemap_files(spark, path)
        assert spark.read.option("lineSep", "</loc>").text(path).rdd.getNumPartitions() > 4
        locs = listed.select(F.explode("locs").alias("loc"))
        assert locs.count() == n and locs.distinct().count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
