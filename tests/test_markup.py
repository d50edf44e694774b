"""Character references, JSON-LD, host names, link results and written results against given values."""

import json

import pytest
from pyspark.sql import functions as F

from webgauge.functions.urls import join_url, normalize, standard_host
from webgauge.operators.links import with_broken_links
from webgauge.operators.sitemaps import listed_locations, site_urls
from webgauge.plans.audit import page_audit, page_metrics, site_audit
from webgauge.sources import fixtures
from webgauge.sources.crawl import CRAWL, LINK_STATUS, SITEMAP_DOCS
from webgauge.session import materialize
from webgauge.sources.sinks import write_documents, write_result_document

SF_DIR = "/root/testdata/sf0.001"
TEXTS = {
    "A &copy2024": "A ©2024",
    "a&nbsptext": "a text",
    "x &notit; y": "x ¬it; y",
    "x &notin; y": "x ∉ y",
    "A &amp B": "A & B",
    "&unknown; &x": "&unknown; &x",
    "&copy=1": "©=1",
    "&#128;&#x80;&#x41;&#0;": "€€A�",
    "&AMP;&Aacute;&aacute": "&Áá",
}
ATTRIBUTES = {"?a=1&copy=2": "?a=1&copy=2", "A &amp B": "A & B", "end &copy": "end ©", "&copyx": "&copyx", "&copy;x": "©x", "&notit;": "&notit;"}
BLOCKS = {
    '{"@type":"A","a":1,"a":2}': (True, None),
    '{"@type":"","@type":"A"}': (True, None),
    '{"@type":"A","@type":""}': (False, ["Chybí @type nebo @context"]),
    '{"@type":"A","b":{"c":1,"c":2}}': (True, None),
    '[{"@type":"A","x":1,"x":2},{"a":1,"a":2}]': (False, ["Položka 2: chybí @type nebo @context"]),
    '{"a":1,"a":2} {"b":1}': (False, ["Neplatný JSON"]),
    '{"a":1,"a":2': (False, ["Neplatný JSON"]),
    '{"@type":"A",}': (False, ["Neplatný JSON"]),
}


def crawl_of(spark, pages):
    rows = [("s", f"https://s.cz/{i}", 200, None, None, html, None, None) for i, html in enumerate(pages)]
    return spark.createDataFrame(rows, CRAWL)


def test_character_references(spark):
    pages = [f"<title>{t}</title><body><p>{t}</p>" for t in TEXTS] + [f'<meta name="description" content="{t}">' for t in ATTRIBUTES]
    rows = page_metrics(crawl_of(spark, pages)).select("url", "title", "meta_description", "main_text").collect()
    rows = sorted(rows, key=lambda r: int(r.url.rsplit("/", 1)[1]))
    assert [r.title for r in rows[: len(TEXTS)]] == list(TEXTS.values())
    assert [r.main_text for r in rows[: len(TEXTS)]] == list(TEXTS.values())
    assert [r.meta_description for r in rows[len(TEXTS) :]] == list(ATTRIBUTES.values())


def test_of_a_repeated_json_key_the_last_value_counts(spark):
    pages = [f'<script type="application/ld+json">{b}</script>' for b in BLOCKS]
    rows = page_audit(crawl_of(spark, pages)).select("url", "structured_data").collect()
    rows = sorted(rows, key=lambda r: int(r.url.rsplit("/", 1)[1]))
    assert [(r.structured_data[0].valid, r.structured_data[0].errors) for r in rows] == list(BLOCKS.values())


def test_international_hosts(spark):
    urls = [("http://Příklad.CZ/a", "http://xn--pklad-zsa96e.cz/a"), ("https://münchen.de:443", "https://xn--mnchen-3ya.de/"), ("http://ok.com/é", "http://ok.com/%C3%A9")]
    df = spark.createDataFrame(urls, "u string, e string")
    assert [r.n for r in df.select(normalize(standard_host(F.col("u"))).alias("n")).collect()] == [e for _, e in urls]
    joined = df.select(join_url(standard_host(F.lit("//Bücher.de/x")), F.col("u")).alias("n")).first()
    assert joined.n == "http://xn--bcher-kva.de/x"


def test_repeated_link_results_count_once(spark):
    pages = spark.createDataFrame([("s", "http://s/a", True, ["/x", "/y"], [])], "site string, url string, usable boolean, hrefs array<string>, image_sources array<string>")
    status = spark.createDataFrame([("http://s/x", 404, None), ("http://s/x", 500, "e"), ("http://s/y", 404, None), ("http://s/y", 200, None)], LINK_STATUS)
    row = with_broken_links(pages, status).first()
    assert row.broken_links_count == 1 and [e.status for e in row.broken_links] == [404]


def test_sitemaps_are_parsed_once(spark):
    docs = spark.createDataFrame(
        [("s", "r", 200, "xml", "<sitemapindex><sitemap><loc>u</loc></sitemap></sitemapindex>"), ("s", "u", 200, "xml", "<urlset><url><loc> p </loc></url><url><loc>p</loc></url><url><loc/></url></urlset>"), ("s", "other", 200, "xml", "<urlset><url><loc>q</loc></url></urlset>"), ("s", "bad", 200, "xml", "<urlset><url>")],
        SITEMAP_DOCS,
    )
    plan = listed_locations(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml(") + plan.count("invoke(XmlToStructs") == 1
    roots = spark.createDataFrame([("s", "r")], "site string, sitemap_url string")
    assert [r.url for r in site_urls(roots, docs).collect()] == ["p"]


def test_the_page_table_is_fed_without_a_shuffle(spark):
    plan = page_metrics(fixtures.crawl(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "html" in plan and "Exchange" not in plan


def test_no_setting_of_the_session_is_changed(spark):
    before = dict(spark.conf.getAll)
    page_audit(crawl_of(spark, ["<p>"])).collect()
    assert dict(spark.conf.getAll) == before


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('document')}/result"
    checks = spark.createDataFrame([("s", True, ["x"])], "site string, valid boolean, issues array<string>")
    audit = site_audit(crawl_of(spark, ["<title>Same</title>"] * 2 + ["<title>Other</title>"]))
    write_result_document(audit, path, sitemap_check=checks)
    return path


def test_the_written_document_holds_every_part(spark, document):
    read = lambda part: spark.read.json(f"{document}/{part}")
    assert read("pages").count() == 3
    assert [(r.title, r.pages) for r in read("duplicate_titles").collect()] == [("Same", 2)]
    stats = read("statistics").first()
    assert (stats.total_pages, stats.scored_pages, stats.avg_title_length) == (3, 3, 4)
    assert read("sitemap_check").first().issues == ["x"]
    top = {r.code: r.pages for r in read("top_issues").collect()}
    assert top["NO_H1"] == 3 and top["DUPLICATE_TITLE"] == 2


def test_documents_are_valid_json(spark, tmp_path):
    checks = spark.createDataFrame([("s", True, ["x"])], "site string, valid boolean, issues array<string>")
    pages = ["<title>Same \"q\"</title>"] * 2 + ["<title>Other</title>"] * 2 + ["<title>One</title>"]
    rows = [("s" if i else "t.cz", f"https://s.cz/{i}", 200, None, None, html, None, None) for i, html in enumerate(pages)]
    audit = materialize(site_audit(spark.createDataFrame(rows, CRAWL)))
    write_documents(audit, f"{tmp_path}/doc", sitemap_check=checks)
    read = lambda site: json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc" / f"site={site}").glob("part-*"))))
    s, t = read("s"), read("t.cz")
    assert s["site"] == "s" and t["site"] == "t.cz" and t["results"][0]["url"] == "https://s.cz/0"
    assert [r["url"] for r in s["results"]] == [f"https://s.cz/{i}" for i in range(1, 5)]
    assert s["sitemapCheck"] == {"valid": True, "issues": ["x"]} and t["sitemapCheck"] is None and s["robotsCheck"] is None
    assert s["duplicateTitles"] == [{"title": "Other", "pages": 2}] and t["duplicateTitles"] == []
    assert s["statistics"]["total_pages"] == 4 and s["topIssues"][0]["pages"] == 4
