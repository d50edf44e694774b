"""The registered queries: each takes (spark, data folder) and returns a flat table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.operators import content, facts, links, rules, score, site, sitemaps
from webgauge.plans import audit as plan
from webgauge.plans import report
from webgauge.session import deal_few_splits, materialize, shared_dir
from webgauge.sources import fixtures, link_store, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEYWORD = "the"
SEARCH = "Example.ORG"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- shared inputs -------------------------------------------------------------------------------


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal_few_splits(fixtures.crawl(spark, sf_dir))


def page_facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The stored facts that a query asks for; behind the store, filters and explodes are cheap."""
    names = ("site", "url", "usable", *columns)
    return materialize(facts.page_facts(crawl(spark, sf_dir), wanted=names).select(*names))


def metrics(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return materialize(plan.page_metrics(crawl(spark, sf_dir), wanted=columns).select("site", "url", "usable", *columns))


def row_local(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Facts that are only selected, neither filtered nor exploded: no store needed."""
    names = ("site", "url", *columns)
    return facts.page_facts(crawl(spark, sf_dir), wanted=names).select(*names)


def fetched(df: DataFrame) -> DataFrame:
    return df.where("usable")


def statuses(edges: DataFrame) -> DataFrame:
    """Check results for all link targets."""
    return fixtures.link_status(links.links_to_check(edges))


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(spark, sf_dir, "error", "hrefs", "image_sources")


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(links.link_edges(fetched(stored_links(spark, sf_dir))))


def full_audit(spark: SparkSession, sf_dir: str, score_broken_links: bool = False) -> DataFrame:
    """The stored audit: page table, link edges, their check results, then the cross-page part."""
    pages = plan.page_table(crawl(spark, sf_dir))
    edges = materialize(links.link_edges(fetched(pages)))
    status = materialize(statuses(edges))
    return materialize(plan.audit_pages(pages, status, edges, score_broken_links))


def joined(texts: Column, separator: str = "|") -> Column:
    return F.array_join(texts, separator)


# --- scans and page facts ------------------------------------------------------------------------


@query
def crawl_outcome(spark, sf_dir):
    pages = facts.crawl_outcome(fixtures.crawl(spark, sf_dir))
    return pages.select("site", "url", "fetch_status", "usable", "redirect_type", "error")


@query
def seed_urls(spark, sf_dir):
    seeds = fixtures.pages(spark, sf_dir).select("page_id", F.expr("CASE page_id % 3 WHEN 1 THEN url || '/' WHEN 2 THEN replace(url, 'http', 'ftp') ELSE url END").alias("url"))
    return sitemaps.seed_urls(seeds).select("page_id", "base_url", "accepted")


@query
def page_basics(spark, sf_dir):
    return row_local(spark, sf_dir, "title", "meta_description", "h1", "robots", "https")


@query
def social_tags(spark, sf_dir):
    names = ("og_title", "og_description", "og_image", "twitter_card", "twitter_title", "twitter_description")
    return row_local(spark, sf_dir, *names)


@query
def canonical_check(spark, sf_dir):
    pages = fetched(page_facts(spark, sf_dir, "canonical", "canonical_target", "canonical_self"))
    target, own = F.col("canonical_target"), F.col("canonical_self")
    state = (
        F.when(F.col("canonical").isNull(), "none")
        .when(target.isNull() | own.isNull(), "invalid")
        .when(target != own, "mismatch")
        .otherwise("match")
    )
    return pages.select("site", "url", "canonical", target.alias("canonical_target"), state.alias("state"))


@query
def hreflang(spark, sf_dir):
    pages = page_facts(spark, sf_dir, "hreflang").where(F.col("hreflang").isNotNull())
    rows = pages.select("site", "url", F.posexplode("hreflang").alias("pos", "entry"))
    return rows.select("site", "url", "pos", "entry.lang", F.col("entry.url").alias("href"))


@query
def structured_data(spark, sf_dir):
    pages = page_facts(spark, sf_dir, "structured_data").where(F.col("structured_data").isNotNull())
    rows = pages.select("site", "url", F.posexplode("structured_data").alias("pos", "entry"))
    return rows.select("site", "url", "pos", "entry.type", "entry.data", "entry.valid", joined(F.col("entry.errors")).alias("errors"))


@query
def image_alt(spark, sf_dir):
    return row_local(spark, sf_dir, "images_total", "images_without_alt")


@query
def link_counts(spark, sf_dir):
    return row_local(spark, sf_dir, "external_links_count", "internal_links_count")


@query
def strict_link_counts(spark, sf_dir):
    pages = facts.page_facts(crawl(spark, sf_dir), strict_links=True)
    return pages.select("site", "url", "external_links_count", "internal_links_count")


@query
def mobile_friendly(spark, sf_dir):
    return row_local(spark, sf_dir, "viewport", "mobile_friendly")


@query
def favicon(spark, sf_dir):
    return row_local(spark, sf_dir, "favicon")


@query
def page_size(spark, sf_dir):
    return row_local(spark, sf_dir, "page_size")


@query
def resolve_links(spark, sf_dir):
    return links.resolved_links(fetched(stored_links(spark, sf_dir)))


# --- content -------------------------------------------------------------------------------------


@query
def main_text(spark, sf_dir):
    return fetched(metrics(spark, sf_dir, "main_text")).select("site", "url", "main_text")


@query
def content_metrics(spark, sf_dir):
    return plan.page_metrics(crawl(spark, sf_dir)).select(
        "site", "url", "word_count", "character_count", "paragraph_count", "heading_count", "link_count",
        "image_count", "average_sentence_length", "average_word_length",
    )


@query
def readability(spark, sf_dir):
    pages = metrics(spark, sf_dir, "sentence_count", "syllable_count", "readability")
    return fetched(pages).drop("usable")


@query
def keywords(spark, sf_dir):
    rows = metrics(spark, sf_dir, "keyword_counts").select("site", "url", F.explode("keyword_counts").alias("k"))
    return rows.select("site", "url", "k.word", F.col("k.count").alias("count"))


@query
def top_keywords(spark, sf_dir):
    rows = metrics(spark, sf_dir, "top_keywords").select("site", "url", F.posexplode("top_keywords").alias("pos", "k"))
    return rows.select("site", "url", (F.col("pos") + 1).alias("rank"), "k.word", F.col("k.count").alias("count"), "k.density")


@query
def keyword_density(spark, sf_dir):
    return metrics(spark, sf_dir, "keyword_density").drop("usable")


@query
def target_density(spark, sf_dir):
    pages = plan.page_metrics(crawl(spark, sf_dir), target_keyword=KEYWORD)
    return pages.select("site", "url", F.col("keyword_density").alias("target_density"))


@query
def thin_content(spark, sf_dir):
    return content.thin_content(metrics(spark, sf_dir, "word_count")).select("site", "url", "word_count")


def document_metrics_of(spark, sf_dir, *columns):
    docs = spark.read.schema("doc_id bigint, text string").parquet(f"{sf_dir}/documents.parquet")
    return materialize(content.with_text_metrics(deal_few_splits(docs), "text").select("doc_id", *columns))


@query
def document_metrics(spark, sf_dir):
    return document_metrics_of(
        spark, sf_dir, "word_count", "character_count", "sentence_count", "syllable_count", "readability",
        "keyword_density", "average_sentence_length", "average_word_length",
    )


@query
def document_top_keywords(spark, sf_dir):
    rows = document_metrics_of(spark, sf_dir, "top_keywords").select("doc_id", F.posexplode("top_keywords").alias("pos", "k"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("rank"), "k.word", F.col("k.count").alias("count"), "k.density")


@query
def unicode_keywords(spark, sf_dir):
    """Top keywords with the letters of all scripts."""
    docs = spark.read.schema("doc_id bigint, text string").parquet(f"{sf_dir}/documents.parquet")
    measured = content.with_text_metrics(deal_few_splits(docs), "text", unicode_keywords=True)
    rows = materialize(measured.select("doc_id", "top_keywords")).select("doc_id", F.posexplode("top_keywords").alias("pos", "k"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("rank"), "k.word", F.col("k.count").alias("count"), "k.density")


# --- delivery ------------------------------------------------------------------------------------


@query
def compression(spark, sf_dir):
    return row_local(spark, sf_dir, "compression", "compression_type")


@query
def cache_headers(spark, sf_dir):
    return row_local(spark, sf_dir, "cache_headers", "cache_control")


@query
def minified(spark, sf_dir):
    return facts.page_facts(crawl(spark, sf_dir).drop("perf_status"), wanted=("site", "url", "minified"))


@query
def lazy_loading(spark, sf_dir):
    return facts.page_facts(crawl(spark, sf_dir).drop("perf_status"), wanted=("site", "url", "has_lazy_loading"))


@query
def perf_fallback(spark, sf_dir):
    columns = ("compression", "compression_type", "cache_headers", "cache_control", "minified", "has_lazy_loading")
    return row_local(spark, sf_dir, *columns)


# --- links ---------------------------------------------------------------------------------------


@query
def outlinks(spark, sf_dir):
    return links.outlinks(fetched(stored_links(spark, sf_dir))).select("site", "url", "pos", "target")


@query
def outimages(spark, sf_dir):
    return links.outimages(fetched(stored_links(spark, sf_dir))).select("site", "url", "pos", "target")


@query
def links_to_check(spark, sf_dir):
    edges = stored_edges(spark, sf_dir)
    return links.links_to_check(edges, statuses(edges))


@query
def broken_links(spark, sf_dir):
    edges = stored_edges(spark, sf_dir)
    broken = links.broken_links(edges, statuses(edges))
    return broken.select("site", "url", "kind", "pos", "target", "status", "error")


@query
def broken_links_from_store(spark, sf_dir):
    """Two runs of the link check: what the first one finds broken at half the targets, the second one answers anew."""
    edges = stored_edges(spark, sf_dir)
    checked = materialize(statuses(edges))
    again = F.crc32("url") % 2 == 0
    first = checked.withColumns({"status": F.when(again, 503).otherwise(F.col("status")), "error": F.when(again, "first run").otherwise(F.col("error"))})
    name, buckets = f"links_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    link_store.merge_statuses(spark, f"{name}_1", first, 1, buckets=buckets)
    store = link_store.merge_statuses(spark, f"{name}_2", checked.where(again), 2, f"{name}_1", buckets=buckets)
    broken = links.broken_links(edges, store, stored=True)
    return broken.select("site", "url", "kind", "pos", "target", "status", "error")


def entries(column: str) -> Column:
    return joined(F.transform(column, lambda e: F.concat_ws(" ", e["url"], e["status"], e["error"])))


@query
def broken_rollup(spark, sf_dir):
    pages = stored_links(spark, sf_dir)
    edges = materialize(links.link_edges(fetched(pages)))
    checked = links.with_broken_links(pages, statuses(edges), edges)
    return checked.select(
        "site",
        "url",
        "broken_links_count",
        entries("broken_links").alias("broken_links"),
        entries("broken_images").alias("broken_images"),
    )


@query
def skip_links(spark, sf_dir):
    audit = plan.site_audit(fixtures.crawl(spark, sf_dir), None)
    return audit.select("site", "url", "broken_links_count", "status", F.size("issues").alias("issue_count"))


@query
def redirect_chain(spark, sf_dir):
    hops = fixtures.redirect_hops(spark, sf_dir)
    chains = links.redirect_chains(hops.select("url"), hops)
    shown = joined(F.transform("chain", lambda e: F.concat_ws(" ", e["status"], e["url"])))
    return chains.select("url", F.size("chain").alias("answers"), shown.alias("chain"))


# --- sitemaps and robots -------------------------------------------------------------------------


def sitemap_inputs(spark, sf_dir):
    return fixtures.hosts(spark, sf_dir), materialize(fixtures.sitemap_docs(spark, sf_dir)), fixtures.robots_docs(spark, sf_dir)


def found_urls(spark, sf_dir):
    hosts, docs, robots = sitemap_inputs(spark, sf_dir)
    return sitemaps.site_urls(sitemaps.discover(hosts, docs, robots), docs)


@query
def robots_sitemaps(spark, sf_dir):
    return sitemaps.robots_sitemaps(fixtures.robots_docs(spark, sf_dir))


@query
def sitemap_discover(spark, sf_dir):
    return sitemaps.discover(*sitemap_inputs(spark, sf_dir))


@query
def sitemap_urls(spark, sf_dir):
    return sitemaps.sitemap_urls(fixtures.sitemap_docs(spark, sf_dir))


@query
def sitemap_expand(spark, sf_dir):
    hosts, docs, robots = sitemap_inputs(spark, sf_dir)
    return sitemaps.expand(sitemaps.discover(hosts, docs, robots), docs)


@query
def url_list(spark, sf_dir):
    return sitemaps.url_list(found_urls(spark, sf_dir), 3)


@query
def full_url_list(spark, sf_dir):
    return sitemaps.url_list(found_urls(spark, sf_dir))


@query
def site_volume(spark, sf_dir):
    return sitemaps.site_volume(found_urls(spark, sf_dir))


@query
def sitemap_check(spark, sf_dir):
    hosts, docs, _ = sitemap_inputs(spark, sf_dir)
    checked = sitemaps.sitemap_check(hosts, docs)
    return checked.select("site", "sitemap_url", "valid", joined(F.col("issues")).alias("issues"))


@query
def robots_check(spark, sf_dir):
    checked = sitemaps.robots_check(fixtures.hosts(spark, sf_dir), fixtures.robots_docs(spark, sf_dir))
    return checked.select("site", "exists", "content", joined(F.col("issues")).alias("issues"))


# --- rules and scores ----------------------------------------------------------------------------


@query
def page_issues(spark, sf_dir):
    """Every issue of every page, those about failed fetches, broken links and shared texts included."""
    return site.long_issues(full_audit(spark, sf_dir))


def scored(spark, sf_dir):
    return score.seo_score(plan.page_table(crawl(spark, sf_dir)))


def long_recommendations(pages):
    rows = pages.select("site", "url", F.posexplode_outer("recommendations").alias("pos", "r")).where(F.col("pos").isNotNull())
    return rows.select(
        "site", "url", "pos", "r.code", "r.priority", "r.category", "r.detail", "r.points", "r.issue", "r.recommendation", "r.impact"
    )


@query
def recommendations(spark, sf_dir):
    return long_recommendations(scored(spark, sf_dir))


@query
def recommendations_with_links(spark, sf_dir):
    """Recommendations when broken links count as well."""
    return long_recommendations(full_audit(spark, sf_dir, score_broken_links=True))


@query
def seo_score(spark, sf_dir):
    return scored(spark, sf_dir).select("site", "url", "score", "grade")


@query
def score_with_links(spark, sf_dir):
    """The score when broken links are deducted as well."""
    audit = full_audit(spark, sf_dir, score_broken_links=True)
    return audit.select("site", "url", "broken_links_count", "score", "grade", "score_technical")


@query
def score_breakdown(spark, sf_dir):
    buckets = [f"score_{b}" for b in rules.BUCKETS]
    return scored(spark, sf_dir).select("site", "url", *buckets)


# --- audit, statistics, reports ------------------------------------------------------------------


@query
def site_audit(spark, sf_dir):
    audit = full_audit(spark, sf_dir)
    return audit.select(
        "site", "url", "status", "error", "redirect_type", "title", "meta_description", "h1", "canonical", "robots", "viewport",
        "favicon", "https", "mobile_friendly", "page_size", "images_total", "images_without_alt",
        "external_links_count", "internal_links_count", "broken_links_count", "word_count", "character_count",
        "paragraph_count", "readability", "keyword_density", "average_sentence_length", "average_word_length",
        "compression", "compression_type", "cache_headers", "minified", "has_lazy_loading", "score", "grade",
        *[f"score_{b}" for b in rules.BUCKETS],
        F.size("recommendations").alias("recommendation_count"),
        joined(F.col("issues")["message"]).alias("issues"),
    )


@query
def page_status(spark, sf_dir):
    return full_audit(spark, sf_dir).select("site", "url", "status", F.size("issues").alias("issue_count"))


@query
def duplicate_titles(spark, sf_dir):
    return site.duplicates(page_facts(spark, sf_dir, "title"), "title")


@query
def duplicate_descriptions(spark, sf_dir):
    return site.duplicates(page_facts(spark, sf_dir, "meta_description"), "meta_description")


@query
def duplicate_pages(spark, sf_dir):
    pages = page_facts(spark, sf_dir, "title", "meta_description")
    titles = site.duplicate_pages(pages, "title", "pages").withColumn("kind", F.lit("title"))
    descriptions = site.duplicate_pages(pages, "meta_description", "pages").withColumn("kind", F.lit("description"))
    return titles.unionByName(descriptions)


@query
def status_counts(spark, sf_dir):
    return site.status_counts(full_audit(spark, sf_dir))


@query
def site_stats(spark, sf_dir):
    return site.site_stats(full_audit(spark, sf_dir))


@query
def top_issues(spark, sf_dir):
    return site.top_issues(site.long_issues(full_audit(spark, sf_dir)))


@query
def top_issue_codes(spark, sf_dir):
    return site.top_issues(site.long_issues(full_audit(spark, sf_dir)), by=("code",))


@query
def avg_lengths(spark, sf_dir):
    return site.average_lengths(page_facts(spark, sf_dir, "title", "meta_description"))


@query
def score_stats(spark, sf_dir):
    return site.score_stats(scored(spark, sf_dir))


@query
def site_results(spark, sf_dir):
    return site.site_results(full_audit(spark, sf_dir))


@query
def result_documents(spark, sf_dir):
    """What the written documents of each site hold, read back from their lines."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    sinks.write_documents(full_audit(spark, sf_dir), path)
    lines = spark.read.schema("text string, site string").text(path)
    line = F.regexp_replace("text", ",$", "")
    kinds = {"result": '{"url":', "title": '{"title":', "description": '{"meta_description":', "top": '{"rank":', "statistics": '"statistics":'}
    kind = F.coalesce(*[F.when(line.startswith(start), F.lit(name)) for name, start in kinds.items()])
    fields = "score int, status string, pages long, total_pages long, avg_score long"
    read = lines.select("site", kind.alias("kind"), F.from_json(F.regexp_replace(line, '^"statistics":', ""), fields).alias("v"))
    of = lambda name, value: F.when(F.col("kind") == name, value)
    return read.groupBy("site").agg(
        F.count(of("result", F.lit(1))).alias("results"),
        F.sum(of("result", F.col("v.score"))).alias("score_sum"),
        F.count(of("result", F.when(F.col("v.status") == "error", 1))).alias("error_results"),
        F.max(of("statistics", F.col("v.total_pages"))).alias("total_pages"),
        F.count(of("title", F.lit(1))).alias("shared_titles"),
        F.coalesce(F.sum(of("title", F.col("v.pages"))), F.lit(0)).alias("shared_title_pages"),
        F.count(of("description", F.lit(1))).alias("shared_descriptions"),
        F.count(of("top", F.lit(1))).alias("top_issues"),
        F.sum(of("top", F.col("v.pages"))).alias("top_issue_pages"),
    )


@query
def export_details(spark, sf_dir):
    return report.details(full_audit(spark, sf_dir))


@query
def export_summary(spark, sf_dir):
    return report.summary(full_audit(spark, sf_dir))


@query
def problem_pages(spark, sf_dir):
    return report.problem_pages(full_audit(spark, sf_dir), "warning").select("site", "url", "status", "title")


@query
def search_pages(spark, sf_dir):
    problems = report.problem_pages(full_audit(spark, sf_dir))
    return report.search_pages(problems, SEARCH).select("site", "url", "status", "title")


def view(spark, sf_dir):
    return report.problem_pages(full_audit(spark, sf_dir)).select("site", "url", "title", "status", "score", "issues")


def shown(df: DataFrame) -> DataFrame:
    return df.select("rank", "site", "url", "status", "score", F.size("issues").alias("issue_count"))


@query
def sort_pages(spark, sf_dir):
    return shown(report.sort_pages(view(spark, sf_dir), "status"))


@query
def sort_pages_reference_order(spark, sf_dir):
    return shown(report.sort_pages(view(spark, sf_dir), "status", reference_order=True))


@query
def sort_pages_by_issues(spark, sf_dir):
    return shown(report.sort_pages(view(spark, sf_dir), "issues"))


@query
def sort_pages_by_score(spark, sf_dir):
    return shown(report.sort_pages(view(spark, sf_dir), "score"))


@query
def sort_pages_by_title(spark, sf_dir):
    return shown(report.sort_pages(view(spark, sf_dir), "title"))


@query
def sort_pages_by_url(spark, sf_dir):
    return shown(report.sort_pages(view(spark, sf_dir), "url"))


@query
def result_counts(spark, sf_dir):
    return report.result_counts(full_audit(spark, sf_dir), "warning", SEARCH)


@query
def issue_preview(spark, sf_dir):
    preview = report.issue_preview(full_audit(spark, sf_dir))
    return preview.select("site", "url", joined(F.col("first_issues")).alias("first_issues"), "more_issues")


@query
def link_preview(spark, sf_dir):
    preview = report.link_preview(full_audit(spark, sf_dir))
    return preview.select("site", "url", entries("broken_links").alias("broken_links"), entries("broken_images").alias("broken_images"))
