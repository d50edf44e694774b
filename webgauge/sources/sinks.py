"""Report and result writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgauge.operators.site import duplicates, long_issues, site_results, top_issues
from webgauge.plans.report import DETAIL_HEADERS, details, summary


def write_report(audit: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write the two report tables under ``path``; details carry the report's own column headers."""
    rows = details(audit).withColumnsRenamed(DETAIL_HEADERS)
    summary(audit).write.format(fmt).options(**options).save(f"{path}/summary")
    rows.write.format(fmt).options(**options).save(f"{path}/details")


def write_results(audit: DataFrame, path: str) -> None:
    """Write one nested JSON document per page."""
    audit.write.json(path)


def document_fragments(
    audit: DataFrame, sitemap_check: DataFrame | None = None, robots_check: DataFrame | None = None
) -> DataFrame:
    """``site, part, place, text``: lines that make up one JSON document per site when read in order.

    The document holds ``site``, ``sitemapCheck``, ``robotsCheck``, ``statistics``, ``duplicateTitles``,
    ``duplicateDescriptions``, ``topIssues`` and ``results``; checks that are not given are null. A list is an opening line, a line
    per element and a closing line. The last element of a list is the one without a comma; it is known from one row
    per site, so no list is ever gathered.
    """
    sites = audit.select("site").distinct()
    parts: list[DataFrame] = []

    def line(rows: DataFrame, place: Column, text: Column) -> None:
        parts.append(rows.select("site", F.lit(len(parts)).alias("part"), place.cast("string").alias("place"), text.alias("text")))

    def value(name: str, rows: DataFrame | None) -> None:
        held = sites.withColumn("value", F.lit("null")) if rows is None else rows.select("site", F.to_json(F.struct(*[c for c in rows.columns if c != "site"])).alias("value"))
        whole = sites.join(held, "site", "left") if rows is not None else held
        line(whole, F.lit(""), F.concat(F.lit(f'"{name}":'), F.coalesce("value", F.lit("null")), F.lit(",")))

    def listed(name: str, rows: DataFrame, key: Column, end: str) -> None:
        line(sites, F.lit(""), F.lit(f'"{name}":['))
        keyed = rows.select("site", key.alias("place"), F.to_json(F.struct(*[c for c in rows.columns if c != "site"])).alias("value"))
        last = keyed.groupBy("site").agg(F.max("place").alias("last"))
        comma = F.when(F.col("place") == F.col("last"), "").otherwise(",")
        line(keyed.join(last, "site"), F.col("place"), F.concat("value", comma))
        line(sites, F.lit(""), F.lit(end))

    line(sites, F.lit(""), F.concat(F.lit('{"site":'), F.regexp_extract(F.to_json(F.struct("site")), r'(?s)^\{"site":(.*)\}$', 1), F.lit(",")))
    value("sitemapCheck", sitemap_check)
    value("robotsCheck", robots_check)
    value("statistics", site_results(audit))
    listed("duplicateTitles", duplicates(audit, "title"), F.col("title"), "],")
    listed("duplicateDescriptions", duplicates(audit, "meta_description"), F.col("meta_description"), "],")
    listed("topIssues", top_issues(long_issues(audit)), F.lpad(F.col("rank").cast("string"), 12, "0"), "],")
    listed("results", audit, F.col("url"), "]}")
    return reduce(DataFrame.unionByName, parts)


def write_documents(audit: DataFrame, path: str, **checks: DataFrame) -> None:
    """Write one JSON document per site: the files of ``site=...`` in the order of their names, one after the other.

    The lines are range-sorted over the cluster, so a site of any size is written by as many tasks as it needs. ``audit``
    is read once per part and should be stored; a URL must occur once per site.
    """
    lines = document_fragments(audit, **checks)
    ordered = lines.repartitionByRange("site", "part", "place").sortWithinPartitions("site", "part", "place")
    ordered.select("site", "text").write.partitionBy("site").text(path)


def write_result_document(
    audit: DataFrame, path: str, sitemap_check: DataFrame | None = None, robots_check: DataFrame | None = None
) -> None:
    """Write the parts of the result document under ``path``, each as JSON lines that name their site.

    Parts: pages, duplicate_titles, duplicate_descriptions, statistics, top_issues and, where given, sitemap_check and
    robots_check. ``audit`` is read once per part and should be stored.
    """
    parts = {
        "pages": audit,
        "duplicate_titles": duplicates(audit, "title"),
        "duplicate_descriptions": duplicates(audit, "meta_description"),
        "statistics": site_results(audit),
        "top_issues": top_issues(long_issues(audit)),
        "sitemap_check": sitemap_check,
        "robots_check": robots_check,
    }
    for name, rows in parts.items():
        if rows is not None:
            rows.write.json(f"{path}/{name}")
