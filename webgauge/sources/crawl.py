"""Input tables and their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CRAWL = (
    "site string, url string, fetch_status int, location string, final_status int, html string, "
    "headers map<string,string>, perf_status int"
)
SITEMAP_DOCS = "site string, sitemap_url string, http_status int, content_type string, body string"
ROBOTS_DOCS = "site string, http_status int, content string"
LINK_STATUS = "url string, status int, error string"
REDIRECT_HOPS = "url string, status int, location string"


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """An input table with a fixed schema: nothing is inferred, missing columns are null."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_crawl(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, CRAWL, fmt)
