"""Audit pages as they arrive: the row-local part of the audit needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgauge.plans.audit import page_audit
from webgauge.sources.crawl import CRAWL


def stream_page_audit(spark: SparkSession, path: str) -> DataFrame:
    """Streaming page audit of the crawl files that appear under ``path``."""
    return page_audit(spark.readStream.schema(CRAWL).parquet(path))
