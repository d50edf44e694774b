"""Registered queries against their SQL; WEBGAUGE_ALL=1 runs every one of them."""

import os

import pytest
from compare import connect, differences

from webgauge.oracle.sql import oracle_sql
from webgauge.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
QUICK = (
    "seed_urls", "page_basics", "social_tags", "canonical_check", "structured_data", "link_counts", "resolve_links",
    "content_metrics", "top_keywords", "document_top_keywords", "perf_fallback", "broken_links", "redirect_chain",
    "sitemap_expand", "sitemap_check", "robots_check", "recommendations", "top_issues", "export_summary", "site_audit",
)
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("WEBGAUGE_ALL") else QUICK)
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_every_query_is_registered_once():
    assert set(SQL) == set(QUERIES)
