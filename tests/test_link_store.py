"""The bucketed store of link statuses: merging runs, and joins that leave it where it lies."""

import re
import uuid

import pytest

from webgauge.operators.links import broken_links, links_to_check
from webgauge.sources.crawl import LINK_STATUS
from webgauge.sources.link_store import merge_statuses


@pytest.fixture
def name():
    return f"links_{uuid.uuid4().hex}"


def rows(df):
    return sorted((r.url, r.status, r.error, r.run) for r in df.collect())


def test_later_answers_replace_earlier_ones(spark, name):
    first = [("a", 200, None), ("b", 404, "x"), ("b", 500, "y"), ("c", 0, "timeout"), ("d", None, None), (None, 404, None)]
    one = merge_statuses(spark, f"{name}_1", spark.createDataFrame(first, LINK_STATUS), 1, buckets=8)
    assert rows(one) == [("a", 200, None, 1), ("b", 404, "x", 1), ("c", 0, "timeout", 1)]
    second = [("b", 200, None), ("b", 404, "z"), ("c", None, None), ("e", 410, "gone")]
    two = merge_statuses(spark, f"{name}_2", spark.createDataFrame(second, LINK_STATUS), 2, f"{name}_1", buckets=8)
    assert rows(two) == [("a", 200, None, 1), ("b", 200, None, 2), ("c", 0, "timeout", 1), ("e", 410, "gone", 2)]
    assert rows(one) == [("a", 200, None, 1), ("b", 404, "x", 1), ("c", 0, "timeout", 1)]
    edges = spark.createDataFrame([("e",), ("f",), ("f",)], "target string")
    assert [r.url for r in links_to_check(edges, two).collect()] == ["f"]


def test_empty_runs(spark, name):
    none = spark.createDataFrame([], LINK_STATUS)
    assert merge_statuses(spark, f"{name}_1", none, 1, buckets=8).count() == 0
    assert merge_statuses(spark, f"{name}_2", none, 2, f"{name}_1", buckets=8).count() == 0


def test_joins_leave_the_store_where_it_lies(spark, name):
    answers = [(f"u{k}", (200, 404, 0)[k % 3], None) for k in range(300)]
    status = spark.createDataFrame(answers, LINK_STATUS)
    merge_statuses(spark, f"{name}_1", status.limit(200), 1, buckets=8)
    store = merge_statuses(spark, f"{name}_2", status, 2, f"{name}_1", buckets=8)
    edges = spark.createDataFrame([("s", f"p{k}", "link", 0, f"u{k * k % 400}" if k % 3 else "u1") for k in range(3000)], "site string, url string, kind string, pos int, target string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = broken_links(edges, store, stored=True)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, joined.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == sorted(map(tuple, broken_links(edges, status).collect()), key=repr) != []
    # The rows of cool keys: one shuffle, that of the edges. Hot keys meet a broadcast of their few rows.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, plan
    assert "Bucketed: true" in plan
