"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from webgauge.plans.catalog import QUERIES
from webgauge.session import local_session

HEADLINE = (
    "page_basics", "content_metrics", "top_keywords", "structured_data", "seo_score", "broken_rollup",
    "duplicate_pages", "redirect_chain", "sitemap_expand", "document_metrics", "top_issues", "site_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    # Session start and the first compilation belong to no query.
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
