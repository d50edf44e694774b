"""Link statuses kept from run to run, as tables bucketed by URL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgauge.operators.links import best_statuses
from webgauge.session import shared_dir

BUCKETS = 200


def merge_statuses(
    spark: SparkSession, table: str, checked: DataFrame, run: int, known: str | None = None, *, buckets: int = BUCKETS, path: str | None = None
) -> DataFrame:
    """Write ``url, status, error, run`` as ``table``: what ``checked`` answers, and of ``known`` the other URLs.

    ``checked`` has url, status and error; of several answers for a URL the best one counts as in ``broken_statuses``.
    Null URLs and null statuses are no answers, so the older one stays. Each run writes a table of its own and never the one
    it reads: a run that fails leaves ``known`` as it was, and the caller drops tables no longer needed. ``path`` is where
    the rows go, by default a new folder below the shared one.

    The table has one row per URL in ``buckets`` buckets, which should be at least ``spark.sql.shuffle.partitions`` and the
    same from run to run. Joins on the URL then leave its rows where they are; here too only ``checked`` is shuffled.
    """
    fresh = best_statuses(checked).where("url is not null").select("url", "status", "error", F.lit(run).cast("int").alias("run"))
    rows = fresh.repartition(buckets, "url")
    if known is not None:
        rows = spark.table(known).join(fresh.select("url"), "url", "left_anti").select(*rows.columns).unionByName(rows)
    folder = path or f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "url").sortBy("url").option("path", folder).saveAsTable(table)
    return spark.table(table)
