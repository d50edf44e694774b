"""From raw documents to shuffled training shards: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and returns a DataFrame that is
written as Parquet and read again for the next stage. All but the last return the columns of ``documents``; the
last adds the shard and the slot of each row. Null and empty texts, repeated rows and empty tables go through
every stage with the results that its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgauge.llm import decontaminate, jaccard, mixing, quality, sharding
from webgauge.session import materialize

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more, fitted on the labels of the input's documents."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that every source has the same expected share of the bytes, in shuffled order."""
    return mixing.mix_sources(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into shards of equal size."""
    return sharding.shard_rows(docs, SHARDS)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: The discriminant, the components of the join and the shuffle are beyond SQL; ``tests/llm/test_pipeline.py``
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
