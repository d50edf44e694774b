"""Session settings and lineage cutting shared by all jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "webgauge", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session it gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, never a machine-local one there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="webgauge-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts lineage like ``checkpoint()``, but keeps the columnar layout: later stages read only the
    columns they need, and the planner sees real sizes. A lost executor re-reads files, not HTML.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class GrowingTable:
    """A table in the shared folder that a loop adds rows to; ``last`` holds the rows that were added last.

    Each addition is a folder of its own under one root, written once: a plan over all of them is a single scan however
    many rounds there were, and a task that is run again writes its own folder again.
    """

    def __init__(self, first: DataFrame):
        self.spark, self.rounds = first.sparkSession, 0
        self.root = f"{shared_dir(self.spark)}/rounds-{uuid.uuid4().hex}"
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        path = f"{self.root}/round={self.rounds}"
        rows.write.parquet(path)
        self.schema, self.rounds = rows.schema, self.rounds + 1
        self.last = self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.root).select(*self.schema.names)


def deal_few_splits(df: DataFrame) -> DataFrame:
    """Deal a table that is read as fewer splits than there are cores to all of them.

    A split is at most ``spark.sql.files.maxPartitionBytes``, so this shuffle moves less than one wave of tasks reads.
    Splits are ranges of bytes, and those without the start of a row group stay empty: that a small table has several
    does not say that several tasks would have work. Larger tables keep their splits: to use more cores there, lower
    that setting instead of shuffling pages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
